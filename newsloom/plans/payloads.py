"""Payloads of a read interface: plain values made of already limited results.

Functions here take DataFrames whose size is a page (a limit, a facet, one row) and give
dictionaries or text that any server or report can pass on.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.times import stamp
from newsloom.plans.cutpoint import materialize
from newsloom.sources import sinks


def as_dict(settings: object) -> dict:
    """A settings or filter object as plain values: times as stamps, None left out."""

    def plain(v: object) -> object:
        if isinstance(v, datetime):
            return stamp(v)
        if dataclasses.is_dataclass(v):
            return as_dict(v)
        return list(v) if isinstance(v, (tuple, set, frozenset)) else v

    return {f.name: plain(v) for f in dataclasses.fields(settings) if (v := getattr(settings, f.name)) is not None}


def geojson(places: DataFrame) -> dict:
    """Places (lat, lon and properties; a limited result) as a FeatureCollection of points."""
    rows = sinks.records(places)
    return {
        "type": "FeatureCollection",
        "features": [
            {
                "type": "Feature",
                "geometry": {"type": "Point", "coordinates": [r["lon"], r["lat"]]},
                "properties": {"name": r["ActionGeo_FullName"]} | {k: v for k, v in r.items() if k not in ("lat", "lon", "ActionGeo_FullName")},
            }
            for r in rows
        ],
    }


def explorer_meta(articles: DataFrame, events: DataFrame, derived: Sequence[str] = ()) -> dict:
    """Counts and window of the explorer's tables, and which fields are derived, not given."""
    one = articles.agg(
        F.count("*").alias("articles"), F.count_distinct("domain").alias("domains"), F.count_distinct("language").alias("languages"),
        F.min("seendate").alias("first_seen"), F.max("seendate").alias("last_seen"),
    )
    return sinks.summary_json(one) | {"events": events.count(), "derived_fields": list(derived)}


def health(spark: SparkSession, tables: dict[str, DataFrame]) -> dict:
    """Whether every table can be read, by its first row."""
    empty = [name for name, t in tables.items() if t.limit(1).isEmpty()]
    return {"status": "ok" if not empty else "empty", "tables": sorted(tables), "empty": empty, "spark": spark.version}


def facet_lists(facets: DataFrame) -> dict[str, list[dict]]:
    """(facet, value, count) rows as one list a facet, most frequent first."""
    out: dict[str, list[dict]] = {}
    for r in sorted(sinks.records(facets), key=lambda r: (r["facet"], -r["count"], str(r["value"]))):
        out.setdefault(r["facet"], []).append({"value": r["value"], "count": r["count"]})
    return out


# ---------------------------------------------------------------- distinct titles for an encoder


def unique_titles(documents: DataFrame) -> DataFrame:
    """(title): every title once."""
    return documents.where("title is not null").select("title").distinct()


def title_vectors(documents: DataFrame, encode: Callable[[DataFrame], DataFrame], path: str | None = None, shards: int = 16) -> DataFrame:
    """(document_id, vector): each different title is encoded once and joined to its documents.

    ``encode`` turns a table with ``title`` into one with ``title`` and ``vector``. With a
    ``path`` its results are kept there in shards, and a run that broke off goes on.
    """
    titles = unique_titles(documents)
    if path is None:
        done = materialize(encode(titles).select("title", "vector"), "title-vectors")
    else:
        sinks.write_shards(titles, path, "title", shards, encode)
        done = documents.sparkSession.read.parquet(path)
    return documents.select("document_id", "title").join(done.select("title", "vector"), "title").select("document_id", "vector")


# ---------------------------------------------------------------- reports


def markdown_table(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    """A limited result as a Markdown table."""
    columns = list(columns or df.columns)
    shown = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", r"\|").replace("\n", " ")
    rows = sinks.records(df.select(*columns))
    lines = [" | ".join(columns), " | ".join("---" for _ in columns), *(" | ".join(shown(r.get(c)) for c in columns) for r in rows)]
    return "\n".join(f"| {x} |" for x in lines) + "\n"


def markdown_report(title: str, parts: dict[str, DataFrame | str]) -> str:
    """Sections of text or limited results under one title."""
    return "\n".join([f"# {title}\n", *(f"## {k}\n\n{v if isinstance(v, str) else markdown_table(v)}" for k, v in parts.items())])


def survival_svg(curve: DataFrame, size: str = "size", at_least: str = "at_least", width: int = 640, height: int = 360, pad: int = 40) -> str:
    """The curve of how many clusters have at least a size, as steps on logarithmic axes.

    ``curve`` has a row for each size that occurs, as ``evaluation.survival`` gives it.
    """
    from math import log10

    points = sorted((r[size], r[at_least]) for r in sinks.records(curve.select(size, at_least)))
    if not points:
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"/>'
    far, high = max(1e-9, log10(max(2, points[-1][0]))), max(1e-9, log10(max(2, points[0][1])))
    x = lambda v: round(pad + (width - 2 * pad) * log10(max(1, v)) / far, 1)
    y = lambda v: round(height - pad - (height - 2 * pad) * log10(max(1, v)) / high, 1)
    path, before = [f"M{x(points[0][0])},{y(points[0][1])}"], points[0][1]
    for s, n in points[1:]:
        path.append(f"H{x(s)}" if n == before else f"V{y(n)} H{x(s)}")
        before = n
    return (
        f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><path d="{" ".join(path)}" fill="none" stroke="black"/>'
        f'<text x="{width // 2}" y="{height - 8}">size</text><text x="4" y="{pad - 8}">clusters of at least that size</text></svg>'
    )
