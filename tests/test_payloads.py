"""Payloads, the command line, and scans without files."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from newsloom import __main__ as cli
from newsloom.functions.fixed import EVENT_COLUMNS
from newsloom.operators import families, responses, similarity
from newsloom.plans import payloads, resolve
from newsloom.sources import raw
from tests import world


def test_as_dict():
    plain = payloads.as_dict(resolve.Settings())
    assert plain["seed"] == 2026 and plain["gate"]["threshold"] == 0.3 and plain["family_channels"] == ["entity", "event"]
    shown = payloads.as_dict(responses.Support())
    assert shown and all(isinstance(v, (int, float, str, list)) for v in shown.values())


def test_geojson_meta_health(spark):
    places = spark.createDataFrame([("Rome", 41.9, 12.5, 3, None)], "ActionGeo_FullName string, lat double, lon double, count long, theme string")
    out = payloads.geojson(places)
    assert out["type"] == "FeatureCollection" and out["features"] == [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [12.5, 41.9]}, "properties": {"name": "Rome", "count": 3, "theme": None}}
    ]
    assert payloads.geojson(places.limit(0))["features"] == []
    at = datetime(2024, 1, 2, tzinfo=timezone.utc)
    articles = spark.createDataFrame([("a", "eng", at), ("b", "eng", at)], "domain string, language string, seendate timestamp")
    meta = payloads.explorer_meta(articles, places, ["title"])
    assert (meta["articles"], meta["domains"], meta["languages"], meta["events"], meta["derived_fields"]) == (2, 2, 1, 1, ["title"])
    assert payloads.health(spark, {"a": articles, "b": places.limit(0)}) | {"spark": ""} == {"status": "empty", "tables": ["a", "b"], "empty": ["b"], "spark": ""}
    facets = spark.createDataFrame([("x", "p", 1), ("x", "q", 5), ("y", "r", 2)], "facet string, value string, count long")
    assert payloads.facet_lists(facets) == {"x": [{"value": "q", "count": 5}, {"value": "p", "count": 1}], "y": [{"value": "r", "count": 2}]}


def test_titles_are_encoded_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "document_id long, title string")
    seen = []

    def encode(titles):
        seen.append(titles.count())
        return titles.withColumn("vector", F.array(F.length("title").cast("double")))

    assert sorted(r["document_id"] for r in payloads.title_vectors(docs, encode).collect()) == [1, 2, 3] and seen == [2]
    path = f"{tmp_path}/shards"
    for _ in range(2):
        assert payloads.title_vectors(docs, encode, path, 4).count() == 3
    assert seen[-1] == 0 and spark.read.parquet(path).count() == 2


def test_reports(spark):
    curve = spark.createDataFrame([(10, 1), (2, 4), (1, 4), (5, 3)], "size long, at_least long")
    svg = payloads.survival_svg(curve)
    assert svg.startswith("<svg") and svg.count("V") == 2 and "M40.0," in svg
    assert payloads.survival_svg(curve.limit(0)).startswith("<svg")
    text = payloads.markdown_report("Run", {"Sizes": curve.orderBy("size"), "Note": "none"})
    assert "# Run" in text and "| size | at_least |" in text and "| 10 | 1 |" in text and "## Note" in text


def test_settings_of_the_command_line():
    args = cli.parser().parse_args(["resolve", "--tables", "t", "--out", "o", "--threshold", "0.5", "--family-hours", "12", "--seed", "3"])
    chosen = cli.settings(args)
    assert (chosen.gate.threshold, chosen.family_hours, chosen.seed) == (0.5, 12.0, 3) and chosen.gate.min_channels == 2


def test_fetch(tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    url = (tmp_path / "a.txt").as_uri()
    assert cli.fetch([url], str(tmp_path / "out")) == ["a.txt"] and cli.fetch([url], str(tmp_path / "out")) == []
    assert (tmp_path / "out" / "a.txt").read_text() == "hello"


def test_documents_stage(spark, tmp_path):
    world.write_raw(tmp_path / "raw")
    world.write_lookup(tmp_path / "lookup.txt")
    argv = ["documents", "--raw", str(tmp_path / "raw"), "--lookup", str(tmp_path / "lookup.txt"), "--start", "2023-02-06T00:00:00+00:00", "--end", "2023-02-06T03:00:00+00:00", "--out", str(tmp_path / "out"), "--allow-partial"]
    gaps = cli.build(spark, cli.parser().parse_args(argv))
    assert gaps == {"mentions": 1, "events": 0, "gkg": 0}
    assert spark.read.parquet(f"{tmp_path}/out/documents").count() >= 61 and spark.read.parquet(f"{tmp_path}/out/atomic_events").count() > 5


def test_scan_without_files(spark, tmp_path):
    with pytest.raises(raw.MissingFiles):
        raw.glob_scan(spark, str(tmp_path), "*.export.csv", EVENT_COLUMNS)
    (tmp_path / "a.export.csv").write_text("1\t2\n")
    assert raw.glob_scan(spark, str(tmp_path), "*.export.csv", EVENT_COLUMNS).count() == 1


def test_pairs_that_share(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "left long, right long")
    features = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "c")], "incident_id long, feature string")
    assert [tuple(r) for r in families.sharing(pairs, features).collect()] == [(1, 2)]
    with pytest.raises(ValueError):
        similarity.cosine_pairs(features.select(F.col("incident_id").alias("node"), "feature", F.lit(1.0).alias("weight")), most=1)
