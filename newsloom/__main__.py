"""Command line: stages of the news chain, and registered queries.

    python -m newsloom documents --raw DIR --lookup FILE --start 2023-02-06 --end 2023-02-09 --out DIR
    python -m newsloom resolve --tables DIR --out DIR [--vectors TABLE] [--threshold 0.3 ...]
    python -m newsloom query NAME --tables DIR --out DIR
    python -m newsloom fetch URL... --out DIR
    python -m newsloom serve [--store DIR] [--explorer DIR] [--observations TABLE] [--port 8000]

Every stage reads and writes Parquet tables; a run of ``resolve`` takes any field of its
settings as an option.
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import shutil
import urllib.request
from pathlib import Path

from pyspark.sql import SparkSession

from newsloom.functions.times import parse_window
from newsloom.operators import similarity
from newsloom.plans import catalogue, documents, explorer, ingest, resolve, serving, web
from newsloom.plans.payloads import as_dict
from newsloom.sources import raw, sinks


def _plain_fields(kind: type) -> list[dataclasses.Field]:
    return [f for f in dataclasses.fields(kind) if isinstance(f.default, (int, float, str)) and not isinstance(f.default, bool)]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="newsloom")
    stages = top.add_subparsers(dest="stage", required=True)
    one = stages.add_parser("documents", help="raw files of a window to typed tables, documents and their events")
    for name in ("raw", "lookup", "start", "end", "out"):
        one.add_argument(f"--{name}", required=True)
    one.add_argument("--allow-partial", action="store_true")
    two = stages.add_parser("resolve", help="documents to incidents and story families")
    two.add_argument("--tables", required=True)
    two.add_argument("--vectors")
    two.add_argument("--out", required=True)
    for f in [*_plain_fields(resolve.Settings), *_plain_fields(similarity.Gate)]:
        two.add_argument(f"--{f.name.replace('_', '-')}", type=type(f.default), default=f.default)
    three = stages.add_parser("query", help="a registered query over a folder of tables")
    three.add_argument("name", choices=sorted(catalogue.QUERIES))
    three.add_argument("--tables", required=True)
    three.add_argument("--out", required=True)
    four = stages.add_parser("fetch", help="download files that aren't there yet")
    four.add_argument("urls", nargs="+")
    four.add_argument("--out", required=True)
    five = stages.add_parser("serve", help="answer requests over HTTP from written tables")
    for name in ("store", "explorer", "observations"):
        five.add_argument(f"--{name}")
    five.add_argument("--host", default="127.0.0.1")
    five.add_argument("--port", type=int, default=8000)
    return top


def served(spark: SparkSession, args: argparse.Namespace) -> web.Served:
    """What the given folders hold; a part without a folder isn't served."""
    read = lambda n: spark.read.parquet(f"{args.explorer}/{n}")
    return web.Served(
        serving.AttentionStore.open(spark, args.store) if args.store else None,
        explorer.Explorer({n: read(n) for n in ("articles", "article_events", "events")}) if args.explorer else None,
        spark.read.parquet(args.observations) if args.observations else None,
    )


def settings(args: argparse.Namespace) -> resolve.Settings:
    pick = lambda kind: {f.name: getattr(args, f.name) for f in _plain_fields(kind)}
    return resolve.Settings(**pick(resolve.Settings), gate=similarity.Gate(**pick(similarity.Gate)))


def build(spark: SparkSession, args: argparse.Namespace) -> dict[str, int]:
    """Write the tables of a window; returns how many files of each kind were missing."""
    start, end = parse_window(args.start), parse_window(args.end)
    tables, gaps = {}, {}
    for name in ("mentions", "events", "gkg"):
        tables[name], audit, missing = ingest.load_table(spark, name, args.raw, start, end, args.allow_partial)
        sinks.write_table(audit, f"{args.out}/audit_{name}")
        gaps[name] = len(missing)
    for name, t in tables.items():
        sinks.write_table(t, f"{args.out}/{name}")
    mentions, events, gkg = (spark.read.parquet(f"{args.out}/{n}") for n in ("mentions", "events", "gkg"))
    sinks.write_table(ingest.build_sources(mentions, gkg, raw.domain_lookup(spark, args.lookup)), f"{args.out}/sources")
    sinks.write_table(documents.build_documents(mentions, gkg, spark.read.parquet(f"{args.out}/sources")), f"{args.out}/documents")
    docs = spark.read.parquet(f"{args.out}/documents")
    sinks.write_table(documents.build_document_events(mentions, docs), f"{args.out}/document_events")
    links = spark.read.parquet(f"{args.out}/document_events")
    sinks.write_table(documents.build_atomic_events(links, docs, events, similarity.theme_idf(docs)), f"{args.out}/atomic_events")
    return gaps


def fetch(urls: list[str], out: str) -> list[str]:
    """Download what isn't there yet; a file appears under its name only when it is whole."""
    Path(out).mkdir(parents=True, exist_ok=True)
    got = []
    for url in urls:
        target = Path(out) / url.rsplit("/", 1)[-1]
        if not target.exists():
            part = target.with_name(target.name + ".part")
            with urllib.request.urlopen(url) as source, part.open("wb") as sink:  # noqa: S310
                shutil.copyfileobj(source, sink)
            part.rename(target)
            got.append(target.name)
    return got


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.stage == "fetch":
        print(json.dumps({"fetched": fetch(args.urls, args.out)}))
        return
    spark = SparkSession.builder.appName(f"newsloom {args.stage}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.stage == "documents":
        print(json.dumps({"missing_files": build(spark, args)}))
    elif args.stage == "resolve":
        chosen = settings(args)
        vectors = spark.read.parquet(args.vectors) if args.vectors else None
        read = lambda n: spark.read.parquet(f"{args.tables}/{n}")
        for name, t in resolve.resolve(read("documents"), read("document_events"), vectors, chosen).items():
            sinks.write_table(t, f"{args.out}/{name}")
        print(json.dumps({"settings": as_dict(chosen)}))
    elif args.stage == "serve":
        web.serve(served(spark, args), args.port, args.host)
    else:
        sinks.write_table(catalogue.QUERIES[args.name](spark, args.tables), args.out)


if __name__ == "__main__":
    main()
