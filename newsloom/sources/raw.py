"""Raw quarter-hour files: listing, archives, tolerant and strict scans."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.fixed import EVENT_COLUMNS, GKG_COLUMNS, MENTION_COLUMNS
from newsloom.functions.times import slots

#: File kinds of each table: the English family and the translated one.
KINDS = {
    "mentions": ("mentions.CSV", "translation.mentions.CSV"),
    "events": ("export.CSV", "translation.export.CSV"),
    "gkg": ("gkg.csv", "translation.gkg.csv"),
}
COLUMNS = {"mentions": MENTION_COLUMNS, "events": EVENT_COLUMNS, "gkg": GKG_COLUMNS}


class MissingFiles(FileNotFoundError):
    """Quarter hours of the window have no file."""


def listing(spark: SparkSession, directory: str) -> DataFrame:
    """(path, name): the files of a folder, also empty ones, from whatever store Spark can reach.

    Names are what any scan lists on the driver too: some 600 a day.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(directory)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.listStatus(where) if system.exists(where) else []
    rows = [(f.getPath().toString(), f.getPath().getName()) for f in found if f.isFile()]
    return spark.createDataFrame(rows, "path string, name string")


def expected_files(spark: SparkSession, directory: str, kind: str, start: datetime, end: datetime) -> tuple[DataFrame, DataFrame]:
    """(present: name and path, missing: name) of the quarter hours in [start, end).

    An archive counts first, then the exact name, then the name in lower case.
    """
    wanted = slots(spark, start, end).select(F.concat("stamp", F.lit(f".{kind}")).alias("expected"))
    ways = [F.concat("expected", F.lit(".zip")), F.col("expected"), F.lower("expected")]
    options = wanted.select("expected", F.posexplode(F.array(*ways)).alias("way", "name"))
    there = options.join(listing(spark, directory), "name")
    present = there.groupBy("expected").agg(F.min_by("path", "way").alias("path"))
    return present, wanted.join(present, "expected", "left_anti")


def open_archive(name: str, content: bytes) -> bytes:
    """The single member of an archive; other files as they are."""
    if not name.lower().endswith(".zip"):
        return content
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        members = archive.namelist()
        if len(members) != 1:
            raise ValueError(f"{name}: expected one member, found {members}")
        return archive.read(members[0])


def lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(source_file, value, bytes): every line, decoded leniently.

    Plain files are split by Spark's text reader; an archive is one task's work, as it
    can't be split, and is a quarter of an hour's rows.
    """
    plain = [p for p in paths if not p.lower().endswith(".zip")]
    zipped = [p for p in paths if p.lower().endswith(".zip")]
    out = spark.createDataFrame([], "source_file string, value string")
    if plain:
        out = out.unionByName(spark.read.text(list(plain)).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("source_file"), F.regexp_replace("value", r"\r$", "").alias("value")))
    if zipped:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    name = path.rsplit("/", 1)[-1]
                    rows = open_archive(name, content).split(b"\n")
                    text = [r.decode("utf-8", "replace").rstrip("\r") for r in (rows[:-1] if rows and not rows[-1] else rows)]
                    for at in range(0, len(text), 10_000):
                        part = text[at : at + 10_000]
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(part)], names=["source_file", "value"])

        archives = spark.read.format("binaryFile").load(list(zipped)).select("path", "content")
        out = out.unionByName(archives.mapInArrow(run, "source_file string, value string"))
    return out


def read_raw(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], keep: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, audit): rows of the right width as strings (empty fields are null) with
    ``source_file``; per file how many rows there were and how many were malformed."""
    cut = lines(spark, paths).select("source_file", F.split("value", "\t", -1).alias("f"))
    fits = F.size("f") == len(columns)
    at = {c: i for i, c in enumerate(columns)}
    rows = cut.where(fits).select(*[F.nullif(F.col("f")[at[c]], F.lit("")).alias(c) for c in (keep or columns)], "source_file")
    audit = cut.groupBy("source_file").agg(F.count("*").alias("rows"), F.count_if(~fits).alias("malformed_rows"))
    return rows, audit


def manifest(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, bytes, sha256) of the files themselves."""
    return spark.read.format("binaryFile").load(list(paths)).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")
    )


def read_strict(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, audit): a row of another width is an error; audit counts nulls, empties and
    replaced characters per column."""
    cut = lines(spark, paths).select("source_file", F.split("value", "\t", -1).alias("f"))
    checked = F.when(F.size("f") == len(columns), F.col("f")).otherwise(
        F.raise_error(F.concat(F.lit("unexpected width in "), "source_file", F.lit(": "), F.size("f").cast("string"))).cast("array<string>")
    )
    rows = cut.select("source_file", checked.alias("f")).select(*[F.nullif(F.col("f")[i], F.lit("")).alias(c) for i, c in enumerate(columns)], "source_file")
    bad = F.sum(sum((F.length(F.coalesce(F.col(c), F.lit(""))) - F.length(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("�"))) for c in columns), F.lit(0)))
    counts = rows.agg(F.count("*").alias("rows"), bad.alias("replacements"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])
    return rows, counts


def _glob_regex(pattern: str) -> str:
    """A file pattern of ``*`` and ``?`` as a regular expression."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def glob_scan(spark: SparkSession, directory: str, pattern: str, columns: Sequence[str]) -> DataFrame:
    """All files of a pattern, no quoting; none is an error."""
    names = listing(spark, directory).select("name").where(F.col("name").rlike(_glob_regex(pattern)))
    if names.isEmpty():
        raise MissingFiles(f"no file in {directory} fits {pattern}")
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("pathGlobFilter", pattern).csv(directory, sep="\t", quote="", mode="PERMISSIVE")


def positions(spark: SparkSession, paths: Sequence[str], wanted: dict[str, int]) -> DataFrame:
    """Only the columns at the given places; short rows have nulls."""
    cut = lines(spark, paths).select(F.split("value", "\t", -1).alias("f"))
    return cut.select(*[F.get("f", F.lit(i)).alias(c) for c, i in wanted.items()])


def read_strict_slots(spark: SparkSession, directory: str, suffix: str, start: datetime, end: datetime, allow_missing: bool = False) -> tuple[list[str], list[str]]:
    """(paths, missing names) of ``<stamp>.<suffix>.csv``; none at all, or gaps, are errors."""
    present, missing = expected_files(spark, directory, f"{suffix}.csv", start, end)
    # one row a quarter of an hour: 35,000 a year
    paths, gaps = [r[0] for r in present.select("path").orderBy("path").collect()], [r[0] for r in missing.orderBy("expected").collect()]
    if not paths:
        raise MissingFiles(f"no {suffix} file between {start} and {end}")
    if gaps and not allow_missing:
        raise MissingFiles(f"{len(gaps)} files are missing, the first: {gaps[0]}")
    return paths, gaps


def load_strings(spark: SparkSession, table: str, directory: str, start: datetime, end: datetime, allow_partial: bool = False) -> tuple[DataFrame, DataFrame, list[str]]:
    """(rows, audit, missing): both families of a table in a window. Gaps are an error
    unless allowed; an empty window gives an empty table with its columns."""
    paths, gaps = [], []
    for kind in KINDS[table]:
        present, missing = expected_files(spark, directory, kind, start, end)
        paths += [r[0] for r in present.select("path").collect()]
        gaps += [r[0] for r in missing.collect()]
    if gaps and not allow_partial:
        raise MissingFiles(f"{len(gaps)} {table} files are missing, the first: {min(gaps)}")
    rows, audit = read_raw(spark, sorted(paths), COLUMNS[table])
    return rows, audit, sorted(gaps)


def domain_lookup(spark: SparkSession, path: str) -> DataFrame:
    """(domain, country, name): the last row of a domain counts; rows without a code don't.

    Lines are numbered inside the file by Spark's reader order: a list of some 10^5 rows.
    """
    fields = spark.read.text(path).select(F.split("value", "\t", -1).alias("f"), F.monotonically_increasing_id().alias("n"))
    good = fields.where((F.size("f") >= 3) & (F.col("f")[1] != ""))
    key = F.regexp_replace(F.lower(F.col("f")[0]), r"^www\.", "")
    return good.select(key.alias("domain"), F.col("f")[1].alias("country"), F.col("f")[2].alias("name"), "n").groupBy("domain").agg(
        F.max_by("country", "n").alias("country"), F.max_by("name", "n").alias("name")
    )


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines don't count."""
    return spark.read.schema(schema).json(path)
