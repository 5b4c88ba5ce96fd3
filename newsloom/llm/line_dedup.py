"""Line dedup by overlapping three-line windows.

Every three consecutive non-blank lines of a text are hashed. A window found twice or
more, anywhere, has a first occurrence (smallest document, then place); every later one
covers its lines, and the union of what is covered is removed. Each removed line stands
in an earlier place too, and following those places back ends at a kept one: no line
loses its last copy.

Only DataFrame functions run here. What travels is (hash, document, place), never texts,
until the covered places join their documents. Counts and first occurrences combine on
the map side, and only hashes found twice or more meet the windows again, by a join that
Spark may split where one passage is everywhere. Windows take 128 bits of hash, so a
chance collision is out of reach at any corpus size.

Defined cases: a null text stays null and has no windows; blank lines (ASCII white space
only) are never in a window and stay; lines are compared without the white space at their ends;
repeated rows (same id and text) are one document; a document with fewer than three
non-blank lines stays as it is; columns other than the text pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import let

WINDOW = 3


def _lines(text: Column) -> Column:
    """(place, line) of the non-blank lines, trimmed."""
    every = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "").alias("x")))
    return F.filter(every, lambda s: s["x"] != "")


def _windows(text: Column) -> Column:
    """(h1, h2, places) of each window of consecutive non-blank lines."""

    def over(lines: Column) -> Column:
        def window(k: Column) -> Column:
            at = [F.element_at(lines, (k + d).cast("int")) for d in range(1, WINDOW + 1)]
            said = [a["x"] for a in at]
            return F.struct(
                F.xxhash64(*said).alias("h1"),
                F.xxhash64(F.lit(1), *said).alias("h2"),
                F.array(*[a["i"] for a in at]).alias("places"),
            )

        return F.when(F.size(lines) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(lines) - WINDOW), window))

    return let(_lines(text), over)


def covered_places(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, key, covered): for each document that loses lines, their places from 0."""
    keyed = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("key"), F.explode(_windows(F.col(text))).alias("w"))
    windows = keyed.select("w.h1", "w.h2", "id", "key", "w.places")
    place = F.struct("id", "key", F.col("places")[0].alias("at"))
    repeated = (
        windows.groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(F.col("first") != F.col("last"))
        .select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "first")
    )
    later = windows.join(repeated, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2"))).where(place != F.col("first"))
    return (
        later.select("id", "key", F.explode("places").alias("place"))
        .groupBy("id", "key")
        .agg(F.collect_set("place").alias("covered"))
    )


def _deduplicated(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(_row: the row with its new text, _n: how many lines went)."""
    covered = covered_places(docs, doc_id, text).select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("covered").alias("_covered"))
    row = docs.select(F.struct("*").alias("_row"), F.xxhash64(F.col(text)).alias("_k"))
    joined = row.join(covered, F.col(f"_row.{doc_id}").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key")), "left")

    def kept(gone: Column) -> Column:
        def join(lines: Column) -> Column:
            places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
            return F.array_join(F.transform(places, lambda i: F.element_at(lines, i + 1)), "\n")

        return let(F.split(F.col(f"_row.{text}"), "\n"), join)

    new = F.when(F.col("_covered").isNull(), F.col(f"_row.{text}")).otherwise(kept(F.col("_covered")))
    return joined.select(F.col("_row").withField(text, new).alias("_row"), F.coalesce(F.size("_covered"), F.lit(0)).cast("long").alias("_n"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with covered lines taken out of ``text``, and ``lines_removed`` (long), which
    takes the place of a column of that name."""
    row = F.col("_row").dropFields("lines_removed") if "lines_removed" in docs.columns else F.col("_row")
    return _deduplicated(docs, doc_id, text).select(row.alias("_row"), "_n").select("_row.*", F.col("_n").alias("lines_removed"))


def strip_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with the same columns, its texts deduplicated and ``n_chars`` counted anew."""
    row = F.col("_row")
    if n_chars in docs.columns:
        counted = F.when(F.col("_n") > 0, F.length(row[text]).cast("long")).otherwise(row[n_chars])
        row = row.withField(n_chars, counted)
    return _deduplicated(docs, doc_id, text).select(row.alias("_row")).select("_row.*")
