"""Quality rules by cross-document line frequency.

Normalised lines are hashed and every host's different documents are counted per line.
Lines found in more of them than the limits allow are removed, and documents that this
depletes are rejected, besides those that fail rules on their own text.

Documents of one host with the same set of normalised lines are copies of one and count
once, for the line as for the host: a group of copies, however large, makes none of its
own lines frequent, and one of them is left to the near-duplicate stage.

Only DataFrame functions run here. A document counts once per line (duplicates go inside
the row), copies and counts combine on the map side, so neither a common line nor a host
with a third of all rows meets in one task. Only frequent lines come back to the documents, from a
written table whose size decides between broadcast and a shuffled join that Spark may
split. The repeated-word count sorts window hashes inside the row: n log n in its words.

Defined cases: a null text has no words and fails; a null host is a host; blank lines
don't count; repeated rows (same id and text) are judged alike; limits need both the
count and the share to be exceeded, so small hosts lose nothing by chance; no rows in,
no rows out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import NOT_SPACE, SPACE, let, materialize, n_words, words


@dataclass(frozen=True)
class LineLimits:
    """A line goes if over ``documents`` and over ``share`` of its host's different documents have it."""

    documents: int = 20
    share: float = 0.05
    #: A document is rejected if over this share of its words stood in removed lines.
    depleted: float = 0.5


def _repeat_words(w: Column) -> Column:
    """Words in three-word windows that the list holds twice or more."""

    def windows(h: Column) -> Column:
        at = lambda i: F.element_at(h, i)
        each = F.transform(F.sequence(F.lit(1), F.size(h) - 2), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
        return F.when(F.size(h) < 3, F.lit(0)).otherwise(let(each, covered))

    def covered(t: Column) -> Column:
        ordered = F.array_sort(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(let(ordered, repeated))

    def repeated(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        twice = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return let(F.array_sort(F.transform(twice, lambda x: x["i"])), union)

    def union(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(F.transform(w, lambda x: F.xxhash64(x)), windows)


def base_rules(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))

    def failed(s: Column) -> Column:
        return F.struct(
            *[s[c].cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            ((s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])).alias("base_failed"),
        )

    def measured(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, SPACE, "")).alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        )

    return let(let(words(text), measured), failed)


def _line_hashes(text: Column) -> Column:
    """(place, hash, words) of the lines that have a word, in their normalised form."""
    clean = lambda x: F.lower(F.array_join(words(x), " "))
    every = F.transform(F.split(text, "\n"), lambda x, i: let(clean(x), lambda c: F.struct(i.alias("place"), F.xxhash64(c).alias("hash"), F.when(c == "", 0).otherwise(F.size(F.split(c, " "))).alias("words"))))
    return F.filter(every, lambda s: s["words"] > 0)


def frequent_lines(docs: DataFrame, limits: LineLimits = LineLimits(), text: str = "text", host: str = "source") -> DataFrame:
    """(host, hash, documents): the lines above the limits, with the number of different
    documents that have them, as a written table."""
    lines = F.array_sort(F.array_distinct(F.transform(_line_hashes(F.col(text)), lambda s: s["hash"])))
    different = docs.select(F.col(host).alias("host"), lines.alias("lines")).withColumn("digest", F.xxhash64("lines")).dropDuplicates(["host", "digest"])
    different = materialize(different.select("host", "lines"), "different-documents")
    of_host = different.groupBy(F.col("host").alias("h")).agg(F.count("*").alias("of_host"))
    counted = different.select("host", F.explode("lines").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("documents")).where(F.col("documents") > limits.documents)
    over = counted.join(of_host, F.col("host").eqNullSafe(F.col("h"))).where(F.col("documents") > limits.share * F.col("of_host"))
    return materialize(over.select("host", "hash", "documents"), "frequent-lines")


def removed_lines(
    docs: DataFrame, limits: LineLimits = LineLimits(), doc_id: str = "doc_id", text: str = "text", host: str = "source"
) -> DataFrame:
    """(_id, _key, removed): for documents that lose lines, the places and words of those."""
    frequent = frequent_lines(docs, limits, text, host).select(F.col("host").alias("h"), F.col("hash").alias("f"))
    lines = docs.select(
        F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_key"), F.col(host).alias("host"), F.explode(_line_hashes(F.col(text))).alias("line")
    )
    return (
        lines.join(frequent, F.col("host").eqNullSafe(F.col("h")) & (F.col("line.hash") == F.col("f")))
        .groupBy("_id", "_key")
        .agg(F.collect_set(F.struct("line.place", "line.words")).alias("removed"))
    )


def _removed_words(removed: Column) -> Column:
    return F.coalesce(F.aggregate(removed, F.lit(0).cast("long"), lambda a, x: a + x["words"]), F.lit(0).cast("long"))


def judge(docs: DataFrame, limits: LineLimits = LineLimits(), doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Every document's measures, removed_words and verdict (kept)."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("key"), base_rules(F.col(text)).alias("base"))
    gone = removed_lines(docs, limits, doc_id, text, host).select("_id", "_key", _removed_words(F.col("removed")).alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return base.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").select(
        "doc_id", "base.*", n.alias("removed_words"), (~F.col("base.base_failed") & (n <= limits.depleted * F.col("base.n_words"))).alias("kept")
    )


def clean(
    docs: DataFrame, limits: LineLimits = LineLimits(), doc_id: str = "doc_id", text: str = "text", host: str = "source", n_chars: str = "n_chars"
) -> DataFrame:
    """The kept documents, the same columns, without their frequent lines."""
    gone = removed_lines(docs, limits, doc_id, text, host)
    row = docs.select(F.struct("*").alias("_row"), F.xxhash64(F.col(text)).alias("_k"))
    body = F.col(f"_row.{text}")
    # a text's own rules need no join: what they reject never travels, and they are evaluated once
    judged = (
        row.where(~base_rules(body)["base_failed"])
        .join(gone, F.col(f"_row.{doc_id}").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_key")), "left")
        .where(_removed_words(F.col("removed")) <= limits.depleted * n_words(body))
    )

    def rest(lines: Column) -> Column:
        gone_places = F.transform("removed", lambda s: s["place"])
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone_places)
        return F.array_join(F.transform(places, lambda i: F.element_at(lines, i + 1)), "\n")

    new = F.when(F.col("removed").isNull(), body).otherwise(let(F.split(body, "\n"), rest))
    out = F.col("_row").withField(text, new)
    if n_chars in docs.columns:
        kept = F.when(F.col("removed").isNull(), F.col(f"_row.{n_chars}")).otherwise(F.length(new).cast("long"))
        out = out.withField(n_chars, kept)
    return judged.select(out.alias("_row")).select("_row.*")
