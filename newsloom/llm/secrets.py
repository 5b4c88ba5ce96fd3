"""Secret scans with an incremental blob ledger.

Every historical version of a file is addressed by the SHA-256 of its content. A ledger
has a row for each blob and run that scanned it: which rule versions were run, and the
spans they found. A run scans only blobs that lack a rule version, each blob once, with
just the rules it lacks; its additions are appended to the ledger in one write. Findings
of all runs, for the rule versions in force, are joined back to every path and version
that holds the blob: an incremental run reports what a full scan would. Spans of a
superseded rule version stay in the ledger and are no longer reported.

What travels first is (id, blob). One holder is chosen per unseen blob by an aggregate
that combines on the map side, so a text with a third of all rows costs one row a task;
then only the holders' texts move, to tasks that scan them. Findings are one row for each
blob that has any; the join back is of narrow rows and may be split by Spark where a blob
is everywhere.

Defined cases: a null text is the empty text; repeated versions share their blob; a null
id keeps its row; an empty ledger or table is fine; additions appended twice, or by two
runs at once, report once; spans are in code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import materialize


@dataclass(frozen=True)
class Rule:
    """A kind of secret: spans of ``pattern`` whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False
    #: One of these strings, in lower case, is in every text with a match.
    hints: tuple[str, ...] = ()
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE_RULES = (
    Rule(
        "assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12, 2, True, ("passw", "secret", "token", "api"),
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 18, hints=("akia",)),
    # runs are maximal, so a run of 16 or more is what [0-9a-f]+ would have matched
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
EXTRA_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", hints=("private key",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyj",)),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("gh",)),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
)
RULES = BASE_RULES + EXTRA_RULES

SPANS = "array<struct<kind:string,start:long,end:long>>"
#: ``rules``: the rule versions run on the blob; ``found``: what they found, if anything.
LEDGER = "blob binary, rules array<string>, found array<struct<rule:string,start:long,end:long>>"


def find_spans(text: str, rules: Sequence[Rule]) -> list[tuple[str, int, int]]:
    """(kind, start, end) in order of start, then of the rules."""
    found, low = [], text.lower()
    for at, rule in enumerate(rules):
        if rule.hints and not any(h in low for h in rule.hints):
            continue
        for m in re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0)).finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(), at, m.end()))
    return [(rules[at].kind, start, end) for start, at, end in sorted(found)]


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def blob_index(versions: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, blob) of every version."""
    return versions.select(F.col(doc_id).alias("doc_id"), address(F.col(text)).alias("blob"))


def scan_unseen(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows to append to ``ledger``, as a written table: unseen (blob, rule version) pairs, scanned."""
    blobs = versions.select(F.col(doc_id).alias("doc_id"), address(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    done = ledger.groupBy(F.col("blob").alias("b")).agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    unseen = (
        blobs.groupBy("blob")
        .agg(F.min("doc_id").alias("holder"))
        .join(done, F.col("blob") == F.col("b"), "left")
        .withColumn("todo", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>"))))
        .where(F.size("todo") > 0)
        .select(F.col("blob").alias("u"), "holder", "todo")
    )
    by_key = {r.key: r for r in rules}
    key_of = {r.kind: r.key for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            found = []
            for todo, said in zip(b.column(1), b.column(2)):
                lacking = set(todo.as_py())
                spans = find_spans(said.as_py(), [r for r in by_key.values() if r.key in lacking])
                found.append([{"rule": key_of[k], "start": s, "end": e} for k, s, e in spans])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, kind)], names=["blob", "rules", "found"])

    texts = blobs.join(unseen, (F.col("blob") == F.col("u")) & F.col("doc_id").eqNullSafe(F.col("holder"))).select("blob", "todo", "text")
    return materialize(texts.mapInArrow(run, LEDGER).dropDuplicates(["blob"]), "ledger")


def current_findings(ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, spans) of the blobs in which the rule versions in force have found anything."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    ours = F.filter("found", lambda s: F.array_contains(keys, s["rule"]))
    ordered = F.transform(ours, lambda s: F.struct(s["start"].alias("start"), F.array_position(keys, s["rule"]).alias("at"), s["end"].alias("end")))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    spans = F.transform(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ordered")))),
        lambda s: F.struct(F.element_at(kinds, s["at"].cast("int")).alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return ledger.select("blob", ordered.alias("ordered")).where(F.size("ordered") > 0).groupBy("blob").agg(spans.alias("spans"))


def join_back(index: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, blob, spans): findings at every path; no findings: an empty list."""
    have = findings.withColumnRenamed("blob", "f")
    return index.join(have, F.col("blob") == F.col("f"), "left").select(
        "doc_id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")
    )


def scan_versions(
    versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, doc_id: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """One run: (doc_id, blob, spans) of all versions, old findings included, and the
    additions to append to the ledger."""
    additions = scan_unseen(versions, ledger, rules, doc_id, text)
    known = ledger.unionByName(additions)
    return join_back(blob_index(versions, doc_id, text), current_findings(known, rules)), additions


def span_report(found: DataFrame) -> DataFrame:
    """Counts by base kind, a digest of base spans, and all spans as one string."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kinds = [r.kind for r in BASE_RULES]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in kinds],
        F.sha2(said(F.filter("spans", lambda s: s["kind"].isin(kinds))), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
    )
