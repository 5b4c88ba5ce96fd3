"""Filters that drop documents, events and features with little to tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def is_web(kind: Column, identifier: Column) -> Column:
    """A page on the web: mention type 1 and an http address."""
    return (kind == 1) & identifier.rlike(r"(?i)^https?://")


def without_roundups(links: DataFrame, document: str, event: str, most_events: int = 25, confidence: str | None = None, least: int = 40) -> DataFrame:
    """Links of sufficient confidence, of documents that don't list more than ``most_events`` events."""
    few = links.groupBy(document).agg(F.count_distinct(event).alias("_n")).where(F.col("_n") <= most_events).select(document)
    kept = links.join(few, document, "left_semi")
    return kept.where(F.col(confidence) >= least) if confidence else kept


def recurring_events(links: DataFrame, document: str, event: str, at: str, documents: int = 1000, days: float = 2) -> DataFrame:
    """Events that are both frequent and long-lived: in ``documents`` or more, over ``days`` or more."""
    span = (F.unix_micros(F.max(at).cast("timestamp")) - F.unix_micros(F.min(at).cast("timestamp"))) / F.lit(86400e6)
    return (
        links.groupBy(event).agg(F.count_distinct(document).alias("n"), span.alias("days"))
        .where((F.col("n") >= documents) & (F.col("days") >= days)).select(event)
    )


def without(df: DataFrame, dropped: DataFrame, keys: str | list[str]) -> DataFrame:
    return df.join(dropped, keys, "left_anti")


def bursty(rows: DataFrame, feature: str, node: str, day: Column, entropy_max: float = 0.95, least: int = 100) -> DataFrame:
    """(feature, n, entropy, steady): spread of a feature's first days, 1 being even.

    A steady feature, one of even spread in at least ``least`` nodes, tells no story.
    """
    per_day = rows.select(feature, node, day.alias("day")).distinct().groupBy(feature, "day").agg(F.count("*").alias("len"))
    share = F.col("len") / F.sum("len").over(W.partitionBy(feature))
    out = (
        per_day.withColumn("p", share).groupBy(feature)
        .agg(F.sum("len").alias("n"), (-F.sum(F.col("p") * F.log("p"))).alias("h"), F.count("*").alias("days"))
        .withColumn("entropy", F.col("h") / F.log(F.greatest(F.col("days"), F.lit(2)).cast("double")))
    )
    return out.select(feature, "n", "entropy", ((F.col("entropy") >= entropy_max) & (F.col("n") >= least)).alias("steady"))


def host_boilerplate(rows: DataFrame, host: str, feature: str, node: str, least: int = 20, share: float = 0.2) -> DataFrame:
    """(host, feature, n, share): features on too large a part of a host's documents."""
    docs = rows.where(F.col(host) != "").groupBy(host).agg(F.count_distinct(node).alias("docs")).where(F.col("docs") >= least)
    per = rows.select(host, feature, node).distinct().groupBy(host, feature).agg(F.count("*").alias("n"))
    return per.join(docs, host).withColumn("share", F.col("n") / F.col("docs")).where(F.col("share") >= share).select(host, feature, "n", "share")


def frequent_features(rows: DataFrame, node: str, feature: str, nodes: int, most_share: float = 0.1) -> DataFrame:
    """Features in over ``most_share`` of all ``nodes``."""
    return rows.groupBy(feature).agg(F.count_distinct(node).alias("df")).where(F.col("df") > most_share * nodes).select(feature)


def boilerplate_titles(documents: DataFrame, host: str = "domain", title: str = "title", repeats: int = 10) -> DataFrame:
    """``documents`` that have a title which their host repeats ``repeats`` times or more."""
    n = F.count("*").over(W.partitionBy(host, title))
    return documents.where(F.col(title).isNotNull()).withColumn("_n", n).where(F.col("_n") >= repeats).drop("_n")


def country_resolved(documents: DataFrame, least: float = 0.5) -> DataFrame:
    return documents.where(F.col("publisher_country").isNotNull() & (F.col("publisher_country_confidence") >= least))


def retained(events: DataFrame, documents: int = 30, reports: int = 5, confidence: float = 0.5) -> DataFrame:
    """Large, independently reported and coherent events; without a confidence none is kept."""
    return events.where((F.col("raw_documents") >= documents) & (F.col("effective_reports") >= reports) & (F.col("cluster_confidence") >= confidence))


def audit(df: DataFrame) -> DataFrame:
    """(column, rows, nulls, null_rate, distinct): one pass over all columns."""
    cols = df.columns
    counts = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)], *[F.count_distinct(c).alias(f"d{i}") for i, c in enumerate(cols)])
    per = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls"), F.col(f"d{i}").alias("distinct")) for i, c in enumerate(cols)]))
    return counts.select("rows", per.alias("x")).select("x.column", "rows", "x.nulls", (F.col("x.nulls") / F.greatest(F.col("rows"), F.lit(1))).alias("null_rate"), "x.distinct")
