"""Onset, hourly attention, shares and coherence of groups of documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.core import empty_if_null
from newsloom.functions.fixed import CAMEO_ROOT_TYPES, THEME_TYPES
from newsloom.functions.core import lookup
from newsloom.functions.times import hour, hours_between
from newsloom.operators.ranking import gathered, top_list, top_per_key

OUTLETS = 3
QUANTILE = 0.1


def higher_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, alias: str) -> DataFrame:
    """Per group the value at rank ceil(q (n - 1)): the quantile that rounds up to a real one.

    Values are counted before they are ranked, so a group costs as many rows as it has
    different values (hours, say), not documents.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    up_to = F.sum("_n").over(W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("_n").over(W.partitionBy(*keys))
    reached = counts.select(*keys, value, up_to.alias("_c"), total.alias("_t")).where(F.col("_c") >= F.ceil(F.lit(q) * (F.col("_t") - 1)) + 1)
    return reached.groupBy(*keys).agg(F.min(value).alias(alias))


def onset(documents: DataFrame, keys: Sequence[str], at: str = "observed_time", outlet: str = "source_domain", outlets: int = OUTLETS, q: float = QUANTILE) -> DataFrame:
    """(keys, third_source_seen, p10_seen, onset): the later of the hour in which the third
    outlet appears and the hour that brings a tenth of the documents. Groups with fewer
    outlets have no row."""
    hourly = documents.select(*keys, F.col(outlet).alias("_outlet"), hour(F.col(at)).alias("time_bucket"))
    firsts = hourly.groupBy(*keys, "_outlet").agg(F.min("time_bucket").alias("third_source_seen"))
    third = top_per_key(firsts, keys, ["third_source_seen", "_outlet"], outlets, "_k").where(F.col("_k") == outlets).select(*keys, "third_source_seen")
    return third.join(higher_quantile(hourly, keys, "time_bucket", q, "p10_seen"), list(keys)).withColumn("onset", F.greatest("third_source_seen", "p10_seen"))


def hourly_attention(documents: DataFrame, keys: Sequence[str], at: str = "observed_time", outlet: str = "source_domain", report: str = "wire_group") -> DataFrame:
    """Documents, outlets and independent reports an hour, with running totals."""
    running = F.sum("raw_documents").over(W.partitionBy(*keys).orderBy("time_bucket").rowsBetween(W.unboundedPreceding, 0))
    return (
        documents.withColumn("time_bucket", hour(F.col(at))).groupBy(*keys, "time_bucket")
        .agg(F.count("*").alias("raw_documents"), F.count_distinct(outlet).alias("unique_domains"), F.count_distinct(report).alias("effective_reports"))
        .withColumn("cumulative_documents", running)
    )


def country_baseline(documents: DataFrame) -> DataFrame:
    """Each publisher country's documents, outlets and independent reports: the denominators."""
    return documents.groupBy("publisher_country").agg(
        F.count("*").alias("country_documents"), F.count_distinct("domain").alias("country_domains"), F.count_distinct("wire_group").alias("country_effective_reports")
    )


def country_centroids(gkg: DataFrame) -> DataFrame:
    """Median coordinates of the country-level places mentioned."""
    return (
        gkg.select(F.explode("locations").alias("l")).where("l.geo_type = 1 and l.country_code is not null")
        .groupBy(F.col("l.country_code").alias("publisher_country")).agg(F.median("l.lat").alias("lat"), F.median("l.lon").alias("lon"))
    )


def country_tables(documents: DataFrame, baseline: DataFrame, world_documents: int, world_reports: int, key: str = "macro_event_id") -> tuple[DataFrame, DataFrame]:
    """(hourly, summary) by ``key`` and publisher country."""
    keys = [key, "publisher_country"]
    outlets = onset(documents, keys).select(*keys, "onset")
    sizes = baseline.select("publisher_country", "country_documents", "country_effective_reports")
    hourly = (
        hourly_attention(documents, keys).join(sizes, "publisher_country")
        .withColumn("raw_share", F.col("raw_documents") / F.col("country_documents"))
        .join(outlets, keys, "left")
        .withColumn("onset_flag", F.coalesce(F.col("time_bucket") == F.col("onset"), F.lit(False)))
        .select(*keys, "time_bucket", "raw_documents", "unique_domains", "effective_reports", "cumulative_documents", "raw_share", "onset_flag")
    )
    totals = documents.groupBy(key).agg(F.count("*").alias("event_documents"), F.count_distinct("wire_group").alias("event_effective_reports"))
    world = onset(documents, [key]).select(key, F.col("onset").alias("world_onset"))
    summary = (
        documents.groupBy(*keys)
        .agg(
            F.count("*").alias("raw_documents"), F.count_distinct("source_domain").alias("unique_domains"), F.count_distinct("wire_group").alias("effective_reports"),
            F.min("observed_time").alias("first_seen"), F.max("observed_time").alias("last_seen"),
        )
        .join(sizes, "publisher_country").join(totals, key).join(outlets, keys, "left").join(world, key, "left")
        .withColumn("raw_share", F.col("raw_documents") / F.col("country_documents"))
        .withColumn("effective_share", F.col("effective_reports") / F.col("country_effective_reports"))
        .withColumn("world_raw_share", F.col("event_documents") / F.lit(world_documents))
        .withColumn("world_effective_share", F.col("event_effective_reports") / F.lit(world_reports))
        .withColumn("attention_ratio", F.col("effective_share") / F.col("world_effective_share"))
        .withColumn("lag_hours", hours_between(F.col("onset"), F.col("world_onset")))
        .withColumn("suppressed", F.col("unique_domains") < OUTLETS)
    )
    return hourly, summary


def entity_coherence(members: DataFrame, k: int = 3, cluster: str = "cluster", document: str = "document_id", entities: Column | None = None) -> DataFrame:
    """Share of a cluster's documents that mention any of its ``k`` most frequent entities."""
    named = F.concat(empty_if_null(F.col("persons")), empty_if_null(F.col("organizations"))) if entities is None else entities
    rows = members.select(cluster, document, F.explode(named).alias("entity")).where("entity is not null").distinct()
    counted = rows.groupBy(cluster, "entity").agg(F.count("*").alias("n"))
    top = top_per_key(counted, [cluster], [F.desc("n"), "entity"], k).select(cluster, "entity")
    covered = rows.join(top, [cluster, "entity"]).groupBy(cluster).agg(F.count_distinct(document).alias("c"))
    sizes = members.groupBy(cluster).agg(F.count("*").alias("n"))
    return covered.join(sizes, cluster, "right").select(cluster, (F.coalesce("c", F.lit(0)) / F.col("n")).alias("entity_coherence"))


def event_types(members: DataFrame, links: DataFrame, theme_share: float = 0.3, code_share: float = 0.5, k: int = 3) -> DataFrame:
    """(cluster, event_types, event_type_shares): types that enough of the documents show,
    by their themes or by their events' codes.

    A document's themes turn into types inside its row, so only (cluster, document, type)
    is shuffled, not themes.
    """
    hits = lambda t: F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(name)) for name, p in THEME_TYPES]))
    themed = members.select("cluster", "document_id", F.explode(F.array_distinct(F.flatten(F.transform("themes", hits)))).alias("type"))
    coded = links.select("cluster", "document_id", lookup(CAMEO_ROOT_TYPES, F.col("EventRootCode")).alias("type")).where("type is not null")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"))

    def shares(rows: DataFrame, least: float) -> DataFrame:
        counted = rows.distinct().groupBy("cluster", "type").agg(F.count("*").alias("c")).join(sizes, "cluster")
        return counted.select("cluster", "type", (F.col("c") / F.col("n")).alias("share")).where(F.col("share") >= least)

    best = shares(themed, theme_share).unionByName(shares(coded, code_share)).groupBy("cluster", "type").agg(F.max("share").alias("share"))
    ranked = top_per_key(best, ["cluster"], [F.desc("share"), "type"], k, "r")
    pairs = gathered(ranked, ["cluster"], F.struct("type", "share"), "pairs")
    return pairs.select("cluster", F.col("pairs.type").alias("event_types"), F.col("pairs.share").alias("event_type_shares"))


__all__ = [
    "country_baseline", "country_centroids", "country_tables", "entity_coherence", "event_types", "higher_quantile", "hourly_attention", "onset", "top_list",
]
