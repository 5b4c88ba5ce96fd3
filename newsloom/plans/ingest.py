"""Typed tables from raw ones: mentions, events, graph records, sources."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.functions.fixed import EVENT_COLUMNS, EVENT_FLOATS, EVENT_INTS, MENTION_COLUMNS, MENTION_INTS
from newsloom.functions.times import to_utc
from newsloom.functions.urls import canonical_url, fips_of_tld, parent_domains, url_domain
from newsloom.operators.ranking import first_per_key, mode_per_key
from newsloom.sources import raw

# -- fixed values: how a domain's country was found, and how sure that is --------------
EXACT, PARENT, ENDING, UNRESOLVED = ("gdelt_lookup", 0.9), ("gdelt_lookup_parent", 0.7), ("cctld", 0.5), ("unresolved", 0.0)


def _typed(rows: DataFrame, ints: list[str], floats: list[str], times: list[str]) -> list[Column]:
    """Lenient casts: what can't be read is null, also numbers with blanks around them."""

    def cast(c: str) -> Column:
        if c in times:
            return to_utc(F.col(c)).alias(c)
        kind = "bigint" if c in ints else "double" if c in floats else None
        return F.when(F.col(c) == F.trim(c), F.col(c)).try_cast(kind).alias(c) if kind else F.col(c)

    return [cast(c) for c in rows.columns]


def translated() -> Column:
    return F.contains("source_file", F.lit("translation")).alias("translated")


def typed_mentions(rows: DataFrame) -> DataFrame:
    return rows.drop("Extras").select(
        *_typed(rows.drop("Extras"), MENTION_INTS, ["MentionDocTone"], ["EventTimeDate", "MentionTimeDate"]),
        canonical_url(F.col("MentionIdentifier")).alias("canonical_url"), url_domain(F.col("MentionIdentifier")).alias("domain"), translated(),
        text.source_language_code(F.col("MentionDocTranslationInfo")).alias("source_language"),
    )


def typed_events(rows: DataFrame) -> DataFrame:
    return rows.select(*_typed(rows, EVENT_INTS, EVENT_FLOATS, ["DATEADDED"]), canonical_url(F.col("SOURCEURL")).alias("canonical_url"), translated())


def typed_gkg(rows: DataFrame) -> DataFrame:
    tone = F.col("V2Tone")
    typed = rows.select(
        "GKGRecordID", to_utc(F.col("Date")).alias("gkg_time"), F.col("SourceCollectionIdentifier").try_cast("bigint").alias("SourceCollectionIdentifier"),
        "SourceCommonName", "DocumentIdentifier", *[text.split_list(F.col(c.title())).alias(c) for c in ("themes", "persons", "organizations")],
        text.parse_locations(F.col("V2Locations")).alias("locations"),
        *[text.tone_part(tone, i).alias(c) for i, c in enumerate(("tone", "positive", "negative", "polarity"))], text.tone_part(tone, 6, "bigint").alias("word_count"),
        text.source_language_code(F.col("TranslationInfo")).alias("source_language"), text.page_title(F.col("Extras")).alias("page_title"), translated(),
        canonical_url(F.col("DocumentIdentifier")).alias("canonical_url"), url_domain(F.col("DocumentIdentifier")).alias("domain"), "source_file",
    )
    return earliest(typed)


def earliest(gkg: DataFrame) -> DataFrame:
    """One record a page: the earliest, the untranslated of several."""
    return first_per_key(gkg, ["canonical_url"], [F.col("gkg_time").asc_nulls_first(), "translated", "source_file", "GKGRecordID"])


TYPERS = {"mentions": typed_mentions, "events": typed_events, "gkg": typed_gkg}


def load_table(spark: SparkSession, table: str, directory: str, start: datetime, end: datetime, allow_partial: bool = False) -> tuple[DataFrame, DataFrame, list[str]]:
    """(typed rows, audit a file, missing files) of a window."""
    rows, audit, gaps = raw.load_strings(spark, table, directory, start, end, allow_partial)
    return TYPERS[table](rows), audit, gaps


def resolve_countries(domains: DataFrame, lookup: DataFrame, domain: str = "domain") -> DataFrame:
    """``domains`` with publisher_country, country_confidence, mapping_method: the listed
    domain, else its nearest listed parent, else the national ending."""
    labelled = domains.select(domain).distinct().select(domain, F.posexplode(parent_domains(F.col(domain))).alias("up", "name"))
    known = lookup.select(F.col("domain").alias("name"), F.col("country").alias("listed"))
    found = labelled.join(known, "name").groupBy(domain).agg(F.min(F.struct("up", "listed")).alias("hit"))
    up, ending = F.col("hit.up"), fips_of_tld(F.col(domain))
    listed = F.col("hit").isNotNull()

    def ladder(i: int) -> Column:
        a, b, c, d = (F.lit(x[i]) for x in (EXACT, PARENT, ENDING, UNRESOLVED))
        return F.when(up == 0, a).when(up > 0, b).when(ending.isNotNull(), c).otherwise(d)

    return domains.join(found, domain, "left").select(
        *[F.col(c) for c in domains.columns], F.when(listed, F.col("hit.listed")).otherwise(ending).alias("publisher_country"),
        ladder(1).alias("country_confidence"), ladder(0).alias("mapping_method"),
    )


def build_sources(mentions: DataFrame, gkg: DataFrame, lookup: DataFrame) -> DataFrame:
    """(domain, publisher_name, publisher_country, country_confidence, mapping_method)."""
    names = mentions.select("domain", F.col("MentionSourceName").alias("publisher_name")).unionByName(gkg.select("domain", F.col("SourceCommonName").alias("publisher_name")))
    return resolve_countries(mode_per_key(names.where("domain <> ''"), ["domain"], "publisher_name", "publisher_name"), lookup)


def strict_mentions(rows: DataFrame) -> DataFrame:
    """Typed mentions or an error: ids, times, types and confidences must be there and in range."""
    kinds = {**dict.fromkeys(MENTION_INTS, "bigint"), "MentionDocTone": "double"}
    typed = rows.select(*[
        F.to_timestamp(c, "yyyyMMddHHmmss").alias(c) if c in ("EventTimeDate", "MentionTimeDate") else F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c)
        for c in rows.columns
    ])
    needed = ["GlobalEventID", "EventTimeDate", "MentionTimeDate", "MentionType", "Confidence"]
    fine = sum((F.col(c).isNull().cast("int") for c in needed), F.lit(0)) == 0
    fine = fine & F.col("Confidence").between(10, 100) & (F.col("GlobalEventID") > 0)
    ok = F.when(F.coalesce(fine, F.lit(False)), F.col("GlobalEventID")).otherwise(F.raise_error(F.lit("a mention is incomplete or out of range")).cast("bigint"))
    return typed.withColumn("GlobalEventID", ok)


def mention_audit(mentions: DataFrame) -> dict[str, DataFrame]:
    """Tables of types and languages, events with several times, and the spread of confidence."""
    times = mentions.groupBy("GlobalEventID").agg(F.count_distinct("EventTimeDate").alias("times")).where("times > 1")
    return {
        "types": mentions.groupBy("MentionType").count(), "languages": mentions.groupBy(text.source_language_code(F.col("MentionDocTranslationInfo")).alias("language")).count(),
        "inconsistent_events": times, "confidence": mentions.select("Confidence").summary(),
    }


def event_labels(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Actors, code and place of each event: its first row in file order."""
    columns = ["GlobalEventID", "Actor1Name", "Actor2Name", "EventRootCode", "ActionGeo_FullName"]
    if not paths:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    rows, _ = raw.read_raw(spark, paths, EVENT_COLUMNS, columns)
    return first_per_key(rows.withColumn("_n", F.monotonically_increasing_id()), ["GlobalEventID"], ["source_file", "_n"]).select(*columns)


def preprocess_summary(mentions: DataFrame, events: DataFrame, gkg: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """One-row aggregates of each clean table, and the count of each mapping method."""
    return {
        "mentions": mentions.agg(F.count("*").alias("rows"), F.count_distinct("canonical_url").alias("urls"), F.min("MentionTimeDate").alias("first"), F.max("MentionTimeDate").alias("last"), F.count_if(F.col("GlobalEventID").isNull()).alias("null_ids")),
        "events": events.agg(F.count("*").alias("rows"), F.count_distinct("GlobalEventID").alias("events")),
        "gkg": gkg.agg(F.count("*").alias("rows"), F.count("page_title").alias("titles"), F.count_distinct("domain").alias("domains"), F.count_distinct("source_language").alias("languages")),
        "sources": sources.groupBy("mapping_method").agg(F.count("*").alias("domains")),
    }


def empty_raw(spark: SparkSession, table: str) -> DataFrame:
    columns = {"mentions": MENTION_COLUMNS, "events": EVENT_COLUMNS}.get(table) or raw.COLUMNS[table]
    return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in [*columns, "source_file"]))
