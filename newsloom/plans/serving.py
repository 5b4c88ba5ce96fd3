"""Questions to the attention store: search, events, families, spread, timelines, evidence."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.core import empty_if_null
from newsloom.functions.text import fold, token_match
from newsloom.operators import responses
from newsloom.operators.ranking import first_per_key, page

EVENT_SORTS = {
    "effective_reports": ("effective_reports", True), "raw_documents": ("raw_documents", True),
    "publisher_countries": ("publisher_country_count", True), "start": ("start_time", False),
}
SPREAD_COLUMNS = [
    "document_id", "macro_event_id", "url", "title", "language", "source_domain", "publisher_country", "publisher_country_confidence", "observed_time", "assignment_score", "wire_group",
]


class NotFound(LookupError):
    """Nothing has this id."""


def folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def search_text() -> Column:
    lists = [F.array_join(empty_if_null(F.col(c)), " ") for c in ("people", "organizations", "actors")]
    return fold(F.concat_ws(" ", "title", "label", *lists))


def all_tokens(query: str, column: Column) -> Column | None:
    tokens = folded(query).split()
    return reduce(lambda a, b: a & b, (token_match(column, t) for t in tokens)) if tokens else None


class AttentionStore:
    """Served tables. Opening one reads nothing; the folded search texts are columns."""

    def __init__(self, tables: dict[str, DataFrame]) -> None:
        self.t = tables
        self.events = tables["macro_events"].withColumn("search_text", search_text())
        self.documents = tables["macro_event_documents"]
        self.titles = self.documents.where("is_primary and macro_event_id >= 0 and title is not null").select("macro_event_id", fold(F.col("title")).alias("search_text"))

    @classmethod
    def open(cls, spark: SparkSession, directory: str) -> AttentionStore:
        names = ["macro_events", "event_families", "macro_event_documents", "country_baseline", "document_evidence"]
        names += [f"country_{level}_{kind}" for level in ("event", "family") for kind in ("attention", "summary")]
        return cls({n: spark.read.parquet(f"{directory}/{n}.parquet") for n in names})

    # -- search -------------------------------------------------------------------
    def search(self, query: str) -> DataFrame:
        """Events whose summary or a member title holds every token, with ``title_hits``."""
        test = all_tokens(query, F.col("search_text"))
        if test is None:
            return self.events.limit(0).withColumn("title_hits", F.lit(0))
        hits = self.titles.where(test).groupBy("macro_event_id").agg(F.count("*").alias("title_hits"))
        found = self.events.join(hits, "macro_event_id", "left").fillna(0, ["title_hits"]).where(test | (F.col("title_hits") > 0))
        return found.orderBy(F.desc("title_hits"), F.desc("publisher_country_count"), F.desc("effective_reports"), "macro_event_id")

    def search_families(self, query: str) -> DataFrame:
        hits = self.search(query).groupBy("family_id").agg(F.sum("title_hits").alias("title_hits"))
        return self.t["event_families"].join(hits, "family_id").drop("macro_event_ids").orderBy(
            F.desc("title_hits"), F.desc("publisher_country_count"), F.desc("effective_reports"), "family_id"
        )

    # -- events -------------------------------------------------------------------
    def matching(self, query: str | None = None, kind: str | None = None, country: str | None = None, family: int | None = None) -> DataFrame:
        """All events that fit a search, a type, a country and a family, where these are given."""
        out = self.search(query) if query else self.events
        if kind:
            out = out.where(F.array_contains("event_types", kind))
        if country:
            out = out.where(F.col("event_country") == country.upper())
        if family is not None:
            out = out.where(F.col("family_id") == family)
        return out

    def list_events(self, query: str | None = None, kind: str | None = None, country: str | None = None, family: int | None = None, sort: str = "effective_reports", limit: int = 100, offset: int = 0) -> DataFrame:
        column, down = EVENT_SORTS[sort]
        return page(self.matching(query, kind, country, family), [F.desc(column) if down else F.asc(column), "macro_event_id"], offset, limit)

    def event(self, event: int) -> DataFrame:
        return self._one(self.events.where(F.col("macro_event_id") == event), f"event {event}")

    def family(self, family: int) -> DataFrame:
        return self._one(self.t["event_families"].where(F.col("family_id") == family), f"family {family}")

    @staticmethod
    def _one(rows: DataFrame, what: str) -> DataFrame:
        if rows.isEmpty():
            raise NotFound(f"{what} is not in the store")
        return rows

    def samples(self, event: int, n: int = 10) -> DataFrame:
        """One document a report, the earliest first."""
        docs = self.documents.where((F.col("macro_event_id") == event) & F.col("is_primary"))
        return first_per_key(docs, ["wire_group"], ["observed_time", "document_id"]).orderBy("observed_time", "document_id").limit(n)

    def languages(self, event: int) -> DataFrame:
        docs = self.documents.where((F.col("macro_event_id") == event) & F.col("is_primary"))
        return docs.groupBy("language").agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "language")

    # -- spread, timelines, countries, for an event or a family ---------------------
    def _documents(self, event: int | None, family: int | None) -> DataFrame:
        docs = self.documents.where("is_primary")
        if family is None:
            return docs.where(F.col("macro_event_id") == event)
        own = self.events.where(F.col("family_id") == family).select("macro_event_id")
        return docs.join(own, "macro_event_id", "left_semi")

    def spread(self, event: int | None = None, family: int | None = None, confidence: float = 0.0, offset: int = 0, limit: int = 500) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(a page of documents in time order, countries, one row of totals)."""
        return spread(self._documents(event, family), confidence, offset, limit)

    def timeline(self, event: int | None = None, family: int | None = None, countries: str | None = None, value: str = "raw_documents") -> tuple[DataFrame, DataFrame]:
        key, table = ("macro_event_id", "event") if family is None else ("family_id", "family")
        rows = self.t[f"country_{table}_attention"].where(F.col(key) == (event if family is None else family))
        return timeline(rows, code_list(countries), value)

    def countries(self, event: int | None = None, family: int | None = None, least_domains: int = 1, suppressed: bool = True) -> DataFrame:
        key, table = ("macro_event_id", "event") if family is None else ("family_id", "family")
        rows = self.t[f"country_{table}_summary"].where((F.col(key) == (event if family is None else family)) & (F.col("unique_domains") >= least_domains))
        return (rows if suppressed else rows.where(~F.col("suppressed"))).orderBy(F.desc("raw_documents"), "publisher_country")

    # -- types, baselines, evidence ---------------------------------------------------
    def types(self) -> DataFrame:
        return type_list(self.events)

    def type_countries(self, kind: str, least_events: int = 3, least_documents: int = 1000) -> DataFrame:
        own = self.events.where(F.array_contains("event_types", kind)).select("macro_event_id")
        return type_countries(self.t["country_event_summary"].join(own, "macro_event_id", "left_semi"), least_events, least_documents)

    def baseline(self) -> DataFrame:
        return self.t["country_baseline"].orderBy(F.desc("country_documents"), "publisher_country")

    def country_name(self, codes: DataFrame, code: str) -> DataFrame:
        names = self.t["country_baseline"].select(F.col("publisher_country").alias(code), "country_name")
        return codes.join(names, code, "left").withColumn("country_name", F.coalesce(F.nullif("country_name", F.lit("")), code))

    def evidence(self, document: int) -> tuple[DataFrame, DataFrame]:
        """(edges with their neighbours, one row of checks) of a document."""
        own = self._one(self.documents.where((F.col("document_id") == document) & F.col("is_primary")), f"document {document}")
        near = self.documents.where("is_primary").select(
            F.col("document_id").alias("neighbor_document_id"), "macro_event_id", "title", "language", "source_domain", "publisher_country", "observed_time"
        )
        here = own.select(F.col("publisher_country").alias("own_country"))
        edges = self.t["document_evidence"].where(F.col("document_id") == document).join(near, "neighbor_document_id", "left").join(here)
        edges = edges.withColumn("same_publisher_country", F.col("publisher_country") == F.col("own_country"))
        inside = edges.where("same_incident")
        no = F.lit(False)
        checks = inside.agg(
            F.max("title_score").alias("title_similarity"), *[F.coalesce(F.bool_or(F.col(f"{c}_score") > 0), no).alias(a) for c, a in (("event", "shared_event"), ("url", "shared_url_tokens"), ("entity", "shared_entities"))],
            F.min("delta_hours").alias("hours_to_nearest_support"), F.coalesce(F.bool_or(~F.col("same_publisher_country")), no).alias("other_publisher_country"),
        )
        return edges.orderBy(F.desc("same_incident"), "rank"), checks


def code_list(value: str | list[str] | None) -> list[str]:
    """Codes given once or several times, or with commas, in upper case, each once."""
    parts = [value] if isinstance(value, str) else value or []
    return list(dict.fromkeys(c.strip().upper() for p in parts for c in p.split(",") if c.strip()))


def spread(documents: DataFrame, confidence: float = 0.0, offset: int = 0, limit: int = 500) -> tuple[DataFrame, DataFrame, DataFrame]:
    fits = F.col("publisher_country").isNotNull() & (F.col("publisher_country_confidence") >= confidence)
    kept = documents.where(fits)
    by_country = kept.groupBy("publisher_country").agg(
        F.count("*").alias("raw_documents"), F.count_distinct("wire_group").alias("effective_reports"), F.min("observed_time").alias("first_seen")
    ).orderBy("first_seen", "publisher_country")
    totals = documents.agg(F.count_if(fits).alias("total"), F.count_if(~F.coalesce(fits, F.lit(False))).alias("excluded_documents"))
    return page(kept, ["observed_time", "document_id"], offset, limit), by_country, totals


def timeline(rows: DataFrame, countries: list[str], value: str = "raw_documents") -> tuple[DataFrame, DataFrame]:
    """(world: sums an hour; series: arrays by hour for each country, largest first)."""
    own = rows.where(F.col("publisher_country").isin(*countries)) if countries else rows
    steps = F.array_sort(F.collect_list(F.struct("time_bucket", F.col(value).alias("value"), "cumulative_documents", "onset_flag")))
    series = own.groupBy("publisher_country").agg(steps.alias("s"), F.sum("raw_documents").alias("total_documents")).select(
        "publisher_country", F.col("s.time_bucket").alias("time_bucket"), F.col("s.value").alias("values"), F.col("s.cumulative_documents").alias("cumulative_documents"),
        F.col("s.onset_flag").alias("onset_flag"), "total_documents",
    )
    world = own.groupBy("time_bucket").agg(*[F.sum(c).alias(c) for c in ("raw_documents", "unique_domains", "effective_reports")]).orderBy("time_bucket")
    return world, series.orderBy(F.desc("total_documents"), "publisher_country")


def type_list(events: DataFrame) -> DataFrame:
    typed = events.select(F.explode("event_types").alias("type"), "raw_documents").where("type is not null")
    return typed.groupBy("type").agg(F.count("*").alias("events"), F.sum("raw_documents").alias("raw_documents")).orderBy(F.desc("events"), "type")


def type_countries(summary: DataFrame, least_events: int = 3, least_documents: int = 1000) -> DataFrame:
    """Per country: mean ratio, median lag and share of its output, above the floors."""
    out = summary.groupBy("publisher_country").agg(
        F.count("*").alias("events"), F.sum("raw_documents").alias("raw_documents"), F.sum("effective_reports").alias("effective_reports"), F.max("country_documents").alias("country_documents"),
        F.avg("attention_ratio").alias("mean_attention_ratio"), F.median("lag_hours").alias("median_lag_hours"), F.count("lag_hours").alias("events_with_onset"),
    )
    kept = out.where((F.col("events") >= least_events) & (F.col("country_documents") >= least_documents))
    return kept.withColumn("share_of_country_output", F.col("raw_documents") / F.col("country_documents")).orderBy(F.desc("mean_attention_ratio"), "publisher_country")


class Analytics:
    """Country-response questions over observations."""

    MATRIX_SIDE = 25

    def __init__(self, observations: DataFrame, support: responses.Support = responses.Support()) -> None:
        self.observations, self.support = observations, support

    def selected(self, f: responses.Filters) -> DataFrame:
        return responses.apply_filters(self.observations, f)

    def pair(self, f: responses.Filters, origin: str, destination: str) -> DataFrame:
        rows = self.selected(f).where((F.col("origin_country") == origin) & (F.col("destination_country") == destination))
        return responses.domestic(rows) if origin == destination else rows

    def pair_summary(self, f: responses.Filters, origin: str, destination: str) -> DataFrame:
        return responses.summarize(self.pair(f, origin, destination), ["origin_country", "destination_country"], self.support, bootstrap=True)

    def by_destination(self, f: responses.Filters, origin: str) -> DataFrame:
        rows = responses.foreign(self.selected(f).where(F.col("origin_country") == origin))
        return responses.by_most_covered(responses.summarize(rows, ["destination_country"], self.support, bootstrap=True), "destination_country")

    def by_origin(self, f: responses.Filters, destination: str) -> DataFrame:
        rows = responses.foreign(self.selected(f).where(F.col("destination_country") == destination))
        return responses.by_most_covered(responses.summarize(rows, ["origin_country"], self.support, bootstrap=True), "origin_country")

    def countries(self, f: responses.Filters) -> DataFrame:
        """Every country's domestic response, as origin and destination of the same events."""
        return responses.by_most_covered(responses.summarize(responses.domestic(self.selected(f)), ["origin_country"], self.support), "origin_country")

    def country(self, f: responses.Filters, code: str) -> dict[str, DataFrame]:
        rows = self.selected(f)
        home = responses.domestic(rows.where(F.col("origin_country") == code))
        return {
            "domestic": responses.summarize(home, ["origin_country"], self.support, bootstrap=True), "domestic_by_type": responses.summarize_by_type(home, self.support),
            "domestic_by_magnitude": responses.summarize_by_magnitude(home, self.support), "destinations": self.by_destination(f, code), "origins": self.by_origin(f, code),
        }

    def matrix(self, f: responses.Filters, origins: list[str], destinations: list[str]) -> DataFrame:
        if max(len(origins), len(destinations)) > self.MATRIX_SIDE:
            raise ValueError(f"a matrix has {self.MATRIX_SIDE} countries a side at most")
        return responses.pair_matrix(self.selected(f), origins, destinations, self.support)

    def events(self, f: responses.Filters, origin: str, destination: str, limit: int = 100) -> DataFrame:
        return responses.event_records(self.pair(f, origin, destination), limit)
