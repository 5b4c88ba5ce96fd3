"""The attention store: macro events, families, country tables and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.core import empty_if_null
from newsloom.functions.fixed import LABEL_STOP
from newsloom.functions.urls import clean_token, url_words
from newsloom.operators import attention, families, filters, partition, vectors
from newsloom.operators.ranking import dense_ids, gathered, mode_per_key, top_list, top_per_key
from newsloom.plans.cutpoint import materialize

EVIDENCE = ["title_score", "event_score", "url_score", "entity_score", "delta_hours", "evidence_channels", "gated"]


def labels(members: DataFrame, k: int = 5, cluster: str = "cluster", url: str = "canonical_url") -> DataFrame:
    """(cluster, label): the ``k`` words most frequent over the members' addresses."""
    path = F.regexp_replace(url, r"^https?://[^/]+", "")
    words = F.filter(url_words(path), lambda w: clean_token(w) & ~w.isin(*LABEL_STOP) & ~w.rlike(r"^\p{Nd}+$"))
    counted = members.select(cluster, F.explode(words).alias("w")).groupBy(cluster, "w").agg(F.count("*").alias("n"))
    lists = gathered(top_per_key(counted, [cluster], [F.desc("n"), "w"], k, "r"), [cluster], F.col("w"), "words")
    return lists.select(cluster, F.array_join("words", " ").alias("label"))


def dominant_place(links: DataFrame) -> DataFrame:
    """(cluster, event_country, lat, lon): the most frequent country, at its median coordinates."""
    per = links.where("ActionGeo_CountryCode is not null").groupBy("cluster", "ActionGeo_CountryCode").agg(
        F.count("*").alias("n"), F.median("ActionGeo_Lat").alias("lat"), F.median("ActionGeo_Long").alias("lon")
    )
    return top_per_key(per, ["cluster"], [F.desc("n"), "ActionGeo_CountryCode"]).select("cluster", F.col("ActionGeo_CountryCode").alias("event_country"), "lat", "lon")


def macro_events(members: DataFrame, links: DataFrame, model: str, least: tuple[int, int, float] = (30, 5, 0.5)) -> DataFrame:
    """Retained incidents with all measures. ``members``: documents with cluster, family_id
    and, if there are any, vectors; ``links``: their events with codes, actors and places."""
    assigned = members.where("cluster >= 0")
    base = assigned.groupBy("cluster").agg(
        F.min("family_id").alias("family_id"), F.min("first_seen").alias("start_time"), F.max("last_seen").alias("end_time"), F.count("*").alias("raw_documents"),
        F.count_distinct("domain").alias("unique_domains"), F.count_distinct("wire_group").alias("effective_reports"), F.count_distinct("publisher_country").alias("publisher_country_count"),
        F.count_distinct("language").alias("language_count"), F.count("title").alias("titled_documents"),
    )
    if "vector" in members.columns:
        titles = vectors.title_coherence(assigned)
    else:
        titles = base.select("cluster", F.lit(None).cast("double").alias("title_coherence"), F.lit(None).cast("string").alias("title"))
    actors = links.select("cluster", F.array_compact(F.array("Actor1Name", "Actor2Name")).alias("actors"))
    sides = [
        links.groupBy("cluster").agg(F.count_distinct("GlobalEventID").alias("atomic_event_count")),
        top_list(assigned, "cluster", "persons", 5, "people"), top_list(assigned, "cluster", "organizations", 5), top_list(assigned, "cluster", "themes", 8),
        attention.entity_coherence(assigned), titles, attention.event_types(assigned, links), dominant_place(links), top_list(actors, "cluster", "actors", 5), labels(assigned),
    ]
    out = base
    for side in sides:
        out = out.join(side, "cluster", "left")
    filled = out.withColumns(
        {c: empty_if_null(F.col(c)) for c in ("event_types", "actors", "people", "organizations", "themes")}
        | {"event_type_shares": empty_if_null(F.col("event_type_shares"), "array<double>"), "atomic_event_count": F.coalesce("atomic_event_count", F.lit(0)), "label": F.coalesce("label", F.lit(""))}
    ).withColumn("cluster_confidence", F.coalesce("title_coherence", "entity_coherence")).withColumn("resolution_model", F.lit(model))
    kept = filters.retained(filled, *least)
    return dense_ids(kept.withColumnRenamed("cluster", "incident_id"), [F.desc("effective_reports"), F.desc("raw_documents"), "incident_id"], "macro_event_id")


def event_documents(documents: DataFrame, membership: DataFrame, events: DataFrame, links: DataFrame) -> DataFrame:
    """Every membership of every document; -1 where its incident isn't a macro event."""
    first = top_per_key(links, ["document_id"], [F.col("confidence").desc_nulls_first(), "GlobalEventID"]).select(
        "document_id", "GlobalEventID", "confidence", "in_raw_text"
    )
    return (
        membership.join(events.select("incident_id", "macro_event_id"), "incident_id", "left").join(documents, "document_id").join(first, "document_id", "left")
        .select(
            F.coalesce("macro_event_id", F.lit(-1)).alias("macro_event_id"), "document_id", "incident_id", "family_id", "assignment_score", "is_primary", "GlobalEventID",
            F.col("canonical_url").alias("url"), "title", "language", F.col("domain").alias("source_domain"), "publisher_country", "publisher_country_confidence",
            F.col("first_seen").alias("observed_time"), "confidence", "in_raw_text", "wire_group",
        )
    )


def build_store(
    documents: DataFrame, links: DataFrame, atomic: DataFrame, membership: DataFrame, gkg: DataFrame, sources: DataFrame, pairs: DataFrame,
    vectors_table: DataFrame | None = None, names: DataFrame | None = None, model: str = "title_graph_v1", least: tuple[int, int, float] = (30, 5, 0.5), country_least: float = 0.5,
) -> dict[str, DataFrame]:
    """All tables that are served."""
    primary = membership.where("is_primary").select("document_id", F.col("incident_id").alias("cluster"), "family_id", "assignment_score")
    members = documents.join(primary, "document_id")
    if vectors_table is not None:
        members = members.join(vectors_table.select("document_id", F.col("vector").cast("array<double>").alias("vector")), "document_id", "left")
    places = ["GlobalEventID", "EventRootCode", "ActionGeo_CountryCode", "ActionGeo_Lat", "ActionGeo_Long", "Actor1Name", "Actor2Name"]
    coded = links.join(primary.select("document_id", "cluster"), "document_id").where("cluster >= 0").join(atomic.select(*places), "GlobalEventID", "left")
    events = materialize(macro_events(members, coded, model, least), "macro-events")
    of = materialize(event_documents(documents, membership, events, links), "event-documents")
    resolved = filters.country_resolved(documents, country_least)
    baseline = attention.country_baseline(resolved).join(attention.country_centroids(gkg), "publisher_country", "left")
    if names is not None:
        baseline = baseline.join(mode_per_key(names.withColumnRenamed("country", "publisher_country"), ["publisher_country"], "name", "country_name"), "publisher_country", "left")
    else:
        baseline = baseline.withColumn("country_name", F.lit(None).cast("string"))
    world = resolved.agg(F.count("*").alias("d"), F.count_distinct("wire_group").alias("r")).first()
    counted = filters.country_resolved(of.where("is_primary and macro_event_id >= 0"), country_least)
    out = {"macro_events": events, "event_families": families.rollup(events), "macro_event_documents": of, "country_baseline": baseline, "sources": sources}
    for key, name in (("macro_event_id", "event"), ("family_id", "family")):
        hourly, summary = attention.country_tables(counted, baseline, world["d"], world["r"], key)
        out |= {f"country_{name}_attention": hourly, f"country_{name}_summary": summary}
    breadth = counted.groupBy("family_id").agg(F.count_distinct("publisher_country").alias("publisher_country_count"))
    out["event_families"] = out["event_families"].join(breadth, "family_id", "left").fillna(0, ["publisher_country_count"])
    out["document_evidence"] = partition.evidence(pairs, membership, EVIDENCE)
    return out


def meta(documents: DataFrame, events: DataFrame) -> DataFrame:
    """One row: the window and its denominators."""
    whole = documents.agg(F.count("*").alias("documents"), F.count_distinct("wire_group").alias("effective_reports"), F.min("first_seen").alias("window_start"), F.max("last_seen").alias("window_end"))
    return whole.join(events.agg(F.count("*").alias("macro_events"), F.count_distinct("family_id").alias("families")))
