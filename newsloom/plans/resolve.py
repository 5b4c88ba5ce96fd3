"""Resolution of documents into incidents and families."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.core import empty_if_null
from newsloom.functions.urls import clean_token, slug_path, url_words
from newsloom.operators import families, filters, similarity, vectors
from newsloom.operators.partition import communities, incidents, memberships
from newsloom.plans.cutpoint import materialize


@dataclass(frozen=True)
class Settings:
    neighbours: int = 30
    feature_cap: int = 2000
    most_contributions: int = 2_000_000_000
    title_least: float = 0.35
    entity_share: float = 0.1
    group_least: int = 500
    resolution: float = 0.05
    family_resolution: float = 0.5
    family_title: float = 0.4
    family_strong: float = 0.7
    family_hours: float = 48.0
    family_entity: float = 0.2
    family_channels: tuple[str, ...] = ("entity", "event")
    secondary_least: float = 0.25
    seed: int = 2026
    gate: similarity.Gate = field(default_factory=similarity.Gate)


def event_rows(links: DataFrame) -> DataFrame:
    return links.select(F.col("document_id").alias("node"), F.col("GlobalEventID").cast("string").alias("feature")).where("feature is not null").distinct()


def url_rows(documents: DataFrame) -> DataFrame:
    """Topic words of paths, without those that mark a host rather than a story."""
    words = F.filter(url_words(slug_path(F.col("canonical_url"))), clean_token)
    rows = documents.select(F.col("document_id").alias("node"), "domain", F.explode(words).alias("feature"))
    return filters.without(rows, filters.host_boilerplate(rows, "domain", "feature", "node").select("domain", "feature"), ["domain", "feature"]).select("node", "feature").distinct()


def entity_rows(documents: DataFrame, share: float = 0.1) -> DataFrame:
    """People and organisations, without those in too many documents."""
    gkg = documents.where("has_gkg")
    of = lambda c, p: F.transform(empty_if_null(F.col(c)), lambda x: F.concat(F.lit(p), x))
    rows = gkg.select(F.col("document_id").alias("node"), F.explode(F.concat(of("persons", "p:"), of("organizations", "o:"))).alias("feature")).where("feature is not null").distinct()
    total = gkg.agg(F.count("*").alias("total"))
    common = rows.groupBy("feature").agg(F.count("*").alias("df")).join(total).where(F.col("df") > share * F.col("total")).select("feature")
    return rows.join(common, "feature", "left_anti").select("node", "feature")


def prepared_vectors(documents: DataFrame, vectors_table: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(id, vector, language) centred by domain, then by language; and the background table."""
    kept = documents.join(filters.boilerplate_titles(documents.select("document_id", "domain", "title")).select("document_id"), "document_id", "left_anti")
    lang = F.coalesce("language", F.lit("und"))
    rows = kept.where("title is not null").select("document_id", "domain", lang.alias("language")).join(vectors_table, "document_id")
    rows = rows.select(F.col("document_id").alias("id"), "domain", "language", F.col("vector").cast("array<double>").alias("vector"))
    big = rows.groupBy("language").agg(F.count("*").alias("n")).where(F.col("n") >= s.group_least).select(F.col("language").alias("big"))
    coded = rows.join(big, F.col("language") == F.col("big"), "left").withColumn("code", F.coalesce("big", F.lit("other"))).drop("big")
    centred = vectors.center(vectors.center(coded, "domain", least=s.group_least), "language", least=s.group_least)
    done = materialize(centred.select("id", "vector", "language", "code"), "title-vectors")
    return done, vectors.background(done, "code", least=s.group_least, seed=s.seed)


def score_pairs(candidates: DataFrame, documents: DataFrame, channels: dict[str, DataFrame], titles: DataFrame | None, background: DataFrame | None, s: Settings) -> DataFrame:
    """Candidates within the window with every channel's score, the combined one and the gate."""
    pairs = similarity.within_hours(candidates, documents, s.gate.max_hours, "document_id")
    lang = documents.select(F.col("document_id").alias("d"), F.coalesce("language", F.lit("und")).alias("l"))
    pairs = (
        pairs.join(lang.withColumnsRenamed({"d": "left", "l": "_a"}), "left").join(lang.withColumnsRenamed({"d": "right", "l": "_b"}), "right")
        .withColumn("same_language", F.col("_a") == F.col("_b")).drop("_a", "_b")
    )
    names = []
    if titles is not None:
        names.append("title")
        side = lambda k, x: titles.select(F.col("id").alias(k), F.col("vector").alias(f"v{x}"), F.col("code").alias(f"c{x}"))
        q = background.select(F.col("group_left").alias("_g"), F.col("group_right").alias("_h"), "quantile")
        pairs = pairs.join(side("left", "a"), "left", "left").join(side("right", "b"), "right", "left")
        pairs = pairs.join(q, (F.least("ca", "cb") == F.col("_g")) & (F.greatest("ca", "cb") == F.col("_h")), "left")
        both = F.col("va").isNotNull() & F.col("vb").isNotNull()
        cos = F.when(both, vectors.clip(vectors.dot(F.col("va"), F.col("vb")), 0.0, 1.0)).otherwise(F.lit(0.0))
        pairs = (
            pairs.withColumn("title_cosine", cos).withColumn("title_both", both)
            .withColumn("title_score", F.when(both, vectors.calibrated(F.col("title_cosine"), F.col("quantile"))).otherwise(F.lit(0.0)))
            .drop("va", "vb", "ca", "cb", "_g", "_h", "quantile")
        )
    for name, weights in channels.items():
        names.append(name)
        pairs = similarity.channel_scores(pairs, weights, name)
    return similarity.apply_gate(pairs.withColumn("combined", similarity.combined_score(names)), names, s.gate)


def resolve(documents: DataFrame, links: DataFrame, vectors_table: DataFrame | None = None, s: Settings = Settings(), scored: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of a run. ``scored`` pairs of an earlier run skip retrieval and scoring:
    only the gate and what follows it is done again."""
    out: dict[str, DataFrame] = {}
    titles = background = None
    if vectors_table is not None:
        titles, background = prepared_vectors(documents, vectors_table, s)
        out["title_background"] = background
    if scored is None:
        rows = {"event": event_rows(links), "url": url_rows(documents), "entity": entity_rows(documents, s.entity_share)}
        channels, proposed = {}, {}
        for name, r in rows.items():
            r = materialize(r, f"{name}-rows")
            similarity.guard(r, s.most_contributions, cap=s.feature_cap)
            channels[name] = materialize(similarity.tfidf(r, documents, cap=s.feature_cap), f"{name}-weights")
            near = similarity.nearest(similarity.cosine_pairs(channels[name], most=None), s.neighbours)
            proposed[name] = near.select(F.col("node").alias("left"), F.col("neighbor").alias("right"))
        if titles is not None:
            found = vectors.knn(titles, s.neighbours, s.title_least)
            proposed = {"title": found.select(F.col("node").alias("left"), F.col("neighbor").alias("right")), **proposed}
        out["candidate_pairs"] = materialize(similarity.candidate_union(proposed), "candidates")
        scored = score_pairs(out["candidate_pairs"], documents, channels, titles, background, s)
    else:
        names = [n for n in ("title", "event", "url", "entity") if f"{n}_score" in scored.columns]
        scored = similarity.apply_gate(scored.drop("evidence_channels", "single_channel_strong", "gated"), names, s.gate)
    out["pair_features"] = materialize(scored, "pair-features")
    edges = out["graph_edges"] = materialize(out["pair_features"].where(F.col("gated") >= s.gate.threshold).select("left", "right", "gated", "combined", "evidence_channels"), "edges")
    incident = materialize(incidents(documents, communities(edges, s.resolution, "gated", seed=s.seed)), "incidents")
    members = documents.join(incident, "document_id")
    if titles is not None:
        with_vec = members.join(titles.select(F.col("id").alias("document_id"), "vector", "code"), "document_id", "left").withColumn("language", F.coalesce("code", "language"))
        between = families.title_links(with_vec, background, links.select("document_id", "GlobalEventID"), s.family_title, s.family_strong, s.family_hours, s.family_channels)
        family = families.link_families(members, between, s.family_resolution)
    else:
        family = families.link_families(members, families.entity_links(members, s.family_entity), s.family_entity)
    family = materialize(family, "families")
    of = memberships(edges, incident, s.secondary_least).join(family, "incident_id", "left")
    out["incident_memberships"] = of.select("document_id", "incident_id", F.coalesce("family_id", F.lit(-1)).alias("family_id"), "assignment_score", "is_primary")
    out["incidents"] = members.where("incident_id >= 0").groupBy("incident_id").agg(
        F.count("*").alias("documents"), F.count_distinct("domain").alias("unique_domains"), F.count_distinct("wire_group").alias("effective_reports"),
        F.count_distinct("publisher_country").alias("publisher_countries"), F.count_distinct("language").alias("languages"), F.min("first_seen").alias("start_time"), F.max("last_seen").alias("end_time"),
    ).join(family, "incident_id")
    return out
