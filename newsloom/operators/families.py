"""Linking incidents into story families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.core import clip, empty_if_null
from newsloom.operators.partition import communities
from newsloom.operators.ranking import top_per_key
from newsloom.operators.vectors import PRIOR, mean_vectors, pairs_above, unit


def top_features(rows: DataFrame, k: int, group: str = "incident_id", feature: str = "feature") -> DataFrame:
    """(group, feature): the ``k`` most frequent features of each group; ties by feature."""
    counted = rows.groupBy(group, feature).agg(F.count("*").alias("n"))
    return top_per_key(counted, [group], [F.desc("n"), feature], k).select(group, feature)


def corroboration(members: DataFrame, links: DataFrame | None = None, channels: tuple[str, ...] = ("entity", "event")) -> DataFrame:
    """(incident_id, feature): top people and organisations, events, and places below country level."""
    gkg = members.where("has_gkg and incident_id >= 0")
    out = members.sparkSession.createDataFrame([], "incident_id long, feature string")
    if "entity" in channels:
        named = F.explode(F.concat(empty_if_null(F.col("persons")), empty_if_null(F.col("organizations"))))
        rows = gkg.select("incident_id", named.alias("feature")).where("feature is not null")
        out = out.unionByName(top_features(rows, 10).withColumn("feature", F.concat(F.lit("n:"), "feature")))
    if "geo" in channels:
        rows = gkg.select("incident_id", F.explode("locations").alias("l")).where("l.geo_type >= 2 and l.name is not null").select("incident_id", F.col("l.name").alias("feature"))
        out = out.unionByName(top_features(rows, 5).withColumn("feature", F.concat(F.lit("g:"), "feature")))
    if "event" in channels and links is not None:
        rows = members.where("incident_id >= 0").join(links, "document_id").select("incident_id", F.concat(F.lit("e:"), F.col("GlobalEventID").cast("string")).alias("feature"))
        out = out.unionByName(rows.distinct())
    return out


def overlap_pairs(features: DataFrame, group: str = "incident_id", most: int | None = None) -> DataFrame:
    """(left, right, shared, jaccard) of groups that share a feature; features of over
    ``most`` groups don't link."""
    sizes = features.groupBy(group).agg(F.count("*").alias("n"))
    rows = features
    if most is not None:
        few = features.groupBy("feature").agg(F.count("*").alias("c")).where(F.col("c") <= most).select("feature")
        rows = features.join(few, "feature", "left_semi")
    found = rows.select(F.col(group).alias("left"), "feature").join(rows.select(F.col(group).alias("right"), "feature"), "feature").where("left < right").select("left", "right").distinct()
    # the overlap counts every shared feature, also those too common to link by
    a, b = features.select(F.col(group).alias("left"), "feature"), features.select(F.col(group).alias("right"), "feature")
    shared = found.join(a, "left").join(b, ["right", "feature"]).groupBy("left", "right").agg(F.count("*").alias("shared"))
    of = lambda side: sizes.select(F.col(group).alias(side), F.col("n").alias(f"n_{side}"))
    return shared.join(of("left"), "left").join(of("right"), "right").select(
        "left", "right", "shared", (F.col("shared") / (F.col("n_left") + F.col("n_right") - F.col("shared"))).alias("jaccard")
    )


def sharing(pairs: DataFrame, features: DataFrame, group: str = "incident_id") -> DataFrame:
    """(left, right) of the ``pairs`` that share a feature: each pair's features only, however
    many groups a feature has."""
    a, b = (features.select(F.col(group).alias(side), "feature").distinct() for side in ("left", "right"))
    return pairs.select("left", "right").join(a, "left").join(b, ["right", "feature"], "left_semi").select("left", "right").distinct()


def spans(members: DataFrame, group: str = "incident_id", at: str = "first_seen") -> DataFrame:
    return members.where(F.col(group) >= 0).groupBy(group).agg(F.min(at).alias("start"), F.max(at).alias("end"))


def within_gap(pairs: DataFrame, span: DataFrame, hours: float, group: str = "incident_id") -> DataFrame:
    """Pairs whose ranges overlap or lie at most ``hours`` apart."""
    side = lambda s: span.select(F.col(group).alias(s), F.unix_timestamp(F.col("start").cast("timestamp")).alias(f"s_{s}"), F.unix_timestamp(F.col("end").cast("timestamp")).alias(f"e_{s}"))
    gap = F.greatest(F.col("s_left") - F.col("e_right"), F.col("s_right") - F.col("e_left"))
    return pairs.join(side("left"), "left").join(side("right"), "right").where(gap <= hours * 3600).drop("s_left", "e_left", "s_right", "e_right")


def dominant_language(members: DataFrame, group: str = "incident_id", language: str = "language") -> DataFrame:
    """The language of most members; ties to the first by name."""
    counted = members.groupBy(group, language).agg(F.count("*").alias("n"))
    return top_per_key(counted, [group], [F.desc("n"), language]).select(group, language)


def title_links(
    members: DataFrame, background: DataFrame, links: DataFrame | None = None, least: float = 0.4, strong: float = 0.7, hours: float = 48.0,
    channels: tuple[str, ...] = ("entity", "event"),
) -> DataFrame:
    """(left, right, weight): incidents with close centroids, near in time, and corroborated
    by a shared feature unless very close.

    A calibrated score is never above the cosine, so pairs below ``least`` in cosine are
    left out where blocks of centroids meet.
    """
    with_vec = members.where("incident_id >= 0 and vector is not null")
    centroids = mean_vectors(with_vec, ["incident_id"], "vector", "c").select(F.col("incident_id").alias("id"), unit(F.col("c")).alias("vector"))
    span = spans(members)
    lang = dominant_language(with_vec)
    side = lambda k, c: lang.select(F.col("incident_id").alias(k), F.col("language").alias(c))
    q = background.select(F.col("group_left").alias("ga"), F.col("group_right").alias("gb"), "quantile")
    scored = (
        pairs_above(centroids, least).join(side("left", "ll"), "left").join(side("right", "lr"), "right")
        .join(q, (F.least("ll", "lr") == F.col("ga")) & (F.greatest("ll", "lr") == F.col("gb")), "left")
        .withColumn("q", F.coalesce("quantile", F.lit(PRIOR)))
        .withColumn("weight", clip((F.col("cosine") - F.col("q")) / (1 - F.col("q")), 0.0, 1.0))
        .where(F.col("weight") >= least).select("left", "right", "weight")
    )
    near = within_gap(scored, span, hours)
    shared = sharing(near, corroboration(members, links, channels)).withColumn("shares", F.lit(True))
    return near.join(shared, ["left", "right"], "left").where((F.col("weight") >= strong) | F.col("shares")).select("left", "right", "weight")


def entity_links(members: DataFrame, least: float = 0.2, most: int = 50) -> DataFrame:
    """(left, right, weight): incidents by the overlap of their top entities, where no vectors exist."""
    pairs = overlap_pairs(corroboration(members, None, ("entity",)), most=most)
    return pairs.where(F.col("jaccard") >= least).select("left", "right", F.col("jaccard").alias("weight"))


def link_families(members: DataFrame, edges: DataFrame, resolution: float = 0.5) -> DataFrame:
    """(incident_id, family_id) of all incidents; families are numbered by their least incident."""
    ids = members.where("incident_id >= 0").select("incident_id").distinct()
    found = communities(edges, resolution, "weight").withColumnsRenamed({"node": "incident_id", "community": "lead"})
    led = ids.join(found, "incident_id", "left").withColumn("lead", F.coalesce("lead", "incident_id"))
    # one row an incident that leads a family
    order = led.select("lead").distinct().withColumn("family_id", (F.row_number().over(W.orderBy("lead")) - 1).cast("long"))
    return led.join(order, "lead").select("incident_id", "family_id")


def rollup(events: DataFrame) -> DataFrame:
    """Families as sums over their events; title and label of the event with most reports."""
    first = F.struct(F.col("effective_reports"), -F.col("macro_event_id"))
    ids = F.array_sort(F.collect_list(F.struct((-F.col("effective_reports")).alias("o"), "macro_event_id")))
    return events.groupBy("family_id").agg(
        F.transform(ids, lambda x: x["macro_event_id"]).alias("macro_event_ids"),
        F.max_by("title", first).alias("title"), F.max_by("label", first).alias("label"), F.count("*").alias("incident_count"),
        F.sum("raw_documents").alias("raw_documents"), F.sum("effective_reports").alias("effective_reports"),
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
    )
