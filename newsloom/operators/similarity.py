"""Sparse similarity in long form: weights, candidates, scores and the evidence gate.

A sparse matrix is a table (node, feature); a product of matrices is a join on feature and
a sum by pair. Features in many nodes are capped before any join, and the number of pairs
a join would make is known from the counts alone, so a run that would explode is refused
before it starts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.core import clip
from newsloom.functions.fixed import CHANNEL_FLOORS, CHANNEL_WEIGHTS, EVIDENCE_MINIMA


def document_frequency(rows: DataFrame, feature: str = "feature") -> DataFrame:
    """``rows`` must be distinct (node, feature)."""
    return rows.groupBy(feature).agg(F.count("*").alias("df"))


def theme_idf(documents: DataFrame, values: str = "themes", has: str | None = "has_gkg", alias: str = "theme") -> DataFrame:
    """(theme, theme_document_count, idf): ln(N + 1) - ln(df + 1) over documents that have any."""
    docs = documents.where(F.col(has)) if has else documents
    n = docs.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    counts = docs.select(F.explode(values).alias(alias)).where(F.col(alias).isNotNull()).groupBy(alias).agg(F.count("*").alias("theme_document_count"))
    return counts.join(n).select(alias, "theme_document_count", (F.log(F.col("n") + 1) - F.log(F.col("theme_document_count") + 1)).alias("idf"))


def fan_out(rows: DataFrame, feature: str = "feature", cap: int = 2000) -> DataFrame:
    """One row: how many pairs the features within ``cap`` contribute."""
    df = document_frequency(rows, feature).where(F.col("df") <= cap)
    return df.agg(F.coalesce(F.sum(F.col("df") * (F.col("df") - 1) / 2), F.lit(0)).cast("long").alias("contributions"))


def guard(rows: DataFrame, most: int, feature: str = "feature", cap: int = 2000) -> None:
    made = fan_out(rows, feature, cap).first()[0]
    if made > most:
        raise ValueError(f"{made:,} pair contributions exceed the guard of {most:,}; take a smaller window or a lower cap")


def tfidf(rows: DataFrame, nodes: DataFrame | int, node: str = "node", feature: str = "feature", cap: int = 2000, keep_df: bool = False) -> DataFrame:
    """(node, feature, weight): ln((N + 1) / (df + 1)) + 1 for binary features, nodes scaled to length 1.

    N counts all nodes, also those without features. ``keep_df`` adds the features' df.
    """
    n = F.lit(nodes) if isinstance(nodes, int) else F.col("_all")
    df = document_frequency(rows, feature).where(F.col("df") <= cap)
    if not isinstance(nodes, int):
        df = df.join(nodes.agg(F.count("*").alias("_all")))
    kept = ["df"] if keep_df else []
    idf = df.select(feature, (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("w"), *kept)
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(node)))
    return rows.join(idf, feature).select(node, feature, (F.col("w") / length).alias("weight"), *kept)


def cosine_pairs(weights: DataFrame, node: str = "node", feature: str = "feature", most: int | None = 2_000_000_000) -> DataFrame:
    """(left, right, score) of every pair that shares a feature, left < right.

    Features that would make more than ``most`` pairs together are refused before they
    meet; None for weights that were counted already.
    """
    if most is not None:
        guard(weights, most, feature, cap=1 << 62)
    a = weights.select(F.col(node).alias("left"), feature, F.col("weight").alias("wl"))
    b = weights.select(F.col(node).alias("right"), feature, F.col("weight").alias("wr"))
    return a.join(b, feature).where("left < right").groupBy("left", "right").agg(F.sum(F.col("wl") * F.col("wr")).alias("score"))


def both_ways(pairs: DataFrame, a: str = "left", b: str = "right", source: str = "node", target: str = "neighbor") -> DataFrame:
    """Undirected pairs as two directed rows each, in one pass over what makes them."""
    rest = [c for c in pairs.columns if c not in (a, b)]
    way = lambda x, y: F.struct(F.col(x).alias("s"), F.col(y).alias("t"))
    turned = pairs.select(F.explode(F.array(way(a, b), way(b, a))).alias("_way"), *rest)
    return turned.select(F.col("_way.s").alias(source), F.col("_way.t").alias(target), *rest)


def nearest(pairs: DataFrame, k: int = 30, digits: int | None = None) -> DataFrame:
    """(node, neighbor, score, rank): per node the ``k`` best partners; ties to smaller ids."""
    scored = pairs.withColumn("score", F.round("score", digits)) if digits is not None else pairs
    order = W.partitionBy("node").orderBy(F.desc("score"), "neighbor")
    return both_ways(scored.where("score > 0")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def candidate_union(channels: Mapping[str, DataFrame]) -> DataFrame:
    """(left, right, from_<channel>...): pairs that any channel proposes, and which did."""
    named = [
        d.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), F.lit(name).alias("channel"))
        for name, d in channels.items()
    ]
    every = named[0]
    for d in named[1:]:
        every = every.unionByName(d)
    return every.where("left <> right").groupBy("left", "right").agg(*[F.bool_or(F.col("channel") == name).alias(f"from_{name}") for name in channels])


def within_hours(pairs: DataFrame, nodes: DataFrame, most: float = 48.0, node: str = "node", at: str = "first_seen") -> DataFrame:
    """Pairs with ``delta_hours``, only those at most ``most`` apart."""
    t = nodes.select(F.col(node).alias("_n"), F.unix_timestamp(F.col(at).cast("timestamp")).alias("_t"))
    timed = (
        pairs.join(t.withColumnsRenamed({"_n": "left", "_t": "_tl"}), "left").join(t.withColumnsRenamed({"_n": "right", "_t": "_tr"}), "right")
        .withColumn("delta_hours", F.abs(F.col("_tl") - F.col("_tr")) / F.lit(3600.0)).drop("_tl", "_tr")
    )
    return timed.where(F.col("delta_hours") <= most)


def channel_scores(pairs: DataFrame, weights: DataFrame, name: str, node: str = "node", feature: str = "feature") -> DataFrame:
    """``pairs`` with ``<name>_score``, ``<name>_min_features`` and ``<name>_both``.

    A node's features ride along as one map, so a pair costs two lookups by node and no
    join by feature; the product is taken inside the row, over the features that an
    intersection by hash finds shared.
    """
    vec = weights.groupBy(F.col(node).alias("_n")).agg(F.map_from_entries(F.collect_list(F.struct(feature, "weight"))).alias("_v"))
    side = lambda k: vec.withColumnsRenamed({"_n": k, "_v": f"_v{k}"})
    joined = pairs.join(side("left"), "left", "left").join(side("right"), "right", "left")
    shared = F.array_intersect(F.map_keys("_vleft"), F.map_keys("_vright"))
    dot = F.aggregate(shared, F.lit(0.0), lambda a, k: a + F.element_at("_vleft", k) * F.element_at("_vright", k))
    size = lambda c: F.coalesce(F.cardinality(c), F.lit(0))
    least = F.least(size("_vleft"), size("_vright"))
    return (
        joined.withColumn(f"{name}_score", clip(F.coalesce(dot, F.lit(0.0)), 0.0, 1.0))
        .withColumn(f"{name}_min_features", least.cast("int")).withColumn(f"{name}_both", least > 0).drop("_vleft", "_vright")
    )


def combined_score(names: Sequence[str], weights: Mapping[str, float] = CHANNEL_WEIGHTS) -> Column:
    """The weighted mean over the channels that both sides have; 0 where there are none."""
    total = sum((F.when(F.col(f"{n}_both"), F.lit(weights[n])).otherwise(F.lit(0.0)) for n in names), F.lit(0.0))
    scored = sum((F.col(f"{n}_score") * F.lit(weights[n]) for n in names), F.lit(0.0))
    return F.when(total > 0, scored / total).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Gate:
    min_channels: int = 2
    min_features: int = 2
    title_veto: float = 0.15
    titleless_channels: int = 1
    cross_language_title: float = 0.6
    threshold: float = 0.3
    max_hours: float = 48.0


def apply_gate(pairs: DataFrame, names: Sequence[str] = ("title", "event", "url", "entity"), gate: Gate = Gate()) -> DataFrame:
    """``pairs`` with evidence_channels, single_channel_strong and gated (combined or 0)."""
    evidence = sum(((F.col(f"{n}_score") >= EVIDENCE_MINIMA[n]).cast("int") for n in names), F.lit(0))
    titled = "title" in names
    both = F.col("title_both") if titled else F.lit(False)
    agrees = ~both | (F.col("title_score") >= gate.title_veto) if titled else F.lit(True)
    strong = F.lit(False)
    if titled:
        floor = F.lit(CHANNEL_FLOORS["title"])
        if "same_language" in pairs.columns:
            floor = F.when(F.col("same_language"), floor).otherwise(F.lit(max(CHANNEL_FLOORS["title"], gate.cross_language_title)))
        strong = F.col("title_score") >= floor
    for n in names:
        if n != "title":
            strong = strong | ((F.col(f"{n}_score") >= CHANNEL_FLOORS[n]) & (F.col(f"{n}_min_features") >= gate.min_features) & agrees)
    passes = (F.col("evidence_channels") >= gate.min_channels) | F.col("single_channel_strong")
    if titled:
        passes = passes & (both | (F.col("evidence_channels") >= gate.titleless_channels))
    return (
        pairs.withColumn("evidence_channels", evidence.cast("int")).withColumn("single_channel_strong", strong)
        .withColumn("gated", F.when(passes, F.col("combined")).otherwise(F.lit(0.0)))
    )


def mean_gate(pairs: DataFrame, names: Sequence[str], min_channels: int = 2, floor: float = 0.6) -> DataFrame:
    """The plainer gate: the mean over shared channels, kept with two channels or one strong one."""
    both = sum((F.col(f"{n}_both").cast("int") for n in names), F.lit(0))
    mean = F.when(both > 0, sum((F.col(f"{n}_score") for n in names), F.lit(0.0)) / both).otherwise(F.lit(0.0))
    evidence = sum(((F.col(f"{n}_score") > 0).cast("int") for n in names), F.lit(0))
    best = F.greatest(*[F.col(f"{n}_score") for n in names]) if len(names) > 1 else F.col(f"{names[0]}_score")
    return pairs.withColumn("combined", mean).withColumn("gated", F.when((evidence >= min_channels) | (best >= floor), mean).otherwise(F.lit(0.0)))


def projection(links: DataFrame, document: str, event: str, min_support: int = 2, at: str | None = None, max_days: float = 3.0) -> DataFrame:
    """(left, right, shared, jaccard): events by the documents they share.

    With ``at``, events first seen further apart than ``max_days`` are not paired.
    """
    rows = links.select(F.col(document).alias("d"), F.col(event).alias("e")).distinct()
    sizes = rows.groupBy("e").agg(F.count("*").alias("n"))
    a, b = rows.select("d", F.col("e").alias("left")), rows.select("d", F.col("e").alias("right"))
    pairs = a.join(b, "d").where("left < right").groupBy("left", "right").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_support)
    out = (
        pairs.join(sizes.withColumnsRenamed({"e": "left", "n": "_a"}), "left").join(sizes.withColumnsRenamed({"e": "right", "n": "_b"}), "right")
        .withColumn("jaccard", F.col("shared") / (F.col("_a") + F.col("_b") - F.col("shared")))
    )
    if at:
        first = links.groupBy(F.col(event).alias("node")).agg(F.min(at).alias("first_seen"))
        out = within_hours(out, first, max_days * 24)
    return out.select("left", "right", "shared", "jaccard")


def wire_fingerprints(links: DataFrame, document: str, parts: Sequence[str], least: int = 2) -> DataFrame:
    """(document, canonical): documents with the same set of parts are one; small or
    incomplete sets stand for themselves. The least document stands for its set."""
    item = F.struct(*parts)
    whole = F.bool_and(sum((F.col(p).isNull().cast("int") for p in parts), F.lit(0)) == 0)
    sets = links.groupBy(F.col(document).alias("document")).agg(F.array_sort(F.collect_set(item)).alias("set"), whole.alias("whole"))
    solid = (F.size("set") >= least) & F.col("whole")
    keyed = sets.select("document", F.when(solid, F.sha2(F.to_json("set"), 256)).otherwise(F.concat(F.lit("d:"), F.col("document").cast("string"))).alias("k"))
    canonical = keyed.groupBy("k").agg(F.min("document").alias("canonical"))
    return keyed.join(canonical, "k").select("document", "canonical")
