"""Evaluation of partitions against labels."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.core import lookup
from newsloom.operators.ranking import top_per_key


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where that is undefined."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def contingency(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(gold, pred, n, n_gold, n_pred): all metrics below follow from these counts."""
    n = rows.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return n.withColumn("n_gold", F.sum("n").over(W.partitionBy("gold"))).withColumn("n_pred", F.sum("n").over(W.partitionBy("pred")))


def b_cubed(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    sums = contingency(rows, gold, pred).agg(
        F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n") / F.col("n_pred")).alias("p"), F.sum(F.col("n") * F.col("n") / F.col("n_gold")).alias("r")
    )
    p, r = ratio(F.col("p"), F.col("t")), ratio(F.col("r"), F.col("t"))
    return sums.select(p.alias("precision"), r.alias("recall")).select("precision", "recall", f1(F.col("precision"), F.col("recall")).alias("f1"))


def pairwise(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Precision, recall and F1 over pairs of rows, without listing a pair."""
    c = contingency(rows, gold, pred)
    pairs = lambda x: x * (x - 1) / 2
    # each cell carries its row's and column's share of the marginal pair counts
    sums = c.agg(
        F.sum(pairs(F.col("n"))).alias("both"), F.sum(pairs(F.col("n_gold")) * F.col("n") / F.col("n_gold")).alias("g"), F.sum(pairs(F.col("n_pred")) * F.col("n") / F.col("n_pred")).alias("p")
    )
    return sums.select(ratio(F.col("both"), F.col("p")).alias("precision"), ratio(F.col("both"), F.col("g")).alias("recall")).select(
        "precision", "recall", f1(F.col("precision"), F.col("recall")).alias("f1")
    )


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """The matching of rows to columns with the largest sum (shortest augmenting paths)."""
    turned = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if turned else gain)
    rows, cols = cost.shape
    u, v, of = np.zeros(rows + 1), np.zeros(cols + 1), np.zeros(cols + 1, dtype=int)
    for i in range(1, rows + 1):
        of[0], at = i, 0
        least, back, done = np.full(cols + 1, np.inf), np.zeros(cols + 1, dtype=int), np.zeros(cols + 1, dtype=bool)
        while of[at]:
            done[at] = True
            free = ~done[1:]
            slack = cost[of[at] - 1] - u[of[at]] - v[1:]
            better = free & (slack < least[1:])
            least[1:][better], back[1:][better] = slack[better], at
            to = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            step = least[to]
            u[of[done]] += step
            v[done] -= step
            least[~done] -= step
            at = to
        while at:
            of[at] = of[back[at]]
            at = back[at]
    pairs = [(of[j] - 1, j - 1) for j in range(1, cols + 1) if of[j]]
    return [(b, a) for a, b in pairs] if turned else pairs


def ceaf_e(rows: DataFrame, gold: str = "gold", pred: str = "pred", most: int = 5000) -> dict[str, float]:
    """CEAF with entity similarity. Labelled samples are small; more clusters than ``most`` are refused."""
    found = contingency(rows, gold, pred).limit(most * 50 + 1).collect()
    if len(found) > most * 50:
        raise ValueError(f"over {most * 50} cells of labels by clusters are not for the driver")
    gs, ps = sorted({r["gold"] for r in found}), sorted({r["pred"] for r in found})
    if max(len(gs), len(ps), 1) > most:
        raise ValueError(f"an exact matching of over {most} clusters is not for the driver")
    gain = np.zeros((len(gs), len(ps)))
    for r in found:
        gain[gs.index(r["gold"]), ps.index(r["pred"])] = 2 * r["n"] / (r["n_gold"] + r["n_pred"])
    total = sum(gain[i, j] for i, j in assignment(gain)) if found else 0.0
    p, r = (total / len(ps) if ps else 0.0), (total / len(gs) if gs else 0.0)
    return {"precision": p, "recall": r, "f1": 2 * p * r / (p + r) if p + r else 0.0}


def confusion(pairs: DataFrame, truth: Column, said: Column, keys: list[str]) -> DataFrame:
    """Counts and P, R, F1 of yes/no decisions on labelled pairs, per group."""
    t, s = truth, said
    out = pairs.groupBy(*keys).agg(
        F.count_if(t & s).alias("tp"), F.count_if(~t & s).alias("fp"), F.count_if(t & ~s).alias("fn"), F.count_if(~t & ~s).alias("tn")
    )
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def singletons_apart(rows: DataFrame, pred: str, node: str) -> Column:
    """Predicted labels with -1 (unassigned) as clusters of one."""
    return F.when(F.col(pred) < 0, -F.col(node) - 2).otherwise(F.col(pred))


def neighbourhoods(rows: DataFrame, group: str = "neighborhood", story: str = "gold_story", family: str = "family_id") -> DataFrame:
    """Per neighbourhood: its story's documents, and how many of them its main family holds, and of what purity."""
    inside = rows.where(F.col(story))
    main = top_per_key(inside.where(F.col(family) >= 0).groupBy(group, family).agg(F.count("*").alias("held")), [group], [F.desc("held"), family])
    sizes = rows.groupBy(group, family).agg(F.count("*").alias("all_in_family"))
    total = inside.groupBy(group).agg(F.count("*").alias("documents"), F.count_if(F.col(family) < 0).alias("unassigned"))
    return total.join(main.join(sizes, [group, family]), group, "left").select(
        group, "documents", "unassigned", F.col(family).alias("main_family"), F.coalesce(F.col("held") / F.col("documents"), F.lit(0.0)).alias("recall"),
        F.coalesce(F.col("held") / F.col("all_in_family"), F.lit(0.0)).alias("purity"),
    )


def keyword_validation(members: DataFrame, text: Column, patterns: dict[str, str], cluster: str = "cluster") -> DataFrame:
    """(story, articles, best_cluster, recall, purity): the cluster that holds most of a story's articles."""
    hits = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in patterns.items()]))
    tagged = members.select(cluster, F.explode(hits).alias("story"))
    total = tagged.groupBy("story").agg(F.count("*").alias("articles"))
    best = top_per_key(tagged.where(F.col(cluster) >= 0).groupBy("story", cluster).agg(F.count("*").alias("hit")), ["story"], [F.desc("hit"), cluster])
    sizes = members.groupBy(cluster).agg(F.count("*").alias("size"))
    return total.join(best.join(sizes, cluster), "story", "left").select(
        "story", "articles", F.col(cluster).alias("best_cluster"), F.coalesce(F.col("hit") / F.col("articles"), F.lit(0.0)).alias("recall"), F.coalesce(F.col("hit") / F.col("size"), F.lit(0.0)).alias("purity")
    )


def cluster_sizes(members: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Per cluster: articles, canonical articles, named outlets, span in hours."""
    return members.where(F.col(cluster) >= 0).groupBy(cluster).agg(
        F.count("*").alias("articles"), F.count_distinct("canonical").alias("canonical_articles"),
        F.count_distinct(F.when(F.col("domain") != "", F.col("domain"))).alias("domains"),
        ((F.unix_timestamp(F.max("first_seen")) - F.unix_timestamp(F.min("first_seen"))) / 3600.0).alias("span_hours"),
    )


def run_summary(members: DataFrame, cluster: str = "cluster") -> DataFrame:
    """One row: assigned and unassigned articles, clusters, largest cluster's share, size quantiles."""
    sizes = members.where(F.col(cluster) >= 0).groupBy(cluster).agg(F.count("*").alias("n"))
    shape = sizes.agg(
        F.count("*").alias("clusters"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.coalesce(F.sum("n"), F.lit(0)).alias("assigned"),
        F.percentile("n", F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)])).alias("size_quantiles"),
    )
    total = members.agg(F.count("*").alias("articles"))
    return shape.join(total).withColumn("unassigned", F.col("articles") - F.col("assigned")).withColumn("largest_share", ratio(F.col("largest"), F.col("assigned")))


def survival(sizes: DataFrame, n: str = "n") -> DataFrame:
    """(size, at_least, share): how many clusters are of a size or larger: the curve of a report."""
    counts = sizes.groupBy(F.col(n).alias("size")).agg(F.count("*").alias("c"))
    up = F.sum("c").over(W.orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, 0))  # a row a distinct size
    return counts.select("size", up.alias("at_least"), (up / F.sum("c").over(W.partitionBy())).alias("share"))


def candidate_recall(gold_pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: the part of labelled pairs that the candidates hold."""
    marked = gold_pairs.select("left", "right").join(candidates.select("left", "right").distinct().withColumn("found", F.lit(True)), ["left", "right"], "left")
    return marked.agg(F.count("*").alias("pairs"), F.count("found").alias("found")).withColumn("recall", ratio(F.col("found"), F.col("pairs")))


def pair_strata(pairs: DataFrame, strata: Mapping[str, Column], each: Mapping[str, int] | None = None, seed: int = 2026) -> DataFrame:
    """(stratum, left, right, ...): every stratum's pairs, or a seeded sample of each.

    A pair may be in several strata. Samples are drawn by the order of a digest.
    """
    fits = F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in strata.items()])))
    found = pairs.withColumn("stratum", fits)
    if each is None:
        return found
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("left").cast("string"), F.col("right").cast("string")))
    ranked = top_per_key(found, ["stratum"], [drawn, "left", "right"], max(each.values()), "_r")
    wanted = lookup(dict(each), F.col("stratum"))
    return ranked.where(F.col("_r") <= wanted).drop("_r")


def hard_strata() -> dict[str, Column]:
    """Pairs that tell a system's faults: columns end in _l and _r for the two documents."""
    c = F.col
    same_incident, same_family = c("incident_l") == c("incident_r"), c("family_l") == c("family_r")
    # fixed values: score limits of the strata
    return {
        "merged_cross_language": same_incident & (c("language_l") != c("language_r")) & (c("title_score") < 0.6),
        "merged_near_gate": same_incident & (c("gated") < 0.4),
        "sibling_incidents": ~same_incident & same_family,
        "split_strong_title": ~same_family & (c("title_score") >= 0.5),
        "split_shared_event": ~same_family & c("from_event"),
        "easy_negative": ~same_family & c("from_title") & (c("title_score") < 0.2),
    }


def hardness(label: Column, same_family: Column, language_left: Column, language_right: Column, gated: Column) -> Column:
    """How much a labelled pair deserves a second look."""
    # fixed values: points for a vague label, a disagreement and two languages; distance from the gate
    near = F.greatest(F.lit(0.0), 1.0 - F.abs(gated - 0.4) / 0.4)
    points = lambda test, n: F.when(test, F.lit(n)).otherwise(F.lit(0.0))
    return points(label == "related", 3.0) + points((label == "same_event") != same_family, 2.0) + points(language_left != language_right, 1.0) + near


def selection(metrics: DataFrame, most_unassigned: float = 0.12) -> DataFrame:
    """Sweep rows by objective; runs that leave too many documents out come last."""
    # fixed values: what each metric counts for
    objective = 0.45 * F.col("pair_fam_p") + 0.25 * F.col("pair_fam_f1") + 0.15 * F.col("b3_fam_f1") + 0.15 * F.col("pair_inc_f1")
    scored = F.when(F.col("unassigned") <= most_unassigned, objective).otherwise(F.lit(float("-inf")))
    return metrics.withColumn("objective", scored).orderBy(F.desc("objective"), "run")
