"""Graph partitions: constant Potts model and modularity, by local moving with refinement.

Under the constant Potts model, joining unconnected parts only costs, so components
never interact and each is solved on its own: an exact split of the problem. Modularity's
null term needs one number of the whole graph, its total weight. Components within
``most_edges`` are solved one by one in tasks; larger ones level by level too, by rounds of
parallel local moving over DataFrames, where nothing is gathered.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.operators.components import connected_components
from newsloom.operators.similarity import both_ways
from newsloom.plans.cutpoint import materialize


def solve(edges: list[tuple[int, int, float]], resolution: float, total: float | None = None, seed: int = 2026, starts: int = 6) -> dict[int, int]:
    """Communities (named by their least node) of a small graph: the best of some starts.

    ``total`` None: the constant Potts model, a pair of nodes costs ``resolution``. Else
    modularity: a pair costs resolution * strength * strength / (2 total).
    """
    edges = sorted(edges)
    nodes = sorted({x for e in edges for x in e[:2]})
    index = {x: i for i, x in enumerate(nodes)}
    graph: list[dict[int, float]] = [defaultdict(float) for _ in nodes]
    mass = [1.0 if total is None else 0.0 for _ in nodes]
    for a, b, w in edges:
        graph[index[a]][index[b]] += w
        graph[index[b]][index[a]] += w
        if total is not None:
            mass[index[a]] += w
            mass[index[b]] += w
    cost = resolution if total is None else resolution / (2 * total)
    tried = [_level_by_level(graph, mass, cost, np.random.default_rng(seed + k)) for k in range(starts if len(nodes) > 2 else 1)]
    label = max(tried, key=lambda c: round(_worth(graph, mass, cost, c), 9))
    least: dict[int, int] = {}
    for i, c in enumerate(label):
        least.setdefault(c, nodes[i])
    return {nodes[i]: least[c] for i, c in enumerate(label)}


def _worth(graph: list[dict[int, float]], mass: list[float], cost: float, label: list[int]) -> float:
    """Twice the weight inside, less the cost of all pairs inside (and of nodes with themselves)."""
    size: dict[int, float] = defaultdict(float)
    for x, c in enumerate(label):
        size[c] += mass[x]
    inside = sum(w for x, near in enumerate(graph) for y, w in near.items() if label[x] == label[y])
    return inside - cost * sum(s * s for s in size.values())


def _level_by_level(graph: list[dict[int, float]], mass: list[float], cost: float, rng: np.random.Generator) -> list[int]:
    """Move nodes, merge the refined parts into one node each, and again, until nothing merges;
    then one more round of moves over single nodes, from what was found."""
    single, alone, where = graph, mass, np.arange(len(graph))
    while True:
        coarse = _move(graph, mass, cost, list(range(len(graph))), rng)
        fine = _refine(graph, mass, cost, coarse)
        names = {c: i for i, c in enumerate(dict.fromkeys(fine))}
        if len(names) == len(graph):
            return _move(single, alone, cost, [coarse[x] for x in where], rng)
        where = np.array([names[fine[x]] for x in where])
        merged: list[dict[int, float]] = [defaultdict(float) for _ in names]
        weight = [0.0] * len(names)
        for x, near in enumerate(graph):
            weight[names[fine[x]]] += mass[x]
            for y, w in near.items():
                if fine[x] != fine[y]:
                    merged[names[fine[x]]][names[fine[y]]] += w
        graph, mass = merged, weight


def _move(graph: list[dict[int, float]], mass: list[float], cost: float, at: list[int], rng: np.random.Generator) -> list[int]:
    """Each node goes where it gains most, until none gains; neighbours of a mover try again."""
    size = defaultdict(float)
    for x, c in enumerate(at):
        size[c] += mass[x]
    queue, waiting = [int(x) for x in rng.permutation(len(graph))], set(range(len(graph)))
    while queue:
        x = queue.pop(0)
        waiting.discard(x)
        pull = defaultdict(float)
        for y, w in graph[x].items():
            pull[at[y]] += w
        size[at[x]] -= mass[x]
        best, most = at[x], pull[at[x]] - cost * mass[x] * size[at[x]]
        for c in sorted(pull):
            gain = pull[c] - cost * mass[x] * size[c]
            if gain > most + 1e-12:
                best, most = c, gain
        size[best] += mass[x]
        if best != at[x]:
            at[x] = best
            for y in sorted(graph[x]):
                if at[y] != best and y not in waiting:
                    waiting.add(y)
                    queue.append(y)
    return at


def _refine(graph: list[dict[int, float]], mass: list[float], cost: float, coarse: list[int]) -> list[int]:
    """Merge single nodes inside each community, so that every part is connected."""
    at, alone, size = list(range(len(graph))), [True] * len(graph), list(mass)
    for x in range(len(graph)):
        if not alone[x]:
            continue
        pull = defaultdict(float)
        for y, w in graph[x].items():
            if coarse[y] == coarse[x]:
                pull[at[y]] += w
        best, most = x, 1e-12
        for c in sorted(pull):
            gain = pull[c] - cost * mass[x] * size[c]
            if c != x and gain > most:
                best, most = c, gain
        if best != x:
            at[x], alone[best], alone[x] = best, False, False
            size[best] += mass[x]
    return at


def quality(edges: DataFrame, labels: DataFrame, resolution: float, weight: str = "weight") -> DataFrame:
    """One row: the constant Potts objective, weight inside less resolution times pairs inside."""
    l, r = (labels.select(F.col("node").alias(s), F.col("community").alias(f"c{s}")) for s in ("left", "right"))
    inside = edges.join(l, "left").join(r, "right").where("cleft = cright").agg(F.coalesce(F.sum(weight), F.lit(0.0)).alias("w"))
    pairs = labels.groupBy("community").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("p"))
    return inside.join(pairs).select((F.col("w") - F.lit(resolution) * F.col("p")).alias("objective"))


def _spread_moving(edges: DataFrame, nodes: DataFrame, cost: float, start: DataFrame | None = None, patience: int = 4) -> DataFrame:
    """(x, m, c): parallel local moving; half of the nodes, by a hash of node and round, may move at once.

    ``nodes``: (x, m). A round that doesn't raise the objective is taken back, and half as
    many nodes may move in the next. Rounds go on until no node wants to move, or until
    ``patience`` of them in a row were taken back.
    """
    both = materialize(both_ways(edges.select("left", "right", "weight"), source="x", target="y"), "both")
    at = materialize(nodes.select("x", "m", F.col("x").alias("c")) if start is None else nodes.join(start.select("x", "c"), "x").select("x", "m", "c"), "labels")
    best_at, best_worth, stale, turn = at, float("-inf"), 0, 0
    while True:
        size = at.groupBy("c").agg(F.sum("m").alias("s"))
        pull = both.join(at.select(F.col("x").alias("y"), "c"), "y").groupBy("x", "c").agg(F.sum("weight").alias("w"))
        own = at.select("x", "m", F.col("c").alias("own"))
        gains = (
            pull.unionByName(at.select("x", "c", F.lit(0.0).alias("w"))).groupBy("x", "c").agg(F.sum("w").alias("w")).join(size, "c").join(own, "x")
            .withColumn("gain", F.col("w") - cost * F.col("m") * (F.col("s") - F.when(F.col("c") == F.col("own"), F.col("m")).otherwise(0.0)))
        )
        best = gains.groupBy("x", "m", "own").agg(
            F.max_by("c", F.struct(F.round("gain", 12), (F.col("c") == F.col("own")).cast("int"), -F.col("c"))).alias("best"),
            F.max(F.when(F.col("c") == F.col("own"), F.col("w"))).alias("inside"),
        )
        moved = F.when(F.pmod(F.xxhash64("x", F.lit(turn)), F.lit(2 << stale)) == 0, F.col("best")).otherwise(F.col("own"))
        after = materialize(best.select("x", "m", moved.alias("c"), (F.col("best") != F.col("own")).alias("wants"), "inside"), "labels")
        # what the labels before these moves are worth, and whether anyone would still move
        one = after.agg(F.coalesce(F.sum("inside"), F.lit(0.0)).alias("inside"), F.coalesce(F.bool_or("wants"), F.lit(False)).alias("wants")).first()
        worth = one["inside"] - cost * (size.agg(F.sum(F.col("s") * F.col("s"))).first()[0] or 0.0)
        if worth > best_worth + 1e-9:
            best_at, best_worth, stale, at = at, worth, 0, after.select("x", "m", "c")
            if not one["wants"]:
                return best_at
        else:
            stale, at = stale + 1, best_at
            if stale > patience:
                return best_at
        turn += 1


def _spread_levels(edges: DataFrame, resolution: float, total: float | None) -> DataFrame:
    """Move nodes, merge communities into one node each, and again, until nothing merges; then
    move single nodes once more, from what was found."""
    cost = resolution if total is None else resolution / (2 * total)
    sides = both_ways(edges.select("left", "right", "weight"), source="x", target="y")
    nodes = materialize(sides.groupBy("x").agg((F.lit(1.0) if total is None else F.sum("weight")).alias("m")), "nodes")
    single, single_nodes, labels = edges, nodes, None
    while True:
        at = materialize(_spread_moving(edges, nodes, cost), "level")
        labels = materialize(at.select("x", "c") if labels is None else labels.withColumnRenamed("c", "k").join(at.select(F.col("x").alias("k"), "c"), "k").select("x", "c"), "level-labels")
        of = lambda side: at.select(F.col("x").alias(side), F.col("c").alias(f"c_{side}"))
        met = edges.join(of("left"), "left").join(of("right"), "right").where("c_left <> c_right")
        merged = met.groupBy(F.least("c_left", "c_right").alias("left"), F.greatest("c_left", "c_right").alias("right")).agg(F.sum("weight").alias("weight"))
        fewer = materialize(at.groupBy(F.col("c").alias("x")).agg(F.sum("m").alias("m")), "nodes")
        if fewer.count() == nodes.count():
            break
        edges, nodes = materialize(merged, "merged"), fewer
    at = _spread_moving(single, single_nodes, cost, labels)
    least = at.groupBy("c").agg(F.min("x").alias("community"))
    return at.join(least, "c").select(F.col("x").alias("node"), "community")


def communities(
    edges: DataFrame, resolution: float = 0.05, weight: str = "gated", modularity: bool = False, seed: int = 2026, most_edges: int = 200_000
) -> DataFrame:
    """(node, community): every node with an edge, by the least node of its community."""
    e = materialize(edges.select("left", "right", F.col(weight).cast("double").alias("weight")).where("left <> right"), "graph")
    total = float(e.agg(F.sum("weight")).first()[0] or 1.0) if modularity else None
    of = connected_components(e).withColumnRenamed("component", "k")
    own = materialize(e.join(of, e["left"] == of["node"]).select("left", "right", "weight", "k"), "graph")
    sizes = own.groupBy("k").agg(F.count("*").alias("n"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = part.sort_values(["left", "right"])
        found = solve(list(zip(rows["left"], rows["right"], rows["weight"])), resolution, total, seed)
        return pd.DataFrame({"node": list(found), "community": list(found.values())})

    small = own.join(sizes.where(F.col("n") <= most_edges).select("k"), "k", "left_semi").groupBy("k").applyInPandas(run, "node long, community long")
    large = sizes.where(F.col("n") > most_edges).select("k")
    if large.isEmpty():
        return small
    return small.unionByName(_spread_levels(own.join(large, "k", "left_semi").select("left", "right", "weight"), resolution, total))


def incidents(documents: DataFrame, communities_: DataFrame, document: str = "document_id") -> DataFrame:
    """(document, incident_id): communities of two and more, numbered by their least node; others -1."""
    sized = communities_.withColumn("n", F.count("*").over(W.partitionBy("community"))).where("n > 1")
    # one row a community
    ids = sized.select("community").distinct().withColumn("incident_id", (F.row_number().over(W.orderBy("community")) - 1).cast("long"))
    own = sized.join(ids, "community").select(F.col("node").alias(document), "incident_id")
    return documents.select(document).join(own, document, "left").select(document, F.coalesce("incident_id", F.lit(-1).cast("long")).alias("incident_id"))


def memberships(edges: DataFrame, incident: DataFrame, least: float = 0.25, weight: str = "gated") -> DataFrame:
    """(document_id, incident_id, assignment_score, is_primary): the own incident, and others
    that hold ``least`` or more of a document's edge weight."""
    both = both_ways(edges.select("left", "right", F.col(weight).alias("w")), source="document_id", target="other")
    of = both.join(incident.select(F.col("document_id").alias("other"), "incident_id"), "other")
    per = of.groupBy("document_id", "incident_id").agg(F.sum("w").alias("w"))
    shares = per.withColumn("assignment_score", F.col("w") / F.sum("w").over(W.partitionBy("document_id"))).where("incident_id >= 0")
    score = F.when(F.col("incident_id") < 0, F.lit(0.0)).otherwise(F.coalesce("assignment_score", F.lit(1.0)))
    own = incident.join(shares.select("document_id", "incident_id", "assignment_score"), ["document_id", "incident_id"], "left").select(
        "document_id", "incident_id", score.alias("assignment_score"), F.lit(True).alias("is_primary")
    )
    others = (
        shares.join(incident.select("document_id", F.col("incident_id").alias("own")), "document_id")
        .where((F.col("incident_id") != F.col("own")) & (F.col("assignment_score") >= least))
        .select("document_id", "incident_id", "assignment_score", F.lit(False).alias("is_primary"))
    )
    return own.unionByName(others)


def evidence(pairs: DataFrame, members: DataFrame, columns: list[str], supporting: int = 3, competing: int = 1) -> DataFrame:
    """Per document its strongest edges inside its incident and the strongest one out of it."""
    have = [F.col(c) if c in pairs.columns else F.lit(0.0).alias(c) for c in columns]
    kept = pairs.where("gated > 0").select("left", "right", *have)
    directed = both_ways(kept, source="document_id", target="neighbor_document_id")
    own = members.where("is_primary").select("document_id", "incident_id")
    other = own.withColumnsRenamed({"document_id": "neighbor_document_id", "incident_id": "neighbor_incident_id"})
    order = W.partitionBy("document_id", "same_incident").orderBy(F.desc("gated"), "neighbor_document_id")
    ranked = (
        directed.join(own, "document_id").join(other, "neighbor_document_id")
        .withColumn("same_incident", (F.col("incident_id") == F.col("neighbor_incident_id")) & (F.col("incident_id") >= 0))
        .withColumn("rank", F.row_number().over(order))
        .where((F.col("rank") <= supporting) & (F.col("same_incident") | (F.col("rank") <= competing)))
    )
    return ranked.select("document_id", "neighbor_document_id", "neighbor_incident_id", "same_incident", "rank", *columns)
