"""Approximate nearest neighbours by a hierarchical k-means tree.

A tree of spherical k-means splits is fitted on a bounded sample; every row is indexed in
the leaf it descends to. A search walks the tree best bin first, with a priority queue of
nodes by their centroids' distance, and visits as many leaves as calibration asks, more
where those hold fewer than ``k`` other rows: over a bounded set of calibration queries,
whose true neighbours a scan of all rows in blocks gives, leaf visits widen until the
wanted recall is reached. A query's own row doesn't count as found.

Bounded: the sample (``sample_rows`` and ``sample_bytes``), the calibration set
(``calibration``) and the tree that both make, which tasks receive whole. Not bounded, so
never gathered: rows, queries, candidates. Leaves grow in number with the rows, as far as
the sample can tell them apart. How far a tree prunes is the data's doing: where clusters
are noise in many dimensions, calibration asks for half of the leaves and more.

What is shuffled: leaves stand on shelves of up to ``block_bytes`` of vectors; a query is
sent once to each shelf that has leaves it visits, not once a visit, and a shelf once for
every ``block_bytes`` of queries, which with usual numbers is once.

Skew: equal vectors are one class and keep their ``k`` + 1 smallest ids, all that any
answer can hold; a limit that Spark applies before the shuffle. Equal queries are searched
once. A leaf larger than a shelf is split into blocks by a hash, so a leaf with a third of
all rows, or of all visits, spreads over as many tasks as it needs.

Defined cases: vectors that are null, zero, hold null or non-finite numbers, have another
length than most, or whose id is null take no part; repeated rows count once; ties go to
smaller ids; with fewer than ``k`` candidates all are returned; no valid row: no result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.common import materialize


@dataclass(frozen=True)
class TreeSettings:
    sample_rows: int = 50_000
    sample_bytes: int = 128 << 20
    #: The largest node splits while it has over ``leaf_sample`` sampled rows and leaves are too few:
    #: fewer than ``leaves``, or than one for every ``rows_a_leaf`` rows.
    leaf_sample: int = 32
    leaves: int = 100
    rows_a_leaf: int = 8_192
    branching: int = 8
    rounds: int = 8
    calibration: int = 256
    recall: float = 0.96
    #: Vectors or queries that one task compares at a time; and how many shelves there are at least.
    block_bytes: int = 16 << 20
    shelves: int = 48
    seed: int = 7


class Tree:
    """Node 0 is the root; ``leaf_of`` numbers the leaves, -1 for inner nodes."""

    def __init__(self, centroids: np.ndarray, children: list[list[int]]) -> None:
        self.centroids, self.children = centroids, children
        self.leaf_of = np.full(len(children), -1)
        ends = [i for i, c in enumerate(children) if not c]
        self.leaf_of[ends] = np.arange(len(ends))
        self.leaves = len(ends)

    @classmethod
    def fit(cls, rows: np.ndarray, s: TreeSettings, wanted: int = 0) -> Tree:
        """Split the largest leaf first, until there are enough or all are small."""
        wanted = max(wanted, s.leaves)
        rng = np.random.default_rng(s.seed)
        centroids, children, leaves = [_unit(rows.mean(axis=0, keepdims=True))[0]], [[]], 1
        todo = [(-len(rows), 0, np.arange(len(rows)))]
        while todo and leaves < wanted:
            _, node, own = heapq.heappop(todo)
            if len(own) <= s.leaf_sample:
                break
            centres, label = _split(rows[own], s, rng)
            if len(centres) < 2:
                continue
            leaves += len(centres) - 1
            for c in range(len(centres)):
                children[node].append(len(children))
                heapq.heappush(todo, (-int((label == c).sum()), len(children), own[label == c]))
                centroids.append(centres[c])
                children.append([])
        return cls(np.array(centroids), children)

    def descend(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each unit row."""
        at = np.zeros(len(rows), dtype=np.int64)
        moving = np.arange(len(rows)) if self.children[0] else np.empty(0, dtype=np.int64)
        while len(moving):
            for node in np.unique(at[moving]):
                mine = moving[at[moving] == node]
                kids = np.array(self.children[node])
                at[mine] = kids[np.argmax(rows[mine] @ self.centroids[kids].T, axis=1)]
            moving = moving[self.leaf_of[at[moving]] < 0]
        return self.leaf_of[at]

    def best_bins(self, near: np.ndarray, visits: int, members: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first ``visits`` leaves, best first, and more until they have ``least`` of the
        leaves' ``members``; ``near`` holds a query's dot product with every centroid."""
        queue, out, have = [(0.0, 0)], [], 0
        while queue and (len(out) < visits or (members is not None and have < least)):
            _, node = heapq.heappop(queue)
            if self.leaf_of[node] >= 0:
                out.append(int(self.leaf_of[node]))
                have += 0 if members is None else members[out[-1]]
            for kid in self.children[node]:
                heapq.heappush(queue, (-near[kid], kid))
        return out


def _unit(rows: np.ndarray) -> np.ndarray:
    peak = np.abs(rows).max(axis=1, keepdims=True, initial=0)
    rows = rows / np.where(peak > 0, peak, 1)
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def _split(rows: np.ndarray, s: TreeSettings, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centres = rows[rng.choice(len(rows), min(s.branching, len(rows)), replace=False)]
    for _ in range(s.rounds):
        label = np.argmax(rows @ centres.T, axis=1)
        used = np.unique(label)
        centres = _unit(np.array([rows[label == c].sum(axis=0) for c in used]))
    label = np.argmax(rows @ centres.T, axis=1)
    used, label = np.unique(label, return_inverse=True)
    return centres[used], label


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _classes(rows: DataFrame, k: int, vec_id: str, vector: str) -> tuple[DataFrame, DataFrame, int]:
    """(valid rows (vec_id, vec), classes (rep, ids, vec), dimensions): equal vectors are one class."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vec")).where(
        F.col("vec_id").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0)
    )
    usual = valid.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dimensions = usual["n"] if usual else 0
    valid = valid.where(F.size("vec") == dimensions)
    few = F.dense_rank().over(W.partitionBy("vec").orderBy("vec_id"))
    ids = valid.withColumn("r", few).where(F.col("r") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    return valid, ids.select(F.col("ids")[0].alias("rep"), "ids", "vec"), dimensions


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of equally many rows, in double precision on the rows as given."""
    return (v * q).sum(axis=-1) / (np.sqrt((q * q).sum(axis=-1)) * np.sqrt((v * v).sum(axis=-1)))


def _nearest(q: np.ndarray, v: np.ndarray, reps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of v, score): the k nearest of each q, ties to smaller reps.

    A matrix product finds a few more than k; exact scores of those decide. Queries with
    more ties at the edge than that get all their ties.
    """
    rough, spare = _unit(q) @ _unit(v).T, k + 4
    if len(v) <= spare:
        i, j = np.divmod(np.arange(rough.size), len(v))
    else:
        near = np.argpartition(-rough, spare - 1, axis=1)[:, :spare]
        score = np.take_along_axis(rough, near, axis=1)
        edge = np.partition(-score, k - 1, axis=1)[:, k - 1] * -1 - 1e-12
        crowded = score.min(axis=1) >= edge
        i, j = np.repeat(np.flatnonzero(~crowded), spare), near[~crowded].ravel()
        for x in np.flatnonzero(crowded):
            ties = np.flatnonzero(rough[x] >= edge[x])
            i, j = np.append(i, np.full(len(ties), x)), np.append(j, ties)
    score = np.concatenate([_exact(q[i[a : a + 65_536]], v[j[a : a + 65_536]]) for a in range(0, len(i), 65_536)])
    order = np.lexsort((reps[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i, "left")
    return i[rank < k], j[rank < k], score[rank < k]


def exact_neighbours(queries: tuple[np.ndarray, np.ndarray], indexed: DataFrame, k: int) -> DataFrame:
    """(q, rep, leaf, score): a bounded set of queries against all rows, in blocks."""
    q_ids, q_vecs = queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            reps, leaves, v = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2))
            i, j, score = _nearest(q_vecs, v, reps, k)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (q_ids[i], reps[j], leaves[j], score)], names=["q", "rep", "leaf", "score"])

    found = indexed.select("rep", "leaf", "vec").mapInArrow(run, "q long, rep long, leaf long, score double")
    return found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "rep"))).where(F.col("r") <= k)


def calibrated_visits(tree: Tree, queries: tuple[np.ndarray, np.ndarray], members: np.ndarray, indexed: DataFrame, k: int, recall: float) -> int:
    """Widen leaf visits until the calibration queries' recall is reached.

    ``members``: how many ids have each query's vector. Its class counts as a neighbour
    only where others have the same vector.
    """
    leaf_ranks, alone = {}, {}
    for q, near, n in zip(queries[0], _unit(queries[1]) @ tree.centroids.T, members):
        leaf_ranks[int(q)] = {leaf: r for r, leaf in enumerate(tree.best_bins(near, tree.leaves), 1)}
        alone[int(q)] = n < 2
    # at most k + 1 rows for each calibration query
    found = exact_neighbours(queries, indexed, k + 1).collect()
    needed = sorted(leaf_ranks[r["q"]][r["leaf"]] for r in found if r["rep"] != r["q"] or not alone[r["q"]])
    return max(1, needed[int(np.ceil(recall * len(needed))) - 1]) if needed else 1


def _shelves(sizes: dict[int, int], rows: int, least: int) -> dict[int, tuple[int, int]]:
    """{leaf: (shelf, blocks)}: leaves one after another fill shelves of up to ``rows`` rows
    (fewer, so that there are ``least`` shelves); one above that has its own, in blocks."""
    rows = max(1, min(rows, -(-sum(sizes.values()) // least)))
    out, shelf, held = {}, 0, 0
    for leaf, n in sorted(sizes.items()):
        if held and held + n > rows:
            shelf, held = shelf + 1, 0
        out[leaf], held = (shelf, -(-n // rows)), held + n
    return out


def _compare_shelf(have: pa.Table, want: pa.Table, k: int, tile: int = 512) -> pa.Table:
    """(q, ids, score): the ``k`` nearest classes of each query among its leaves of one shelf."""
    reps, leaf = have.column("rep").to_numpy(), have.column("leaf").to_numpy()
    order = np.argsort(leaf, kind="stable")
    edges = np.flatnonzero(np.diff(leaf[order])) + 1
    lists = want.column("leaves").combine_chunks()
    visitor, visited = np.repeat(np.arange(len(want)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
    vectors, asked = _matrix(have.column("vec")), _matrix(want.column("qvec"))
    found = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))]
    for rows in np.split(order, edges):
        who = visitor[visited == leaf[rows[0]]]
        for at in range(0, len(who), tile):
            for first in range(0, len(rows), 16 * tile):
                some, part = who[at : at + tile], rows[first : first + 16 * tile]
                i, j, score = _nearest(asked[some], vectors[part], reps[part], k)
                found.append((some[i], part[j], score))
    i, j, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((reps[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    best = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
    return pa.table({"q": want.column("q").to_numpy()[i[best]], "ids": have.column("ids").combine_chunks().take(pa.array(j[best])), "score": score[best]})


def search(
    rows: DataFrame, is_query: str, k: int = 5, settings: TreeSettings = TreeSettings(), vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found for each row that
    satisfies ``is_query`` (SQL on ``vec_id``), itself left out."""
    spark, s = rows.sparkSession, settings
    valid, classes, dimensions = _classes(rows, k, vec_id, vector)
    classes = materialize(classes, "classes")
    block = max(1, s.block_bytes // (8 * max(1, dimensions)))
    sample = min(s.sample_rows, max(s.calibration, s.sample_bytes // (8 * max(1, dimensions))))
    drawn = classes.orderBy(F.xxhash64("rep", F.lit(s.seed)), "rep").limit(sample).select("vec").toArrow()
    if not len(drawn):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = Tree.fit(_unit(_matrix(drawn.column("vec"))), s, -(-classes.count() // s.rows_a_leaf))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = tree.descend(_unit(_matrix(b.column(2)))) if b.num_rows else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], names=["rep", "ids", "vec", "leaf"])

    indexed = materialize(classes.mapInArrow(leaves, "rep long, ids array<long>, vec array<double>, leaf long"), "indexed")
    asked = valid.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("v")).distinct()
    members = materialize(asked.join(classes, F.col("v") == F.col("vec")).select("query_id", "rep"), "members")
    queries = classes.join(members.select(F.col("rep").alias("m")).distinct(), F.col("rep") == F.col("m"), "left_semi").select("rep", "vec", F.size("ids").alias("n"))
    few = queries.orderBy(F.xxhash64("rep", F.lit(s.seed + 1)), "rep").limit(s.calibration).toArrow()
    if not len(few):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    visits = calibrated_visits(tree, (few.column("rep").to_numpy(), _matrix(few.column("vec"))), few.column("n").to_numpy(), indexed, k, s.recall)
    # two numbers for each leaf of the tree
    counted = indexed.groupBy("leaf").agg(F.count("*").alias("rows"), F.sum(F.size("ids")).alias("ids")).collect()
    held = np.zeros(tree.leaves, dtype=np.int64)
    for r in counted:
        held[r["leaf"]] = r["ids"]
    shelf_of = _shelves({int(r["leaf"]): r["rows"] for r in counted}, block, s.shelves)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at, shelves, lists = [], [], []
            for i, near in enumerate(_unit(_matrix(b.column(1))) @ tree.centroids.T):
                by_shelf: dict[int, list[int]] = {}
                for leaf in tree.best_bins(near, visits, held, k + 1):
                    if leaf in shelf_of:
                        by_shelf.setdefault(shelf_of[leaf][0], []).append(leaf)
                at.extend([i] * len(by_shelf))
                shelves.extend(by_shelf)
                lists.extend(by_shelf.values())
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(shelves, pa.int64()), pa.array(lists, pa.list_(pa.int64())), b.column(0).take(at), b.column(1).take(at)], names=["shelf", "leaves", "q", "qvec"]
            )

    walked = materialize(queries.mapInArrow(walk, "shelf long, leaves array<long>, q long, qvec array<double>"), "visits")
    turns = {int(r["shelf"]): -(-r["n"] // block) for r in walked.groupBy("shelf").agg(F.count("*").alias("n")).collect()}
    places = spark.createDataFrame([(leaf, shelf, blocks, turns[shelf]) for leaf, (shelf, blocks) in shelf_of.items() if shelf in turns], "l long, shelf long, blocks long, turns long")
    left = (
        indexed.join(places, F.col("leaf") == F.col("l"))
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
        .select("shelf", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), "leaf", "rep", "ids", "vec")
    )
    shelves = places.groupBy(F.col("shelf").alias("s")).agg(F.max("blocks").alias("blocks"), F.max("turns").alias("turns"))
    right = (
        walked.join(shelves, F.col("shelf") == F.col("s"))
        .withColumn("turn", F.pmod(F.xxhash64("q"), F.col("turns")))
        .select("shelf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "turn", "leaves", "q", "qvec")
    )

    def compare(have: pa.Table, want: pa.Table) -> pa.Table:
        if not len(have) or not len(want):
            return pa.table({"q": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
        return _compare_shelf(have, want, k + 1)

    key = ("shelf", "block", "turn")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "q long, ids array<long>, score double")
    by_class = W.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
    candidates = found.withColumn("r", F.row_number().over(by_class)).where(F.col("r") <= k + 1).select("q", "score", F.explode("ids").alias("vec_id"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        members.join(candidates, F.col("rep") == F.col("q"))
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
