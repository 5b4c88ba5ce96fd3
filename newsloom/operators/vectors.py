"""Dense vectors as array columns: centring, calibration, neighbours, centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.core import clip
from newsloom.plans.cutpoint import materialize

PRIOR = 0.17


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Scaled to length 1; zero vectors stay."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x / size)).otherwise(a)


def mean_vectors(rows: DataFrame, keys: list[str], vector: str = "vector", alias: str = "mean") -> DataFrame:
    """The mean per group, by position: partial sums combine before the shuffle, so large
    groups cost no more than small ones."""
    spread = rows.select(*keys, F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return spread.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias(alias), F.max("n").alias("members"))


def center(rows: DataFrame, group: str, vector: str = "vector", least: int = 500) -> DataFrame:
    """Subtract the mean of groups of ``least`` rows or more; all rows scaled to length 1."""
    means = mean_vectors(rows, [group], vector).where(F.col("members") >= least).select(F.col(group).alias("_g"), F.col("mean").alias("_m"))
    joined = rows.join(means, F.col(group).eqNullSafe(F.col("_g")), "left")
    moved = F.when(F.col("_m").isNull(), F.col(vector)).otherwise(F.zip_with(vector, "_m", lambda x, m: x - m))
    return joined.withColumn("_c", moved).withColumn(vector, unit(F.col("_c"))).drop("_g", "_m", "_c")


def background(rows: DataFrame, group: str, vector: str = "vector", key: str = "id", q: float = 0.9, samples: int = 4000, least: int = 500, seed: int = 2026) -> DataFrame:
    """(group_left, group_right, quantile): the cosine that random pairs of two groups stay
    below with probability ``q``, within [0, 0.99].

    At most ``samples`` rows of a group, in the order of a seeded digest, meet as many of
    the other by rank; with few rows every row meets every rank shift, so it is exact.
    Groups under ``least`` rows have no background of their own: use the prior.
    """
    draw = F.row_number().over(W.partitionBy(group).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key))
    drawn = rows.select(group, key, vector, draw.alias("r")).where(F.col("r") <= samples)
    kept = rows.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") >= least).withColumn("n", F.least("n", F.lit(samples)))
    shifts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(64), F.floor(F.lit(samples) / F.col("n")).cast("int") + 1))))
    left = drawn.join(kept, group).select(F.col(group).alias("group_left"), F.col(key).alias("kl"), F.col(vector).alias("vl"), F.col("r").alias("rl"), shifts.alias("s"))
    sizes = kept.select(F.col(group).alias("group_right"), F.col("n").alias("nr"))
    right = drawn.join(kept, group).select(F.col(group).alias("group_right"), F.col(key).alias("kr"), F.col(vector).alias("vr"), F.col("r").alias("rr"))
    pairs = (
        left.join(sizes, F.col("group_left") <= F.col("group_right"))  # every pair of groups, a row a group of ``least`` or more
        .withColumn("rr", ((F.col("rl") + F.col("s") - 1) % F.col("nr") + 1).cast("int"))
        .join(right, ["group_right", "rr"]).where("kl <> kr")
    )
    cos = pairs.select("group_left", "group_right", dot(F.col("vl"), F.col("vr")).alias("c"))
    return cos.groupBy("group_left", "group_right").agg(clip(F.percentile("c", q), 0.0, 0.99).alias("quantile"))


def calibrated(cosine: Column, quantile: Column) -> Column:
    """0 at the background, 1 for equal titles."""
    q = F.coalesce(quantile, F.lit(PRIOR))
    return clip((clip(cosine, 0.0, 1.0) - q) / (1 - q), 0.0, 1.0)


def pair_background(rows: DataFrame, group: str, vector: str = "vector", key: str = "id", q: float = 0.9, block: int = 4096, bins: int = 4096) -> DataFrame:
    """The same over all pairs, without a sample or a least size: every block of rows meets
    every block in a task of its own, quadratic work. Also the number of pairs.

    No cosine is kept in the first pass, which counts them by bins; the second one gives the
    values next to the bins that hold the two ranks, so the quantile is exact and a task
    holds a bounded part of a block's cosines.
    """
    own = materialize(rows.select(F.col(group).alias("g"), F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("g").isNotNull()), "vectors")
    kind, pair = own.schema["g"].dataType.simpleString(), ["group_left", "group_right"]
    n, most = own.agg(F.count("*"), F.max(dot(F.col("v"), F.col("v")))).first()
    most = most if most and np.isfinite(most) else 1.0  # no cosine of finite vectors is beyond
    blocks = max(1, -(-n // block))
    every = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    numbered = own.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    left = numbered.select(F.col("b").alias("lb"), F.explode(every).alias("rb"), "g", "id", "v")
    right = numbered.select(F.explode(every).alias("lb"), F.col("b").alias("rb"), F.col("g").alias("g"), *_again()).groupBy("lb", "rb")

    def counted(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        for x, y, cos in _cosines(a, b):
            n = np.bincount(_bin(cos, most, bins), minlength=bins + 1)
            at = np.flatnonzero(n)
            out.append((x, y, at, n[at]))
        return _by_pair(out, a.schema.field("g").type, "bin", pa.int32())

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        is_range = a.column("lo").is_valid()
        r = a.filter(is_range)
        ranges = {(x, y): (lo, hi) for x, y, lo, hi in zip(*(r.column(c).to_pylist() for c in ("g", "h", "lo", "hi")))}
        out = []
        for x, y, cos in _cosines(a.filter(pa.compute.invert(is_range)), b):
            at, (lo, hi) = _bin(cos, most, bins), ranges.get((x, y), (0, 0))  # a row's group alone has no pairs
            value, n = np.unique(cos[(at >= lo) & (at <= hi)], return_counts=True)
            out += [(x, y, value, n), (x, y, None, np.array([np.count_nonzero(at < lo)]))]
        return _by_pair(out, a.schema.field("g").type, "x", pa.float64())

    columns = f"group_left {kind}, group_right {kind}"
    found = left.groupBy("lb", "rb").cogroup(right).applyInArrow(counted, f"{columns}, bin int, n long")
    below = W.partitionBy(*pair).orderBy("bin")
    histogram = found.groupBy(*pair, "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(below)).withColumn("pairs", F.sum("n").over(W.partitionBy(*pair)))
    place = (F.col("pairs") - 1) * F.lit(q)
    first = lambda c, p: F.min(F.when(F.col("upto") > p, F.col(c)))
    # a bin more on either side: the same cosine may differ by its last bit from pass to pass
    ranges = materialize(
        histogram.groupBy(*pair, "pairs").agg((first("bin", F.floor(place)) - 1).alias("lo"), (first("bin", F.ceil(place)) + 1).alias("hi")), "ranges"
    )
    sent = ranges.select(F.explode(every).alias("lb"), "group_left", "group_right", "lo", "hi").select("lb", F.explode(every).alias("rb"), F.col("group_left").alias("g"), F.col("group_right").alias("h"), "lo", "hi")
    values = left.unionByName(sent, allowMissingColumns=True).groupBy("lb", "rb").cogroup(right).applyInArrow(near, f"{columns}, x double, n long")
    exact = values.groupBy(*pair, "x").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(W.partitionBy(*pair).orderBy(F.asc_nulls_first("x"))))
    ends = exact.join(ranges.select(*pair, "pairs"), pair).groupBy(*pair, "pairs").agg(first("x", F.floor(place)).alias("a"), first("x", F.ceil(place)).alias("b"))
    part = place - F.floor(place)
    return ends.select(*pair, clip(F.when(part > 0, F.col("a") * (1 - part) + F.col("b") * part).otherwise(F.col("a")), 0.0, 0.99).alias("quantile"), "pairs")


def _bin(cos: np.ndarray, most: float, bins: int) -> np.ndarray:
    """Rising with the cosine; what is no number comes last, as it does in sorts."""
    at = np.clip((cos + most) * (bins / (2 * most)), 0, bins - 1)
    return np.where(np.isnan(at), bins, at).astype(np.int64)


def _cosines(a: pa.Table, b: pa.Table, most: int = 1 << 20) -> Iterator[tuple[object, object, np.ndarray]]:
    """(group of a, group of b, cosines of pairs) where the groups stand in order, of ``most``
    or a row's pairs at once."""
    if not len(a) or not len(b):
        return
    (ai, av), (bi, bv) = _matrix(a), _matrix(b)
    ag, bg = (np.array(t.column("g").to_pylist(), dtype=object) for t in (a, b))
    left, right = ({x: np.flatnonzero(g == x) for x in set(g)} for g in (ag, bg))
    for y, j in right.items():
        step, vectors, ids = max(1, most // len(j)), bv[j].T, bi[j]
        for x, i in left.items():
            if x <= y:
                for at in (i[k : k + step] for k in range(0, len(i), step)):
                    yield x, y, (av[at] @ vectors)[ai[at][:, None] != ids[None]]


def _by_pair(parts: list[tuple], kind: pa.DataType, name: str, of: pa.DataType) -> pa.Table:
    tables = [pa.table({"group_left": pa.array([], kind), "group_right": pa.array([], kind), name: pa.array([], of), "n": pa.array([], pa.int64())})]
    for x, y, value, n in parts:
        held = pa.nulls(len(n), of) if value is None else pa.array(value).cast(of)
        tables.append(pa.table({"group_left": pa.repeat(pa.scalar(x, kind), len(n)), "group_right": pa.repeat(pa.scalar(y, kind), len(n)), name: held, "n": pa.array(n, pa.int64())}))
    return pa.concat_tables(tables)


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return t.column("id").to_numpy(), flat.reshape(len(t), -1)


def _table(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    a, b, c = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return pa.table({"node": pa.array(a, pa.int64()), "neighbor": pa.array(b, pa.int64()), "cosine": pa.array(c, pa.float64())})


def _nearest(k: int, least: float):
    """Of each query in one table the ``k`` nearest rows of the other, ties to smaller ids."""

    def compare(q: pa.Table, c: pa.Table) -> pa.Table:
        out = []
        if len(q) and len(c):
            (qi, qv), (ci, cv) = _matrix(q), _matrix(c)
            for i, cos in zip(qi, qv @ cv.T):
                at = np.flatnonzero((cos >= least) & (ci != i))
                at = at[np.lexsort((ci[at], -cos[at]))][:k]
                out.append((np.full(len(at), i), ci[at], cos[at]))
        return _table(out)

    return compare


_FOUND = "node long, neighbor long, cosine double"


def _rows(rows: DataFrame, key: str, vector: str) -> DataFrame:
    return materialize(rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")), "vectors")


def _again() -> list[Column]:
    """The same columns as new attributes, for tables that meet themselves."""
    return [F.col("id").alias("id"), F.col("v").alias("v")]


def _best(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(W.partitionBy("node").orderBy(F.desc("cosine"), "neighbor"))).where(F.col("rank") <= k)


def knn(rows: DataFrame, k: int = 30, least: float = 0.35, key: str = "id", vector: str = "vector", block: int = 4096, exact_below: int | None = None) -> DataFrame:
    """(node, neighbor, cosine, rank): neighbours of unit vectors, ties to smaller ids.

    Every block of queries meets every block of candidates in a task of its own: exact,
    quadratic work, two blocks of memory a task. Only who asks for it by ``exact_below``
    gets, above that number of rows, approximate neighbours (``cell_neighbours``).
    """
    own = _rows(rows, key, vector)
    n = own.count()
    if exact_below is not None and n > exact_below:
        return _best(cell_neighbours(own, n, k, least, block), k)
    blocks = max(1, -(-n // block))
    numbered = own.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    queries = numbered.select(F.col("b").alias("qb"), every.alias("cb"), "id", "v")
    candidates = numbered.select(every.alias("qb"), F.col("b").alias("cb"), *_again())
    return _best(queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInArrow(_nearest(k, least), _FOUND), k)


def _centres(sample: np.ndarray, cells: int, rounds: int = 6, seed: int = 2026) -> np.ndarray:
    centres = sample[np.random.default_rng(seed).choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        label = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def cell_neighbours(own: DataFrame, n: int, k: int, least: float, block: int = 4096, probes: int = 12, sample: int = 20_000) -> DataFrame:
    """(node, neighbor, cosine): approximate neighbours, by k-means cells of a bounded sample.

    A row is stored in its nearest cell and looks into its ``probes`` nearest ones. A cell
    is compared in blocks of rows by blocks of queries, so a crowded cell spreads over as
    many tasks as it needs.
    """
    drawn = own.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    centres = _centres(_matrix(drawn)[1], int(min(1024, max(1, len(drawn) // 4), max(1, n**0.5))))
    probes = min(probes, len(centres))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = np.argsort(-(_matrix(pa.Table.from_batches([b]))[1] @ centres.T), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.tolist(), pa.list_(pa.int64()))], names=["id", "v", "cells"])

    near = materialize(own.mapInArrow(cells, "id long, v array<double>, cells array<long>"), "cells")
    stored = near.select(F.col("cells")[0].alias("c"), "id", "v")
    asked = near.select(F.explode("cells").alias("c"), "id", "v")
    # one row a cell
    blocks = stored.groupBy("c").agg((F.floor(F.count("*") / block) + 1).alias("nb"))
    turns = asked.groupBy("c").agg((F.floor(F.count("*") / block) + 1).alias("nt"))
    shape = materialize(blocks.join(turns, "c"), "cell-sizes")
    left = asked.join(shape, "c").select("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("b"), F.pmod(F.xxhash64("id"), F.col("nt")).alias("t"), "id", "v")
    right = stored.join(shape, "c").select("c", F.pmod(F.xxhash64("id"), F.col("nb")).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nt") - 1)).alias("t"), *_again())
    return left.groupBy("c", "b", "t").cogroup(right.groupBy("c", "b", "t")).applyInArrow(_nearest(k, least), _FOUND)


def pairs_above(rows: DataFrame, least: float, key: str = "id", vector: str = "vector", block: int = 2048) -> DataFrame:
    """(left, right, cosine): all pairs of unit vectors at ``least`` or above, block by block."""
    own = _rows(rows, key, vector)
    blocks = max(1, -(-own.count() // block))
    numbered = own.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    queries = numbered.select(F.col("b").alias("qb"), F.explode(F.sequence(F.col("b"), F.lit(blocks - 1).cast("long"))).alias("cb"), "id", "v")
    candidates = numbered.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("b"))).alias("qb"), F.col("b").alias("cb"), *_again())

    def compare(key: tuple, q: pa.Table, c: pa.Table) -> pa.Table:
        if not len(q) or not len(c):
            return _table([])
        (qi, qv), (ci, cv) = _matrix(q), _matrix(c)
        cos = qv @ cv.T
        i, j = np.nonzero(cos >= least)
        a, b, cos = qi[i], ci[j], cos[i, j]
        keep = a < b if key[0].as_py() == key[1].as_py() else a != b
        return _table([(np.minimum(a, b)[keep], np.maximum(a, b)[keep], cos[keep])])

    found = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInArrow(compare, _FOUND)
    return found.withColumnsRenamed({"node": "left", "neighbor": "right"})


def knn_pairs(neighbours: DataFrame) -> DataFrame:
    """Directed neighbours as distinct pairs left < right."""
    return neighbours.select(F.least("node", "neighbor").alias("left"), F.greatest("node", "neighbor").alias("right")).distinct()


def title_coherence(members: DataFrame, cluster: str = "cluster", document: str = "document_id", vector: str = "vector", title: str = "title") -> DataFrame:
    """(cluster, title_coherence, title): mean cosine of members to their centroid, and the
    title closest to it; ties to the smaller document."""
    titled = members.where(F.col(title).isNotNull() & F.col(vector).isNotNull())
    centroids = mean_vectors(titled, [cluster], vector, "centroid").select(cluster, unit(F.col("centroid")).alias("centroid"))
    sims = titled.join(centroids, cluster).select(cluster, document, title, dot(F.col(vector), F.col("centroid")).alias("s"))
    return sims.groupBy(cluster).agg(F.avg("s").alias("title_coherence"), F.max_by(title, F.struct(F.col("s"), -F.col(document))).alias("title"))
