"""Pairs that share a feature, judged where a feature's rows lie, without a row a pair.

A row (node, feature, weight) takes along short hashes of all features of its node. Two nodes
of one feature whose other hashes have nothing in common share that feature alone, so their
score is known there: only what the result keeps of it goes on. The others, which may share
more, send their part of the score from each feature, and the parts meet at the node; a hash
that agrees by chance costs a row and changes nothing. Features in many nodes are dealt to
pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 1e9  # scores are rounded to nine digits
LONGEST = 32  # nodes with more features are compared by masks of their hashes alone


def by_node(weights: DataFrame) -> DataFrame:
    """A row a node: its (feature, weight, df) as ``items``, and ``has`` if the rows have it."""
    own = [c for c in ("channel", "feature", "weight", "df") if c in weights.columns]
    has = [F.bit_or("has").alias("has")] if "has" in weights.columns else []
    return weights.groupBy("node").agg(F.collect_list(F.struct(*own)).alias("items"), *has)


def _hashed(vectors: DataFrame) -> DataFrame:
    """A row a node and feature, with ``h``, a short hash of the feature, and ``all``, those of its node."""
    keys = [c for c in ("channel", "feature") if c in vectors.schema["items"].dataType.elementType.names]
    short = lambda x: (F.pmod(F.xxhash64(*x), F.lit(1 << 16)) - (1 << 15)).cast("short")
    every = vectors.withColumn("all", F.transform("items", lambda x: short([x[k] for k in keys])))
    kept = [c for c in every.columns if c != "items"]
    return every.select(*kept, F.inline("items")).withColumn("h", short([F.col(k) for k in keys]))


def dealt(rows: DataFrame, block: int = 1024) -> DataFrame:
    """Rows of a feature together and in order of nodes; above ``block`` rows by pairs of blocks."""
    keys = [c for c in ("channel", "feature") if c in rows.columns]
    blocks = F.ceil(F.col("df") / block)
    kept = [c for c in rows.columns if c not in ("df", "h")]
    one = rows.where(F.col("df") <= block).select(F.lit(0).cast("long").alias("cell"), F.col("h").cast("int").alias("h"), *kept)
    many = rows.where(F.col("df") > block).withColumn("_b", F.pmod(F.xxhash64("node"), blocks)).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    cell = (F.least("_b", "_o") * F.lit(1 << 31) + F.greatest("_b", "_o")).alias("cell")
    split = many.select(cell, (F.col("h") + F.when(F.col("_b") > F.col("_o"), F.lit(1 << 16)).otherwise(F.lit(0))).cast("int").alias("h"), *kept)
    return one.unionByName(split).repartition(*keys, "cell").sortWithinPartitions(*keys, "cell", "node")


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups, with the groups' first rows."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        last, first = (kept[-1], b) if kept else (b, b)
        ends = _firsts(pa.Table.from_batches([b]), keys)
        same = bool(kept) and all(last.column(k)[last.num_rows - 1] == first.column(k)[0] for k in keys)
        if len(ends) == 1 and (same or not kept):
            kept.append(b)
            continue
        cut = int(ends[-1])
        t = pa.Table.from_batches([*kept, b.slice(0, cut)]).combine_chunks()
        yield t, _firsts(t, keys)
        kept = [b.slice(cut)]
    if kept:
        t = pa.Table.from_batches(kept).combine_chunks()
        yield t, _firsts(t, keys)


def _firsts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(t), bool)
    new[:1] = True
    for k in keys:
        c = t.column(k).combine_chunks()
        new[1:] |= np.asarray(pa.compute.not_equal(c.slice(1), c.slice(0, len(t) - 1)).to_numpy(zero_copy_only=False), bool)
    return np.flatnonzero(new)


def _others(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Two masks of a row's other hashes and the hashes themselves, -1 where there are none."""
    lists = t.column("all").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    flat, own = lists.flatten().to_numpy().astype(np.int32) & 0xFFFF, t.column("h").to_numpy() & 0xFFFF
    row = np.repeat(np.arange(len(size)), size)
    start = np.cumsum(size) - size
    at = np.arange(len(flat))
    mine = np.minimum.reduceat(np.where(flat == own[row], at, len(flat)), start)  # one occurrence is the row's own
    rest = at != mine[row]
    masks = [np.bitwise_or.reduceat(np.where(rest, np.uint64(1) << (flat >> s & 63).astype(np.uint64), np.uint64(0)), start) for s in (0, 6)]
    if (widest := int(size.max())) > LONGEST:
        return *masks, None
    lists = np.full((len(size), widest), -1, np.int32)
    lists[row[rest], (at - start[row])[rest]] = flat[rest]
    return *masks, lists


def _squares(t: pa.Table, first: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, products, alone, shared): for groups of like size their rows (-1: none), the
    products of all pairs, which of them share one feature only, and the pairs that may share more."""
    w, h = t.column("weight").to_numpy(), t.column("h").to_numpy()
    m1, m2, lists = _others(t)
    size = np.diff(np.append(first, len(t)))
    step = np.maximum(1, 1 << np.maximum(0, np.floor(np.log2(np.maximum(size, 1))).astype(int) - 2))
    padded = -(-size // step) * step
    split = h >= 1 << 15  # of rows in a cell of two blocks, those of the second one
    mixed = t.column("cell").to_numpy()[first]
    mixed = mixed >> 31 != mixed & 0x7FFFFFFF
    for n in np.unique(padded[size > 1]):
        groups = np.flatnonzero((padded == n) & (size > 1))
        for g in np.array_split(groups, max(1, -(-len(groups) * int(n) ** 2 // most))):
            if not len(g):
                continue
            at = first[g][:, None] + np.arange(n)
            real = np.arange(n) < size[g][:, None]
            at = np.where(real, at, first[g][:, None])
            product = w[at][:, :, None] * w[at][:, None, :]
            met = real[:, :, None] & real[:, None, :]
            met[:, np.arange(n), np.arange(n)] = False
            if mixed[g].any():
                met &= ~mixed[g][:, None, None] | (split[at][:, :, None] != split[at][:, None, :])
            a, b = m1[at], m2[at]
            more = ((a[:, :, None] & a[:, None, :]) != 0) & ((b[:, :, None] & b[:, None, :]) != 0) & met
            i, x, y = np.nonzero(more)
            if lists is not None and len(i):
                left, right = lists[at[i, x]], lists[at[i, y]]
                agree = np.zeros(len(i), bool)
                for k in range(left.shape[1]):
                    agree |= ((left[:, k : k + 1] == right) & (left[:, k : k + 1] >= 0)).any(axis=1)
                more[i[~agree], x[~agree], y[~agree]] = False
                i, x, y = i[agree], x[agree], y[agree]
            yield np.where(real, at, -1), product, met & ~more, np.stack([at[i, x], at[i, y]]) if len(i) else np.empty((2, 0), np.int64)


def _packed(of: np.ndarray) -> bytes:
    """Entries in order of ``a`` as bytes: its steps, then column by column, byte by byte, compressed."""
    of = of.copy()
    of["a"][1:] -= of["a"][:-1].copy()
    planes = [np.ascontiguousarray(of[f]).view(np.uint8).reshape(len(of), -1).T.tobytes() for f in of.dtype.names]
    return len(of).to_bytes(8, "little") + pa.compress(b"".join(planes), "zstd", asbytes=True)


def _unpacked(blob: bytes, kind: np.dtype) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    raw, out, at = np.frombuffer(pa.decompress(blob[8:], n * kind.itemsize, "zstd", asbytes=True), np.uint8), np.empty(n, kind), 0
    for f in kind.names:
        size = kind[f].itemsize
        out[f] = np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind[f])[:, 0]
        at += n * size
    out["a"] = np.cumsum(out["a"], dtype=kind["a"])
    return out


def _to_nodes(rows: DataFrame, buckets: int, kinds: list[np.dtype], judge: Callable, settle: Callable, schema: str) -> DataFrame:
    """What ``judge`` finds in whole groups of features, sent to buckets of nodes and settled there.

    ``judge`` gives arrays of ``kinds`` from a table and its groups' first rows, and ``settle``
    columns from a bucket's; both begin with the node ``a``. What goes between is packed:
    a row holds what some 250,000 entries have for one bucket.
    """
    keys, names = [c for c in ("channel", "feature", "cell") if c in rows.columns], [f"k{i}" for i in range(len(kinds))]
    columns = [x.rsplit(" ", 1)[0] for x in schema.split(", ")]

    def batch(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        out: dict[int, list] = {}
        for i, parts in enumerate(held):
            every = np.concatenate(parts) if parts else np.empty(0, kinds[i])
            to = (every["a"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)
            order = np.lexsort((every["a"], to))
            every, to = every[order], to[order]
            starts = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else []
            for x, y in zip(starts, [*starts[1:], len(to)]):
                out.setdefault(int(to[x]), [None] * len(kinds))[i] = _packed(every[x:y])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), *[pa.array([v[i] for v in out.values()], pa.binary()) for i in range(len(kinds))]], names=["bucket", *names])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [[] for _ in kinds], 0
        for t, first in _whole(batches, keys):
            for i, found in enumerate(judge(t, first)):
                held[i].append(found)
                n += len(found)
            if n > 250_000:
                yield from batch(held)
                held, n = [[] for _ in kinds], 0
        yield from batch(held)

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in _whole(batches, ["bucket"]):
            for x, y in zip(first, [*first[1:], len(t)]):
                blobs = [[b for b in t.column(c).slice(x, y - x).to_pylist() if b is not None] for c in names]
                found = settle(*[np.concatenate([np.empty(0, k), *[_unpacked(b, k) for b in blob]]) for k, blob in zip(kinds, blobs)])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=columns)

    sent = rows.mapInArrow(send, ", ".join(["bucket long", *[f"{c} binary" for c in names]]))
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(receive, schema)


def _shape(rows: DataFrame, some: int = 100_000) -> tuple[str, int]:
    """Four bytes for ids where they suffice, and the number of buckets."""
    least, most, n = rows.agg(F.min("node"), F.max("node"), F.sum(F.size("items"))).first()
    return "<u4" if not n or (least >= 0 and most < 1 << 32) else "<i8", 1 + n // some


def _firsts_of(*sorted_by: np.ndarray) -> np.ndarray:
    if not len(sorted_by[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in sorted_by], axis=0)))


def nearest_cosine(weights: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """(node, neighbor, score, rank): what ``nearest(cosine_pairs(weights), k, 9)`` gives.

    ``weights``: nodes (long) with their features' weights and df (``by_node``), written once. A
    feature sends a node its ``k`` best partners there, and the parts of scores of pairs that
    may share more.
    """
    of, buckets = _shape(weights)
    best, part = np.dtype([("a", of), ("b", of), ("s", "<i4")]), np.dtype([("a", of), ("b", of), ("s", "<f8")])

    def judge(t: pa.Table, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node, w = t.column("node").to_numpy(), t.column("weight").to_numpy()
        found, parts = [np.empty(0, best)], [np.empty(0, part)]
        for at, product, alone, (x, y) in _squares(t, first):
            score = np.where(alone, np.floor(product * UNIT + 0.5), 0.0)
            for _ in range(min(k, score.shape[2] - 1)):  # the first of equal ones has the smallest id
                j = score.argmax(axis=2)
                s = np.take_along_axis(score, j[:, :, None], 2)[:, :, 0]
                ok = s > 0
                if not ok.any():
                    break
                found.append(_struct(best, node[at[ok]], node[np.take_along_axis(at, j, 1)[ok]], s[ok]))
                np.put_along_axis(score, j[:, :, None], 0.0, 2)
            parts.append(_struct(part, node[x], node[y], w[x] * w[y]))
        return np.concatenate(found), np.concatenate(parts)

    def settle(one: np.ndarray, many: np.ndarray) -> list[np.ndarray]:
        many = many[np.lexsort((many["b"], many["a"]))]
        new = _firsts_of(many["a"], many["b"])
        whole = np.floor(np.add.reduceat(many["s"], new) * UNIT + 0.5) if len(new) else np.empty(0)
        a, b, s = (np.append(one[f], x) for f, x in (("a", many["a"][new]), ("b", many["b"][new]), ("s", whole)))
        order = np.lexsort((b, -s, a))
        order = order[s[order] > 0]
        a, b, s = a[order].astype(np.int64), b[order].astype(np.int64), s[order]
        new = _firsts_of(a)
        rank = np.arange(len(a)) - np.repeat(new, np.diff(np.append(new, len(a)))) + 1
        ok = rank <= k
        return [a[ok], b[ok], s[ok] / UNIT, rank[ok].astype(np.int32)]

    return _to_nodes(dealt(_hashed(weights), block), buckets, [best, part], judge, settle, "node long, neighbor long, score double, rank int")


def _struct(kind: np.dtype, *columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(columns[0]), kind)
    for f, c in zip(kind.names, columns):
        out[f] = c
    return out


def mean_totals(weights: DataFrame, min_channels: int = 2, floor: float = 0.6, block: int = 1024) -> DataFrame:
    """(left, pairs, combined, gated): per smaller node the number of pairs that share a feature
    in any channel, and the sums of what ``mean_gate`` gives them.

    ``weights``: nodes (long) with their features' channel (from 0, under 8), weights and df,
    and their channels as bits, ``has`` (``by_node``), written once.
    """
    of, buckets = _shape(weights)
    total = np.dtype([("a", of), ("n", "<i8"), ("c", "<f8"), ("g", "<f8")])
    part = np.dtype([("a", of), ("b", of), ("channel", "u1"), ("both", "u1"), ("s", "<f8")])

    def judge(t: pa.Table, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node, w, has, channel = (t.column(c).to_numpy() for c in ("node", "weight", "has", "channel"))
        found, parts = [np.empty(0, total)], [np.empty(0, part)]
        for at, product, alone, (x, y) in _squares(t, first):
            alone &= np.triu(np.ones(alone.shape[1:], bool), 1) & (product > 0)
            score = np.minimum(product, 1.0)
            held = has[at]
            mean = np.where(alone, score / np.maximum(np.bitwise_count(held[:, :, None] & held[:, None, :]), 1), 0.0)
            gated = mean if min_channels <= 1 else np.where(score >= floor, mean, 0.0)
            n = alone.sum(axis=2)
            ok = n > 0
            found.append(_struct(total, node[at[ok]], n[ok], mean.sum(axis=2)[ok], gated.sum(axis=2)[ok]))
            x, y = x[x < y], y[x < y]
            parts.append(_struct(part, node[x], node[y], channel[x], np.bitwise_count(has[x] & has[y]), w[x] * w[y]))
        return np.concatenate(found), np.concatenate(parts)

    def settle(one: np.ndarray, many: np.ndarray) -> list[np.ndarray]:
        many = many[np.lexsort((many["channel"], many["b"], many["a"]))]
        new = _firsts_of(many["a"], many["b"], many["channel"])
        score, many = (np.clip(np.add.reduceat(many["s"], new), 0.0, 1.0) if len(new) else np.empty(0)), many[new]
        new = _firsts_of(many["a"], many["b"])
        summed = lambda f, x: f.reduceat(x, new) if len(new) else np.empty(0)
        mean, many = summed(np.add, score) / np.maximum(many["both"][new], 1), many[new]
        evidence, best = summed(np.add, (score > 0).astype(np.int64)), summed(np.maximum, score)
        gated = np.where((evidence >= min_channels) | (best >= floor), mean, 0.0)
        shared = best > 0
        every = np.append(one, _struct(total, many["a"][shared], np.ones(shared.sum()), mean[shared], gated[shared]))
        every = every[np.argsort(every["a"], kind="stable")]
        new = _firsts_of(every["a"])
        n, c, g = (np.add.reduceat(every[f], new) if len(new) else every[f] for f in ("n", "c", "g"))
        return [every["a"][new].astype(np.int64), n, c, g]

    return _to_nodes(dealt(_hashed(weights), block), buckets, [total, part], judge, settle, "left long, pairs long, combined double, gated double")
