"""SimHash near-dedup by anchor-point covering.

A text's fingerprint has one bit per majority vote over its shingles' hashes. Texts link
when their fingerprints differ in at most ``threshold`` bits; linked texts form
components.

The 64 bits are two blocks of 32; of two linked fingerprints, one block differs in at most
``threshold // 2`` bits. A block's anchors are the words of a perfect Hamming code on 31
of its bits, times both values of the last: every block lies within covering radius 1 of
one. A block is replicated to every anchor within radius + ``threshold // 2``; linked
fingerprints then share the anchor nearest to either, and are compared there.

Skew: equal fingerprints are one row from the start, so copies cost nothing. Anchors with
more than ``crowd`` distinct fingerprints are counted before any of them is gathered and
take another, exact way: two fingerprints within the threshold share a point half-way, so
each crowded fingerprint is spread over the points within half the threshold and tied to
the least one there, by aggregates that combine before the shuffle. No pairs within a
group are listed on either way: a bucket yields at most a spanning set of links.

Defined cases: null texts and texts without words have fingerprint zero; null ids take
part, a component's id is the least id that isn't null; repeated rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import materialize, release
from newsloom.operators.components import connected_components

_SEED = 42
_CHUNK = 1 << 16


def _votes(text: str | None, shingle: int) -> np.ndarray:
    """Per bit, the hashes that have it less those that don't; zeros without words."""
    # bytes.split and bytes.lower know ASCII only, as the definition of words asks
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(64, dtype=np.int64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, stops = [0], [len(joined)]
    if len(words) > shingle:
        starts = np.concatenate(([0], ends[:-1])).tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
    digest, votes, n = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), len(stops)
    for at in range(0, n, _CHUNK):
        hashes = np.array([digest(joined[a:b], _SEED) for a, b in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK])], dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return 2 * votes - n


def _pack(votes: np.ndarray) -> np.ndarray:
    return np.packbits(votes > 0, axis=-1, bitorder="little").view("<u8")[..., 0]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    return int(_pack(_votes(text, shingle)))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fingerprints as signed 64-bit numbers."""
    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, fp long")


def _syndrome(mask: int) -> int:
    s = 0
    for j in range(31):
        if mask >> j & 1:
            s ^= j + 1
    return s


def _error_masks(radius: int) -> list[list[int]]:
    """By syndrome: the masks of weight up to ``radius`` that lead to an anchor."""
    by: list[list[int]] = [[] for _ in range(32)]
    for weight in range(radius + 1):
        for at in combinations(range(32), weight):
            mask = sum(1 << j for j in at)
            by[_syndrome(mask)].append(mask)
    return by


def anchors(fp: Column, threshold: int) -> Column:
    """The anchors (block number above, code word below) that a fingerprint is replicated to."""
    masks = F.expr("array(" + ",".join("array(" + ",".join(f"{m}L" for m in row) + ")" for row in _error_masks(1 + threshold // 2)) + ")")

    def of_block(block: int) -> Column:
        bits = F.shiftrightunsigned(fp, 32 * block).bitwiseAND(F.lit(0xFFFFFFFF))
        syndrome = F.lit(0)
        for k in range(5):
            check = sum(1 << j for j in range(31) if (j + 1) >> k & 1)
            syndrome = syndrome + (F.bit_count(bits.bitwiseAND(F.lit(check))) % 2) * (1 << k)
        return F.transform(F.element_at(masks, syndrome + 1), lambda m: bits.bitwiseXOR(m) + F.lit(block << 32))

    return F.concat(of_block(0), of_block(1))


def _linked(fps: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """A spanning set of the links within one bucket."""
    n, seen, out = len(fps), np.zeros(len(fps), dtype=bool), []
    for root in range(n):
        if seen[root]:
            continue
        seen[root], queue = True, [root]
        while queue:
            x = queue.pop()
            near = np.flatnonzero(~seen & (np.bitwise_count(fps ^ fps[x]) <= threshold))
            seen[near] = True
            queue.extend(near.tolist())
            out.extend((fps[x], fps[y]) for y in near)
    return out


def _compare(threshold: int):
    """Links among the rows (anchor, fp) of a partition in anchor order."""

    def links(anchor: np.ndarray, fp: np.ndarray) -> list[np.ndarray]:
        edge = np.flatnonzero(np.diff(anchor)) + 1
        starts, stops = np.concatenate(([0], edge)), np.concatenate((edge, [len(anchor)]))
        size = stops - starts
        found = [np.empty((0, 2), dtype=np.uint64)]
        small = np.repeat(size <= 8, size)
        for k in range(1, 8):
            i = np.flatnonzero(small[:-k] & (anchor[:-k] == anchor[k:])) if len(anchor) > k else np.empty(0, dtype=np.int64)
            if not len(i):
                break
            i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= threshold]
            found.append(np.stack((fp[i], fp[i + k]), axis=1))
        for a, b in zip(starts[size > 8], stops[size > 8]):
            if pairs := _linked(fp[a:b], threshold):
                found.append(np.array(pairs, dtype=np.uint64))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_a, held_f = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)

        def batch(found: list[np.ndarray]) -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(found), axis=0).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["left", "right"])

        for b in batches:
            if not b.num_rows:
                continue
            a = np.concatenate((held_a, b.column(0).to_numpy()))
            f = np.concatenate((held_f, b.column(1).to_numpy().view(np.uint64)))
            cut = int(np.searchsorted(a, a[-1]))  # the last anchor may go on in the next batch
            if cut:
                yield batch(links(a[:cut], f[:cut]))
            held_a, held_f = a[cut:], f[cut:]
        if len(held_a):
            yield batch(links(held_a, held_f))

    return run


def _half_way(crowded: DataFrame, threshold: int) -> DataFrame:
    """Exact links of crowded fingerprints, by the points between them."""
    near, far = threshold // 2, threshold - threshold // 2
    flips = [m for w in range(far + 1) for m in (sum(1 << j for j in at) for at in combinations(range(64), w))]
    signed = [m - (1 << 64) if m >> 63 else m for m in flips]
    literal = "array(" + ",".join("struct({} AS m, {} AS near)".format(f"{m}L" if m != -(1 << 63) else "(-9223372036854775807L - 1L)", str(f.bit_count() <= near).lower()) for m, f in zip(signed, flips)) + ")"
    spread = crowded.select("fp", F.explode(F.expr(literal)).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x.m")).alias("point"), "x.near")
    least = spread.groupBy(F.col("point").alias("p")).agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null")
    return spread.join(least, F.col("point") == F.col("p")).where("fp <> least").select(F.col("fp").alias("left"), F.col("least").alias("right"))


def fingerprint_links(fps: DataFrame, threshold: int = 2, crowd: int = 256) -> DataFrame:
    """(left, right): links that connect all of ``fps`` (distinct ``fp``) within the threshold."""
    spread = fps.select("fp", F.explode(anchors(F.col("fp"), threshold)).alias("anchor"))
    crowds = materialize(spread.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("anchor"), "crowds")
    calm = (
        spread.join(crowds, "anchor", "left_anti")
        .select("anchor", "fp")
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_compare(threshold), "left long, right long")
    )
    if crowds.isEmpty():
        return calm
    return calm.union(_half_way(spread.join(crowds, "anchor", "left_semi").select("fp").distinct(), threshold))


def near_duplicates(
    docs: DataFrame, threshold: int = 2, shingle: int = 3, crowd: int = 256, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least id that links reach)."""
    every = materialize(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    classes = materialize(every.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = connected_components(fingerprint_links(classes.select("fp"), threshold, crowd))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "component_id")
    return every.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- similarity of texts: fingerprints propose, shingles decide --------------------------

def _probes(votes: np.ndarray, blocks: int, turned: int) -> np.ndarray:
    """For rows of votes, the keys (block above, bits below) with any of each block's
    ``turned`` least certain bits turned."""
    fps, out = _pack(votes), []
    turns = np.array([[k >> b & 1 for b in range(turned)] for k in range(1 << turned)], dtype=np.uint64)
    for block, own in enumerate(np.array_split(np.arange(64), blocks)):
        start, width = int(own[0]), len(own)
        low = np.argsort(np.abs(votes[:, own]), axis=1, kind="stable")[:, :turned].astype(np.uint64)
        bits = fps >> np.uint64(start) & np.uint64((1 << width) - 1)
        masks = (turns[None] << low[:, None]).sum(axis=2, dtype=np.uint64)
        out.append(bits[:, None] ^ masks | np.uint64(block << 32))
    return np.concatenate(out, axis=1).astype(np.int64)


def _digest(text: str | None) -> bytes:
    """Equal for texts of the same words in the same order, in either case."""
    return xxhash.xxh128_digest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()), _SEED)


def _shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of a text's different word shingles, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64)
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends))[:n].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist() if len(words) > shingle else [len(joined)]
    return np.unique(np.array([digest(joined[a:b], _SEED) for a, b in zip(starts, stops)], dtype=np.uint64))


#: Words of 64 bits of a set's parity bitmap.
_WORDS = 8
_BITS = [f"b{k}" for k in range(_WORDS)]


def _parity(hashes: np.ndarray, words: int = _WORDS) -> np.ndarray:
    """A bitmap of a set of hashes: each turns one bit. Two bitmaps differ in no more bits
    than their sets differ in hashes, which bounds from above what the sets share."""
    places = np.bincount((hashes & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(places.astype(np.uint8), bitorder="little").view("<i8")


def _long_parity(hashes: np.ndarray) -> bytes | None:
    """For a set too large for the short bitmap, one with two bits and more a hash."""
    return _parity(hashes, 1 << (len(hashes) // 32).bit_length()).tobytes() if len(hashes) > 64 * _WORDS else None


def _long_apart(a: bytes, b: bytes) -> int:
    """Bits that two long bitmaps differ in; the longer one is folded to the length of the other."""
    x, y = sorted((np.frombuffer(a, dtype="<u8"), np.frombuffer(b, dtype="<u8")), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def _prefix(hashes: np.ndarray, common: np.ndarray, least: float) -> np.ndarray:
    """The first of a set's hashes, those in ``common`` behind all others, of which two sets
    that share ``least`` of their union must have one in common."""
    late = np.zeros(len(hashes), dtype=bool)
    if len(common):
        late = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
    n = len(hashes)
    return np.concatenate((hashes[~late], hashes[late]))[: n - int(np.ceil(least * n - 1e-9)) + 1]


def common_shingles(docs: DataFrame, n: int, text: str, shingle: int, over: int = 8, most: int = 1 << 19) -> np.ndarray:
    """Hashes of shingles in more than ``over`` documents of a sample of the ``n`` documents: a
    twentieth, 10,000 to 200,000 of them. They only set the order that prefixes are taken in:
    any choice finds the same pairs, this one in less time."""
    sample = min(max(10_000, n // 20), 200_000)
    part = docs.where(F.pmod(F.xxhash64(text), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, sample / max(n, 1)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(_shingle_hashes(t.as_py(), shingle).view(np.int64))], names=["h"])

    counted = part.select(text).mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > over)
    return np.sort(counted.orderBy(F.desc("n"), "h").limit(most).select("h").toArrow().column("h").to_numpy().view(np.uint64))


def probed_fingerprints(
    docs: DataFrame, doc_id: str, text: str, shingle: int = 3, blocks: int = 3, turned: int = 4, set_shingle: int = 5, least: float = 0.8, common: np.ndarray | None = None
) -> DataFrame:
    """(doc_id, fp, probes, digest, n, prefix, long, b0, b1, ...): n, prefix and the parity
    bitmaps are of the ``set_shingle``-word set."""
    common = np.empty(0, dtype=np.uint64) if common is None else common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                texts = [t.as_py() for t in b.column(1)]
                votes = np.stack([_votes(t, shingle) for t in texts])
                keys = pa.FixedSizeListArray.from_arrays(pa.array(_probes(votes, blocks, turned).ravel()), blocks << turned).cast(pa.list_(pa.int64()))
                digests = pa.array([_digest(t) for t in texts], pa.binary())
                sets = [_shingle_hashes(t, set_shingle) for t in texts]
                sizes = pa.array([len(x) for x in sets], pa.int32())
                prefixes = pa.array([_prefix(x, common, least).view(np.int64) for x in sets], pa.list_(pa.int64()))
                bits = [pa.array(x) for x in np.ascontiguousarray(np.stack([_parity(x) for x in sets]).T)]
                long = pa.array([_long_parity(x) for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(_pack(votes).view(np.int64)), keys, digests, sizes, prefixes, long, *bits], names=["doc_id", "fp", "probes", "digest", "n", "prefix", "long", *_BITS]
                )

    schema = "doc_id long, fp long, probes array<long>, digest binary, n int, prefix array<long>, long binary, " + ", ".join(f"{x} long" for x in _BITS)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _tree(fps: np.ndarray, most: int) -> tuple[list[tuple[int, int]], int]:
    """Links of a minimum spanning tree by differing bits, and the place of the row nearest to all."""
    apart = np.bitwise_count(fps[:, None] ^ fps[None]).astype(np.int64)
    best, via, inside = apart[0].copy(), np.zeros(len(fps), dtype=int), np.zeros(len(fps), dtype=bool)
    inside[0], links = True, []
    for _ in range(len(fps) - 1):
        x = int(np.argmin(np.where(inside, 99, best)))
        if best[x] <= most:
            links.append((int(fps[via[x]]), int(fps[x])))
        inside[x] = True
        closer = apart[x] < best
        best[closer], via[closer] = apart[x][closer], x
    return links, int(np.argmin(apart.sum(axis=1)))


def _propose(most: int, chunk: int = 256, hubs: int = 8):
    """Pairs to look at among the rows (probe, fp) of a partition in probe order.

    Up to eight fingerprints of a probe: all pairs within ``most`` bits. More: the links of
    a tree of nearest ones. More than a chunk: chunk by chunk, each with the most central
    rows of the chunks before, so memory is bounded and a crowd costs what it has rows.
    """

    def few(probe: np.ndarray, fp: np.ndarray) -> list[np.ndarray]:
        found = []
        for k in range(1, 8):
            i = np.flatnonzero(probe[:-k] == probe[k:]) if len(probe) > k else np.empty(0, dtype=np.int64)
            if not len(i):
                break
            i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= most]
            found.append(np.stack((fp[i], fp[i + k]), axis=1))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_p, held_f = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        central: list[int] = []  # of the probe that is being read in chunks
        of = None

        def batch(found: list[np.ndarray]) -> pa.RecordBatch:
            pairs = np.concatenate([np.empty((0, 2), dtype=np.uint64), *found])
            pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]].view(np.int64), axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["left", "right"])

        def work(probe: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            nonlocal central, of
            edge = np.flatnonzero(np.diff(probe)) + 1
            starts, stops = np.concatenate(([0], edge)), np.concatenate((edge, [len(probe)]))
            size = stops - starts
            small = np.repeat(size <= 8, size)
            if of is not None and probe[0] == of:
                small[: stops[0]] = False
            found = few(probe[small], fp[small])
            for a, b in zip(starts, stops):
                if small[a]:
                    continue
                if probe[a] != of:
                    central, of = [], probe[a]
                for at in range(a, b, chunk):
                    rows = np.concatenate((np.array(central, dtype=np.uint64), fp[at : min(at + chunk, b)]))
                    links, middle = _tree(rows, most)
                    if links:
                        found.append(np.array(links, dtype=np.uint64))
                    central = list(dict.fromkeys([int(rows[middle]), *central]))[:hubs]
            return batch(found)

        for b in batches:
            if not b.num_rows:
                continue
            p = np.concatenate((held_p, b.column(0).to_numpy()))
            f = np.concatenate((held_f, b.column(1).to_numpy().view(np.uint64)))
            cut = int(np.searchsorted(p, p[-1]))  # the last probe may go on in the next batch
            if len(p) - cut > 4 * chunk:
                cut = len(p)  # it is a crowd: chunks follow, with what is central so far
            if cut:
                yield work(p[:cut], f[:cut])
            held_p, held_f = p[cut:], f[cut:]
        if len(held_p):
            yield work(held_p, held_f)

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of a partition ordered by its first, cut so that no value of that is torn apart."""
    held: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        if not b.num_rows:
            continue
        rows = tuple(c.to_numpy() for c in b.columns)
        if held and rows[0][-1] == held[0][0][0]:
            held.append(rows)
            continue
        rows = tuple(np.concatenate(x) for x in zip(*held, rows))
        cut = int(np.flatnonzero(rows[0] != rows[0][-1])[-1]) + 1 if rows[0][0] != rows[0][-1] else 0
        if cut:
            yield tuple(x[:cut] for x in rows)
        held = [tuple(x[cut:] for x in rows)]
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _shared(enough: int = 1 << 16):
    """Of the rows (shingle, component, ...) of a partition, in that order, those whose shingle
    stands in two components or more. Of a shingle with over ``enough`` rows all are kept, so
    no more than those are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # one shingle's rows, not yet known to be shared
        open_key = None  # a shingle whose rows all go out
        for b in batches:
            while b.num_rows:
                key, comp = b.column(0).to_numpy(), b.column(1).to_numpy()
                same = held[0].column(0)[0].as_py() if held else open_key
                if same is not None and key[0] == same:
                    end = int(np.searchsorted(key != same, True))
                    part = b.slice(0, end)
                    if not held:
                        yield part
                    elif comp[end - 1] != held[0].column(1)[0].as_py() or sum(x.num_rows for x in held) + end > enough:
                        yield from held
                        yield part
                        held, open_key = [], same
                    else:
                        held.append(part)
                    b = b.slice(end)
                    continue
                held, open_key = [], None
                edge = np.flatnonzero(np.diff(key)) + 1
                starts, stops = np.concatenate(([0], edge)), np.concatenate((edge, [len(key)]))
                mixed = comp[starts] != comp[stops - 1]
                keep = np.repeat(mixed, stops - starts)
                last = int(starts[-1])
                if not mixed[-1]:
                    held = [b.slice(last)]
                else:
                    open_key = int(key[-1])
                if keep.any():
                    yield b.filter(pa.array(keep))
                break

    return run


def _meet(least: float, chunk: int = 512, tile: int = 2048):
    """Pairs of different components that may share ``least`` of their union, among the rows
    (key, component, side, id, n, place, bitmap words) of a partition in that order.

    A pair is judged at each shared prefix shingle as if it were the first: what stands
    behind it must be enough, and the bitmaps must allow it; neither loses a pair. Rows of
    one component don't meet, nor do rows of one side but side 0.
    """
    apart = (1 - least) / (1 + least)  # the share of both sizes together that two sets may differ in

    def allowed(rows: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        differ = np.zeros(len(i), dtype=np.int64)
        for word in rows[6:]:
            differ += np.bitwise_count((word[i] ^ word[j]).view(np.uint64))
        ok = differ <= apart * (rows[4][i] + rows[4][j]) + 1e-6
        return i[ok], j[ok]

    def may(n: np.ndarray, place: np.ndarray, m: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.minimum(n - place, m - at) * (1 + least) >= least * (n + m) - 1e-6

    def batch(ids: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        pairs = np.concatenate([np.empty((0, 2), dtype=np.int64), *(np.stack((ids[i], ids[j]), axis=1) for i, j in found)])
        pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["left_id", "right_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            key, comp, side, ids, n, place = rows[:6]
            edge = np.flatnonzero(np.diff(key)) + 1
            starts, stops = np.concatenate(([0], edge)), np.concatenate((edge, [len(key)]))
            size = stops - starts
            few = np.flatnonzero(np.repeat((size > 1) & (size <= 8), size))
            found = []
            for k in range(1, min(8, len(few))):
                i, j = few[:-k], few[k:]
                ok = (key[i] == key[j]) & (comp[i] != comp[j]) & ((side[i] != side[j]) | (side[i] == 0))
                i, j = i[ok], j[ok]
                ok = may(n[i], place[i], n[j], place[j])
                found.append(allowed(rows, i[ok], j[ok]))
            yield batch(ids, found)
            for a, b in zip(starts[size > 8], stops[size > 8]):
                for at in range(a, b, chunk):
                    to = min(at + chunk, b)
                    first = at + int(np.searchsorted(comp[at:b], comp[at], side="right"))
                    found = []
                    for x in range(first, b, tile):
                        y = min(x + tile, b)
                        ok = may(n[at:to, None], place[at:to, None], n[None, x:y], place[None, x:y]) & (comp[at:to, None] < comp[None, x:y])
                        ok &= (side[at:to, None] != side[None, x:y]) | (side[at:to, None] == 0)
                        i, j = np.nonzero(ok)
                        found.append(allowed(rows, at + i, x + j))
                    if sum(len(i) for i, _ in found):
                        yield batch(ids, found)

    return run


def _crowd_blocks(rows: DataFrame, crowd: int) -> DataFrame:
    """Rows of shingles with over ``crowd`` rows, dealt to keys that stand for two blocks each.

    The largest component's rows meet those of all others, and these one another; its own
    don't meet. A key has two blocks of some ``crowd`` rows, whatever the shingle has.
    """
    counted = rows.groupBy("shingle", "component").agg(F.count("*").alias("n"))
    led = counted.groupBy("shingle").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("lead"), F.count("*").alias("components"))
    led = materialize(
        led.where((F.col("all") > crowd) & (F.col("components") > 1)).select(
            F.col("shingle").alias("s"), F.col("lead.component").alias("lead"), F.ceil(F.col("lead.n") / crowd).alias("l"), F.ceil((F.col("all") - F.col("lead.n")) / crowd).alias("r")
        ),
        "crowds",
    )
    dealt = rows.join(led, F.col("shingle") == F.col("s"))
    lead = F.col("component") == F.col("lead")
    block = F.when(lead, F.pmod(F.xxhash64("id"), F.col("l"))).otherwise(F.col("l") + F.pmod(F.xxhash64("id"), F.col("r")))
    others = F.when(lead, F.sequence(F.col("l"), F.col("l") + F.col("r") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("l") + F.col("r") - 1))
    dealt = dealt.withColumn("block", block).withColumn("other", F.explode(others))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    key = F.xxhash64("shingle", F.least("block", "other"), F.greatest("block", "other"))
    return dealt.select(key.alias("key"), "component", side.cast("int").alias("side"), "id", "n", "place")


def _left_apart(classes: DataFrame, near: DataFrame, similarity: float, crowd: int = 4096) -> DataFrame:
    """(left_id, right_id): what may be as alike as asked among classes that ``near`` leaves apart."""
    known = connected_components(near, "left_id", "right_id").select("node", "component")
    rows = classes.select("id", "n", "prefix").join(known, F.col("id") == F.col("node"), "left").select(F.posexplode("prefix").alias("place", "shingle"), F.coalesce("component", "id").alias("component"), "id", "n")
    names = ["shingle", "component", "id", "n", "place"]
    rows = rows.select(*names).repartition("shingle").sortWithinPartitions("shingle", "component")
    rows = materialize(rows.mapInArrow(_shared(), "shingle long, component long, id long, n int, place int"), "shared")
    crowds = materialize(rows.groupBy("shingle").agg(F.count("*").alias("c")).where(F.col("c") > crowd).select("shingle"), "crowd-shingles")
    keyed = rows.join(crowds, "shingle", "left_anti").select(F.col("shingle").alias("key"), "component", F.lit(0).alias("side"), "id", "n", "place")
    if not crowds.isEmpty():
        keyed = keyed.unionByName(_crowd_blocks(rows.join(crowds, "shingle", "left_semi"), crowd))
    keyed = keyed.join(classes.select(F.col("id").alias("i"), *_BITS), F.col("id") == F.col("i")).select("key", "component", "side", "id", "n", "place", *_BITS)
    met = keyed.repartition("key").sortWithinPartitions("key", "component").mapInArrow(_meet(similarity), "left_id long, right_id long").distinct()
    long = lambda side: classes.where("long is not null").select(F.col("id").alias(f"{side}_i"), F.col("n").alias(f"{side}_n"), F.col("long").alias(side))
    both = met.join(long("a"), F.col("left_id") == F.col("a_i"), "left").join(long("b"), F.col("right_id") == F.col("b_i"), "left")

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            ok = [
                not x.is_valid or not y.is_valid or _long_apart(x.as_py(), y.as_py()) * (1 + similarity) <= (1 - similarity) * (n + m) + 1e-6
                for n, m, x, y in zip(*sizes, b.column(4), b.column(5))
            ]
            yield b.select(["left_id", "right_id"]).filter(pa.array(ok, pa.bool_()))

    out = materialize(both.select("left_id", "right_id", "a_n", "b_n", "a", "b").mapInArrow(allowed, "left_id long, right_id long"), "left-apart")
    release(rows)
    return out


def _alike(left: str | None, right: str | None, shingle: int, least: float) -> bool:
    """Whether two texts share ``least`` of their word shingles."""

    def shingles(text: str | None) -> set[bytes]:
        w = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return {b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))}

    a, b = shingles(left), shingles(right)
    return len(a & b) >= least * len(a | b)


def _decided(docs: DataFrame, pairs: DataFrame, key: str, text: str, shingle: int, similarity: float) -> DataFrame:
    """The (left_id, right_id) among ``pairs`` whose texts are alike, as a written table."""
    named = materialize(pairs, "pairs")
    ids = named.select(F.explode(F.array("left_id", "right_id")).alias("i")).distinct()
    texts = docs.select(F.col(key).alias("i"), F.col(text).alias("t")).join(ids, "i", "left_semi").dropDuplicates(["i"])
    texts = materialize(texts, "texts")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array([_alike(x.as_py(), y.as_py(), shingle, similarity) for x, y in zip(b.column(2), b.column(3))], pa.bool_())
            yield b.select(["left_id", "right_id"]).filter(keep)

    side = lambda k, t: texts.select(F.col("i").alias(k), F.col("t").alias(t))
    both = named.join(side("left_id", "a"), "left_id").join(side("right_id", "b"), "right_id").select("left_id", "right_id", "a", "b")
    out = materialize(both.mapInArrow(decide, "left_id long, right_id long"), "alike")
    release(texts)
    return out


def similar_groups(
    docs: DataFrame, similarity: float = 0.8, shingle: int = 5, most: int = 14, blocks: int = 0, turned: int = 0, crowd: int = 4096,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(key, group): texts whose ``shingle``-word sets are alike, linked and closed.

    A similarity of 0.8 is up to eleven of 64 bits, too far for anchors at a linear cost.
    But bits that differ between like texts are those with the closest votes: so each of
    ``blocks`` blocks is looked up with any of its ``turned`` least certain bits turned (3 and
    4, 48 keys a fingerprint; from ten million texts on 2 and 7, with keys of 32 bits; this
    sets the time that is taken, not what is found).
    Anchors' own links within two bits are looked at too, and so are different texts of one
    fingerprint. What is proposed is decided by the texts themselves; only texts of the same
    words are one class from the start. ``key`` must be a long that isn't null; equal keys
    are one document.

    Fingerprints find most links at a linear cost, but lose some near the threshold and in
    crowds. So what they leave apart is joined once more, by the shingles themselves and
    without loss: in a common order of all shingles, two sets as alike as asked share one
    of the first few of each (prefix filtering). Shingles that many documents have stand
    last in that order, so documents on one template rarely meet by it. Only shingles of two
    components or more are looked at, in blocks of a bounded size, and of two sets that meet
    bitmaps tell nearly always whether they can be alike; texts move for the others.
    """
    n = docs.count()
    blocks, turned = (blocks, turned) if blocks else (3, 4) if n < 10_000_000 else (2, 7)
    common = common_shingles(docs, n, text, shingle)
    every = materialize(probed_fingerprints(docs, key, text, 3, blocks, turned, shingle, similarity, common), "fingerprints")
    least = every.groupBy("digest").agg(F.min("doc_id").alias("least"))
    firsts = every.join(least, "digest").where(F.col("doc_id") == F.col("least")).dropDuplicates(["digest"])
    classes = materialize(firsts.select("digest", F.col("doc_id").alias("id"), "fp", "probes", "n", "prefix", "long", *_BITS), "classes")
    wide, every = every, materialize(every.select("doc_id", "digest"), "digests")
    release(wide)
    leads = materialize(classes.groupBy("fp").agg(F.min_by(F.struct("id", "probes"), "id").alias("m")).select("fp", F.col("m.id").alias("least"), "m.probes"), "leads")
    spread = leads.select(F.explode("probes").alias("probe"), "fp").repartition("probe").sortWithinPartitions("probe", "fp")
    proposed = spread.mapInArrow(_propose(most), "left long, right long").union(fingerprint_links(leads.select("fp")))
    pairs = proposed.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).distinct()
    of = lambda side: leads.select(F.col("fp").alias(side), F.col("least").alias(f"{side}_id"))
    same = classes.join(leads.select("fp", "least"), "fp").where("id <> least").select(F.col("least").alias("left_id"), F.col("id").alias("right_id"))
    named = pairs.join(of("left"), "left").join(of("right"), "right").select("left_id", "right_id").union(same)
    near = _decided(docs, named, key, text, shingle, similarity)
    rest = _left_apart(classes, near, similarity, crowd)
    linked = connected_components(near.union(_decided(docs, rest, key, text, shingle, similarity)), "left_id", "right_id")
    led = classes.select("digest", "id").join(linked, F.col("id") == F.col("node"), "left").select("digest", F.coalesce("component", "id").alias("group"))
    return every.select(F.col("doc_id").alias(key), "digest").join(led, "digest").select(key, "group")


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all columns, with one document of each group of similar ones: its least id.

    Rows that repeat that document's id are repeats of it; one of them stays. A null id
    stands behind a negative number taken from the text.
    """
    spare = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 2) - F.lit(1 << 62)
    named = docs.select(F.coalesce(F.col(doc_id).cast("long"), spare).alias("_key"), F.struct("*").alias("_row"))
    groups = similar_groups(named.select("_key", F.col(f"_row.{text}").alias("_text")), similarity, shingle, key="_key", text="_text")
    keep = groups.where(F.col("_key") == F.col("group")).select(F.col("_key").alias("_keep")).distinct()
    return named.join(keep, F.col("_key") == F.col("_keep"), "left_semi").dropDuplicates(["_key"]).select("_row.*")
