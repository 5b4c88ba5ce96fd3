"""Best-fit packing by large-item matching.

Documents become token ids plus one end id; longer ones than a sequence are cut into full
pieces behind a shorter first one. Pieces are then packed by their lengths alone: those
above a third of the capacity go at most two to a bin, greedily matched (the largest with
the largest that fits beside it); smaller ones, largest first, go to the tightest gap.

Only the histogram of lengths, at most ``capacity`` numbers, reaches the driver, where
the plan is made for whole runs of equal pieces at once: its size depends on the capacity,
not on the corpus. A piece finds its bin by its length and its rank among pieces of that
length. Ranks come from counts by (length, bucket of a hash), so no length, however
common, passes through one task; the bucket count follows the number of pieces.

Tokens are made once: the table of pieces, without texts or ids, is written before it is
ranked, so a lost executor can't rank differently.

Defined cases: a null text is empty and takes one id; repeated rows are packed each; a
null doc_id is kept; a marker string of the vocabulary in a text has the marker's id, as
the vocabulary's tokenizer gives it; an empty table has no sequences.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.common import materialize

#: The pattern that byte-level pre-tokenizers of the ``tokenizers`` library split texts by.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space from here on would exhaust the stack of the fast encoder's pattern.
_LONG_RUN = 1 << 12
_long_run = re.compile(rf"(?<!\s)\s{{{_LONG_RUN}}}")


@lru_cache(maxsize=2)
def whole_tokenizer(path: str):
    """The file's tokenizer as it is, but for any truncation: whole texts are encoded."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=2)
def fast_encoder(path: str):
    """(encoder, marker strings) that give the file's ids in a fifth of the time, or None
    where the file asks for more than plain byte-level pair merging in the order of ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, before = file["model"], file.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and file.get("normalizer") is None
        and (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) == ("ByteLevel", False, True)
    )
    if not plain:
        return None
    vocab, markers = model["vocab"], tuple(t["content"] for t in file.get("added_tokens", []))
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in merged or any(a >= b for a, b in zip(merged, merged[1:])):
        return None
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in markers}
    if len(ranks) != 256 + len(merged):
        return None
    return tiktoken.Encoding("byte-bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), markers


def token_ids(text: str | None, path: str, end_id: int = 0) -> np.ndarray:
    """The ids of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``, then ``end_id``.

    Texts with a marker string of the file, which has an id of its own, or a very long run
    of white space go through that tokenizer itself, as do all where the file isn't plain.
    """
    text, fast = text or "", fast_encoder(path)
    if fast is None or any(m in text for m in fast[1]) or (len(text) >= _LONG_RUN and _long_run.search(text)):
        return np.array([*whole_tokenizer(path).encode(text, add_special_tokens=False).ids, end_id], dtype="<u4")
    return np.append(fast[0].encode_to_numpy(text, disallowed_special=()).astype("<u4"), np.uint32(end_id))


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all full but the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of every document."""
    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows, all_ids = [], [], []
            for i, said in enumerate(b.column(1)):
                ids = token_ids(said.as_py(), path)
                for p, (start, length) in enumerate(piece_bounds(len(ids), capacity)):
                    part = ids[start : start + length]
                    at.append(i)
                    rows.append((p, start, length, zlib.crc32(part.tobytes())))
                    if with_ids:
                        all_ids.append(part.astype(np.int32))
            piece, start, length, crc = (pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64())))
            cols = [b.column(0).take(pa.array(at, pa.int64())), piece, start, length, crc]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(all_ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


class _Bins:
    """Runs of equal bins by gap: [first bin, how many, what each has taken]."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.next = capacity, 0
        self.gaps: list[int] = []
        self.by_gap: dict[int, list[list[int]]] = {}

    def open(self, n: int, taken: int) -> int:
        self.next += n
        self.put(self.next - n, n, taken)
        return self.next - n

    def put(self, first: int, n: int, taken: int) -> None:
        gap = self.capacity - taken
        if gap not in self.by_gap:
            insort(self.gaps, gap)
        self.by_gap.setdefault(gap, []).append([first, n, taken])

    def tightest(self, length: int) -> int | None:
        at = bisect_left(self.gaps, length)
        return self.gaps[at] if at < len(self.gaps) else None

    def take(self, gap: int) -> list[int]:
        run = self.by_gap[gap].pop()
        if not self.by_gap[gap]:
            del self.by_gap[gap]
            self.gaps.remove(gap)
        return run


def packing_plan(counts: dict[int, int], capacity: int = 2048) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first bin, offset) in order, and the number of bins.

    Pieces of a length with ranks from a row's first rank to the next row's go to bins
    counted up from its first bin, at its offset.
    """
    bins, used, plan = _Bins(capacity), dict.fromkeys(counts, 0), []
    left = {k: n for k, n in counts.items() if n}

    def assign(length: int, n: int, first: int, offset: int) -> None:
        plan.append((length, used[length], first, offset))
        used[length] += n
        left[length] -= n

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        fits = [k for k in large[: bisect_left(large, capacity - a + 1)] if left[k] > (k == a)]
        if fits:
            b = fits[-1]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            first = bins.open(n, a + b)
            assign(a, n, first, 0)
            assign(b, n, first, a)
        else:
            n = left[a]
            assign(a, n, bins.open(n, a), 0)
        large = [k for k in large if left[k]]
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[s]:
            gap = bins.tightest(s)
            if gap is None:
                each = min(left[s], capacity // s)
                run = [bins.next, left[s] // each, 0]
                bins.next += run[1]
            else:
                run = bins.take(gap)
                each = min(left[s], gap // s)
                n = min(run[1], left[s] // each)
                if n < run[1]:
                    bins.put(run[0] + n, run[1] - n, run[2])
                run = [run[0], n, run[2]]
            for k in range(each):
                assign(s, run[1], run[0], run[2] + k * s)
            bins.put(run[0], run[1], run[2] + each * s)
    return np.array(sorted(plan), dtype=np.int64).reshape(-1, 4), bins.next


def pack_pieces(pieces: DataFrame, capacity: int = 2048, rows_a_bucket: int = 1 << 20) -> DataFrame:
    """``pieces`` (a written table) with sequence_id and offset."""
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan, _ = packing_plan(counts, capacity)
    keys = plan[:, 0] * (1 << 44) + plan[:, 1]  # ranks stay below 2^44
    buckets = sum(counts.values()) // rows_a_bucket + 8
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = W.partitionBy("l").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    bases = (
        keyed.groupBy(F.col("length").alias("l"), F.col("_bucket").alias("b")).agg(F.count("*").alias("n"))
        .select("l", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    inside = W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    names = pieces.columns
    ranked = (
        keyed.withColumn("_in", F.row_number().over(inside) - 1)
        .join(bases, (F.col("length") == F.col("l")) & (F.col("_bucket") == F.col("b")))
        .select(*names, (F.col("base") + F.col("_in")).alias("_rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank, length = b.column("_rank").to_numpy(), b.column("length").to_numpy()
            at = np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1
            row = plan[at]
            cols = [b.column(c) for c in names] + [pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3].copy())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack(docs: DataFrame, path: str, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(materialize(token_pieces(docs, path, capacity, doc_id, text), "pieces"), capacity)


def packed_sequences(docs: DataFrame, path: str, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(sequence_id, ids, doc_ids, offsets): the training rows, ``capacity`` ids at most each."""
    pieces = materialize(token_pieces(docs, path, capacity, doc_id, text, with_ids=True), "pieces")
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (
        pack_pieces(pieces, capacity).groupBy("sequence_id").agg(parts.alias("p"))
        .select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))
    )
