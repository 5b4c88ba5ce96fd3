"""Sharding by corpus-wide byte-size prefix sums.

Rows are ordered by range partitioning; each partition reports one total; the running
sum of those totals plus the running sum inside a partition is every document's place in
the corpus counted in bytes. Cutting that line at equal targets gives contiguous shards.

Only (id, size, checksum) travel: texts are measured where they are read. One row per
partition, and one per shard, are what passes through a single task. The ranged table is
written before its totals are taken, so a lost executor can't order it differently.

Defined cases: a null text has no bytes; null ids come first; rows alike in id, size and
checksum are interchangeable and are spread over partitions by a salt; a document longer
than a shard's target keeps its shard to itself as far as cuts allow; no rows: no shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.common import materialize


def shard_by_bytes(
    docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", overhead: int = 8
) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to ``shards`` - 1) and slot (gapless from 0).

    A document goes to the shard that holds the middle of its bytes, so a shard misses its
    target by half a document at either end at most.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    ranged = materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
        )
        .repartitionByRange("doc_id", "text_crc32", "size", "salt")
        .drop("salt")
        .withColumn("part", F.spark_partition_id()),
        "ranged",
    )
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        ranged.groupBy("part")
        .agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
        .select(
            F.col("part").alias("p"),
            F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
            F.sum("part_bytes").over(W.partitionBy()).alias("all_bytes"),
        )
    )
    inside = W.partitionBy("part").orderBy("doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        ranged.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("index", F.coalesce(F.count("*").over(inside), F.lit(0)))
        .join(totals, F.col("part") == F.col("p"))
        .withColumn("middle2", 2 * (F.col("bytes_before") + F.col("start")) + F.col("size"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.expr(f"cast(least(middle2 * {shards} div (2 * all_bytes), {shards - 1}) as int)").alias("shard"),
            (F.col("rows_before") + F.col("index")).alias("index"),
        )
    )
    first = placed.groupBy(F.col("shard").alias("s")).agg(F.min("index").alias("first_index"))
    return placed.join(first, F.col("shard") == F.col("s")).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("index") - F.col("first_index")).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write ``docs`` as ``shards`` folders (``shard=N``) of rows in slot order.

    Repeated rows share the least of their slots; a column named ``shard`` gives way.
    """
    placed = shard_by_bytes(docs, shards, doc_id=doc_id, text=text)
    at = placed.groupBy(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc")).agg(F.min(F.struct("shard", "slot")).alias("_at"))
    rows = docs.select(F.struct("*").alias("_row"), F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("_c"))
    row = F.col("_row").dropFields("shard") if "shard" in docs.columns else F.col("_row")
    (
        rows.join(at, F.col(f"_row.{doc_id}").eqNullSafe(F.col("_id")) & (F.col("_c") == F.col("_crc")))
        .repartitionByRange("_at")
        .sortWithinPartitions("_at")
        .select(row.alias("_row"), F.col("_at.shard").alias("shard"))
        .select("_row.*", "shard")
        .write.partitionBy("shard")
        .parquet(path)
    )
