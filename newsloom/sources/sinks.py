"""Sinks: tables, reports and resumable shards."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, compression: str = "zstd", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", compression).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Every row as one nested JSON object."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode(mode).text(path)


def records(df: DataFrame) -> list[dict]:
    """The rows of a page of results as JSON values; for results already limited."""
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).collect()]


def summary_json(df: DataFrame) -> dict:
    """A one-row aggregate as a dictionary."""
    return records(df.limit(1))[0]


def reduction(raw_bytes: int, written_bytes: int) -> float:
    """How many times smaller the written tables are."""
    return raw_bytes / written_bytes if written_bytes else 0.0


def write_shards(df: DataFrame, path: str, key: str, shards: int, encode: Callable[[DataFrame], DataFrame]) -> None:
    """Encode and write shard by shard of a hash of ``key``; shards that are there are skipped,
    so a run that broke off goes on where it stopped."""
    spark = df.sparkSession
    sharded = df.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))
    done = existing_shards(spark, path)
    todo = sharded.where(~F.col("shard").isin(*done)) if done else sharded
    encode(todo).write.mode("append").partitionBy("shard").parquet(path)


def existing_shards(spark: SparkSession, path: str) -> list[int]:
    """The shards whose folders hold rows (one number a shard)."""
    try:
        return [r[0] for r in spark.read.parquet(path).select("shard").distinct().collect()]
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER" in str(e):
            return []
        raise
