"""First rows, top rows and dense numbers per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.plans.cutpoint import materialize

Keys = Sequence[str | Column]


def top_per_key(df: DataFrame, keys: Keys, order: Keys, k: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group. Spark limits groups before the shuffle too."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def first_per_key(df: DataFrame, keys: Keys, order: Keys) -> DataFrame:
    """One row a key: the first in order. ``order`` should be total to be reproducible."""
    return top_per_key(df, keys, order, 1)


def top_list(df: DataFrame, key: str, values: str, k: int = 5, alias: str | None = None) -> DataFrame:
    """(key, list): the ``k`` most frequent items of a list column; ties by item."""
    counted = df.select(key, F.explode(values).alias("value")).where("value is not null").groupBy(key, "value").agg(F.count("*").alias("n"))
    return gathered(top_per_key(counted, [key], [F.desc("n"), "value"], k, "r"), [key], F.col("value"), alias or values)


def gathered(ranked: DataFrame, keys: Keys, value: Column, alias: str, rank: str = "r") -> DataFrame:
    """Ranked rows back as one list a group, in rank order. Meant for few rows a group."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), value.alias("v"))))
    return ranked.groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias(alias))


def mode_per_key(df: DataFrame, keys: Keys, value: str, alias: str) -> DataFrame:
    """The most frequent value that isn't null; the least of several."""
    return df.groupBy(*keys).agg(F.mode(value, deterministic=True).alias(alias))


def dense_ids(df: DataFrame, order: Keys, name: str) -> DataFrame:
    """``df`` with ids from 0 without gaps, in total order, without gathering rows.

    Rows are dealt out by ranges of the order; an id is the number of rows in the ranges
    before plus the place inside the range. One count a range passes through one task.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select(
        F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    out = ranged.withColumn("_in", place).join(counts, F.col("_part") == F.col("_p"))
    return out.withColumn(name, (F.col("_base") + F.col("_in")).cast("long")).drop("_part", "_p", "_base", "_in")


def page(df: DataFrame, order: Keys, offset: int, limit: int) -> DataFrame:
    """One page of a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def hash_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 2026) -> DataFrame:
    """``n`` rows in the order of a seeded digest of their keys: the same on every rerun."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return df.orderBy(F.md5(text), *keys).limit(n)


def share_of_total(df: DataFrame, keys: Keys, value: Column) -> Column:
    """A row's part of its group's sum."""
    return value / F.sum(value).over(W.partitionBy(*keys))
