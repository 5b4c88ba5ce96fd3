"""Structured Streaming forms of the batch steps, as an extension.

The typed columns are the same expressions as in batch, so a stream and a backfill agree
row by row; what differs is when a group is final.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.functions.fixed import MENTION_COLUMNS
from newsloom.plans.ingest import typed_mentions


def mention_stream(spark: SparkSession, directory: str, files_a_trigger: int = 96) -> DataFrame:
    """Typed mentions of plain files as they arrive; rows of another width are dropped."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_a_trigger).option("pathGlobFilter", "*.[cC][sS][vV]").text(directory)
    cut = lines.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("source_file"), F.split(F.regexp_replace("value", r"\r$", ""), "\t", -1).alias("f"))
    rows = cut.where(F.size("f") == len(MENTION_COLUMNS))
    return typed_mentions(rows.select(*[F.nullif(F.col("f")[i], F.lit("")).alias(c) for i, c in enumerate(MENTION_COLUMNS)], "source_file"))


def first_arrivals(stream: DataFrame, key: str = "canonical_url", at: str = "MentionTimeDate", late: str = "1 day") -> DataFrame:
    """The first row of each key to arrive within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def hourly_counts(stream: DataFrame, keys: list[str], at: str, outlet: str, late: str = "1 hour") -> DataFrame:
    """Documents and (about) how many outlets an hour; an hour is final once the watermark passes it."""
    grouped = stream.withWatermark(at, late).groupBy(F.window(at, "1 hour").alias("w"), *keys)
    return grouped.agg(F.count("*").alias("raw_documents"), F.approx_count_distinct(outlet).alias("unique_domains")).select(*keys, F.col("w.start").alias("time_bucket"), "raw_documents", "unique_domains")


def third_outlets(stream: DataFrame, key: str, at: str, outlet: str, outlets: int = 3, keep: str = "30 days") -> DataFrame:
    """(key, outlet, seen): the row that brings a group's third different outlet, once a group.

    A group's state is ``outlets`` names at most, and goes once the stream is ``keep`` past
    the group's last row; rows later than that are dropped, and a group that comes back
    after it is a new one.
    """

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known, last = state.get if state.exists else ("", 0)
        names = [n for n in known.split("\x1f") if n]
        for frame in frames:
            for row in frame.sort_values("seen").itertuples():
                if len(names) < outlets and row.outlet and row.outlet not in names:
                    names.append(row.outlet)
                    if len(names) == outlets:
                        yield pd.DataFrame({"key": [group[0]], "outlet": [row.outlet], "seen": [row.seen]})
            latest = frame["seen"].max()
            last = last if pd.isna(latest) else max(last, int(latest.timestamp() * 1000))
        state.update(("\x1f".join(names), last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(outlet).cast("string").alias("outlet"), F.col(at).cast("timestamp").alias("seen"))
    grouped = rows.withWatermark("seen", keep).groupBy("key")
    return grouped.applyInPandasWithState(step, "key string, outlet string, seen timestamp", "names string, last long", "append", GroupStateTimeout.EventTimeTimeout)
