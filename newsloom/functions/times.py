"""Time expressions and the time formats of requests."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STAMP = "yyyyMMddHHmmss"
UNITS = {"min": timedelta(minutes=1), "h": timedelta(hours=1), "d": timedelta(days=1), "w": timedelta(weeks=1), "m": timedelta(days=30)}


def to_utc(value: Column) -> Column:
    """A 14-digit stamp as a timestamp (the session runs in UTC); null if it isn't one."""
    return F.try_to_timestamp(value, F.lit(STAMP))


def hour(at: Column) -> Column:
    return F.date_trunc("hour", at)


def hours_between(later: Column, earlier: Column) -> Column:
    """Whole minutes between, as hours; minutes are cut towards zero."""
    return F.timestamp_diff("MINUTE", earlier, later) / F.lit(60.0)


def bucket(at: Column, size: timedelta) -> Column:
    """The start of the bucket of ``size`` that holds a time, counted from the epoch."""
    seconds = int(size.total_seconds())
    return F.timestamp_seconds(F.floor(F.unix_timestamp(at) / seconds) * seconds)


def bucket_size(span: timedelta) -> timedelta:
    """15 minutes for a day at most, an hour for two weeks at most, else a day."""
    if span <= timedelta(days=1):
        return timedelta(minutes=15)
    return timedelta(hours=1) if span <= timedelta(days=14) else timedelta(days=1)


def grid(spark: SparkSession, start: datetime, end: datetime, size: timedelta, name: str = "bucket") -> DataFrame:
    """Every bucket from the one that holds ``start`` to the one that holds ``end``."""
    ends = [bucket(F.lit(t).cast("timestamp"), size) for t in (start, end)]
    step = F.make_dt_interval(secs=F.lit(int(size.total_seconds())))
    return spark.range(1).select(F.explode(F.sequence(*ends, step)).alias(name))


def slots(spark: SparkSession, start: datetime, end: datetime) -> DataFrame:
    """Every quarter of an hour in [start, end) as its 14-digit ``stamp``."""
    last = end - timedelta(minutes=15)
    if last < start:
        return spark.createDataFrame([], "stamp string")
    step = F.expr("interval 15 minutes")
    at = F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(last).cast("timestamp"), step))
    return spark.range(1).select(at.alias("at")).select(F.date_format("at", STAMP).alias("stamp"))


def parse_datetime(value: str) -> datetime:
    """``YYYYMMDD`` or ``YYYYMMDDHHMMSS``, also with the separators of ISO 8601."""
    digits = re.sub(r"[-:T]|Z$", "", value.strip())
    if not re.fullmatch(r"\d{8}(\d{6})?", digits):
        raise ValueError(f"expected YYYYMMDD or YYYYMMDDHHMMSS, got {value!r}")
    return datetime.strptime(digits.ljust(14, "0"), "%Y%m%d%H%M%S")


def parse_timespan(value: str) -> timedelta:
    """A number and a unit: min, h, d, w or m (30 days)."""
    found = re.fullmatch(r"(\d+)(min|h|d|w|m)", value.strip().lower())
    if not found:
        raise ValueError(f"can't read the time span {value!r}")
    return int(found[1]) * UNITS[found[2]]


def parse_window(value: str) -> datetime:
    at = datetime.fromisoformat(value.replace(" UTC", "+00:00"))
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def stamp(at: datetime) -> str:
    return at.strftime("%Y%m%dT%H%M%SZ")


def resolve_window(first: datetime, last: datetime, start: str | None = None, end: str | None = None, timespan: str | None = None) -> tuple[datetime, datetime]:
    """The requested window, both ends included, within what is there by default."""
    to = parse_datetime(end) if end else last
    if start:
        since = parse_datetime(start)
    else:
        since = to - parse_timespan(timespan) if timespan else first
    if since > to:
        raise ValueError("the window ends before it starts")
    return since, to
