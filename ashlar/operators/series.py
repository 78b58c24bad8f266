"""Time series: slices, stored rollups that refresh, calendars without holes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(ts: str, unit: str) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def refresh_rollup(rollup: DataFrame, rows: DataFrame, changed: DataFrame, ts: str, unit: str, keys: list[str], *aggs: Column) -> DataFrame:
    """A stored rollup (bucket, keys, aggregates) with the buckets that hold a changed row made again from rows; others aren't read."""
    touched = changed.select(bucket(ts, unit).alias("bucket"), *keys).distinct()
    again = rows.withColumn("bucket", bucket(ts, unit)).join(touched, ["bucket", *keys], "left_semi").groupBy("bucket", *keys).agg(*aggs)
    return rollup.join(touched, ["bucket", *keys], "left_anti").unionByName(again)


def series_slice(df: DataFrame, key: str, value: object, ts: str, begin: Column, end: Column) -> DataFrame:
    """One series from begin up to, not with, end, in order of time; both conditions reach the scan."""
    return df.where((F.col(key) == F.lit(value)) & (F.col(ts) >= begin) & (F.col(ts) < end)).orderBy(ts)


def fill_calendar(counts: DataFrame, keys: list[str], day: str, values: list[str]) -> DataFrame:
    """counts with a row for every day between the first and the last, for each of the keys; 0 where there was none."""
    span = counts.agg(F.min(day).alias("_a"), F.max(day).alias("_b")).select(F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(day))
    grid = counts.select(*keys).distinct().crossJoin(span) if keys else span  # keys x days, which is the result's size
    return grid.join(counts, [*keys, day], "left").fillna(0, values)
