"""Aggregates that are kept, merged and reported: partial statistics, top-ups, service levels, facets, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stats_part(df: DataFrame, keys: list[str], value: Column, extremes: Column | None = None) -> DataFrame:
    """keys, n, total, low, high: statistics that merge. Partition-wise or daily parts may be stored."""
    edge = value if extremes is None else extremes
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(edge).alias("low"), F.max(edge).alias("high"))


def stats_merge(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, total, low, high of the parts together."""
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))


def merge_sums(totals: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Stored totals with a batch's totals of the same columns added; new groups join."""
    sums = [c for c in totals.columns if c not in keys]
    return totals.unionByName(batch).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))


def slo(df: DataFrame, bucket: Column, within: Column, target: float) -> DataFrame:
    """bucket, attained (the share of rows within), burn (errors over the error budget) per window."""
    share = F.count_if(within).cast("double") / F.count("*")
    return df.groupBy(bucket.alias("bucket")).agg(share.alias("attained")).withColumn("burn", (1 - F.col("attained")) / (1 - target))


def facets(matches: DataFrame, col: str) -> DataFrame:
    """Counts of a column's values among the rows that a search matched, most frequent first in ties by value."""
    return matches.groupBy(col).agg(F.count("*").alias("n"))


def balances(transfers: DataFrame, id_col: str, debit: str, credit: str, amount: Column) -> DataFrame:
    """account, balance from transfers, each id once; balances add up to nothing."""
    once = transfers.dropDuplicates([id_col]).withColumn("_a", amount)
    sides = once.select(F.explode(F.array(F.struct(F.col(credit).alias("account"), F.col("_a").alias("v")), F.struct(F.col(debit).alias("account"), (-F.col("_a")).alias("v")))).alias("s"))
    return sides.groupBy("s.account").agg(F.sum("s.v").alias("balance"))


def region_report(df: DataFrame, region: str, value: str, big: float, limit: float, day: Column, exact: Column) -> DataFrame:
    """region, n, total, largest, big (rows above it), days, alert (whether the total passes the limit)."""
    return df.groupBy(region).agg(F.count("*").alias("n"), F.sum(exact).cast("double").alias("total"), F.max(value).alias("largest"), F.count_if(F.col(value) > big).alias("big"), F.count_distinct(day).alias("days"), (F.sum(exact) > limit).alias("alert"))


def downsample(df: DataFrame, keys: list[str], ts: str, unit: str, *aggs: Column) -> DataFrame:
    """start, keys and aggregates of each series and bucket of time."""
    return df.groupBy(F.date_trunc(unit, ts).cast("timestamp_ntz").alias("start"), *keys).agg(*aggs)


def latest_features(rows: DataFrame, key: str, ts: str, tie: str, value: str, oldest: Column | DataFrame) -> DataFrame:
    """key, value (null once older than oldest) and fresh, of each entity's newest row. oldest: a time, or a table of one row and column."""
    newest = rows.groupBy(key).agg(F.max_by(value, F.struct(ts, tie)).alias("value"), F.max(ts).alias("ts"))
    out = newest.crossJoin(oldest.toDF("_old")) if isinstance(oldest, DataFrame) else newest.withColumn("_old", oldest)  # one row
    fresh = F.col("ts") >= F.col("_old")
    return out.select(key, F.when(fresh, F.col("value")).alias("value"), fresh.alias("fresh"))


def leakage_report(labels: DataFrame, features: DataFrame, key: str, label_id: str, label_ts: str, feature_ts: str) -> DataFrame:
    """label_id and leaks: whether joining each entity's latest feature, whatever the label's time, takes a value from its future."""
    newest = features.groupBy(key).agg(F.max(feature_ts).alias("_newest"))
    return labels.join(newest, key, "left").select(label_id, F.coalesce(F.col("_newest") > F.col(label_ts), F.lit(False)).alias("leaks"))


def also_bought(bought: DataFrame, buyer: str, item: str, asked: object) -> DataFrame:
    """also, buyers: other items of those who bought the asked one, by distinct buyers."""
    once = bought.select(buyer, item).distinct()
    who = once.where(F.col(item) == F.lit(asked)).select(buyer)
    return once.where(F.col(item) != F.lit(asked)).join(who, buyer, "left_semi").groupBy(F.col(item).alias("also")).agg(F.count("*").alias("buyers"))


def trailing_rate(df: DataFrame, key: str, seconds: Column, window: int) -> Column:
    """Rows of the key in the window seconds before and at each row's second."""
    return F.count("*").over(Window.partitionBy(key).orderBy(seconds).rangeBetween(-window, 0))
