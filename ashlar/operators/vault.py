"""Hubs, links, satellites and what is read from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ashlar.functions import every


def load_keys(target: DataFrame, staged: DataFrame, keys: list[str], load_date: str) -> DataFrame:
    """Rows to append to a hub (one key) or link (several): staged keys the target lacks, with their first load date."""
    known = target.where(every(*(F.col(k).isNotNull() for k in keys))).select(*keys, F.lit(None).cast(staged.schema[load_date].dataType).alias(load_date), F.lit(True).alias("_known"))
    both = staged.select(*keys, load_date, F.lit(False).alias("_known")).unionByName(known)  # a key with a null equals none of the target
    return both.groupBy(*keys).agg(F.min(load_date).alias(load_date), F.bool_or("_known").alias("_known")).where("not _known").drop("_known")


def load_satellite(satellite: DataFrame, staged: DataFrame, key: str, attributes: list[str], load_date: str) -> DataFrame:
    """Rows to append: staged rows whose attributes differ from the key's latest version, nulls being equal."""
    latest = satellite.groupBy(key).agg(F.max_by(F.struct(*attributes), load_date).alias("_now"))
    joined = staged.join(latest, key, "left")
    return joined.where(F.col("_now").isNull() | ~F.struct(*attributes).eqNullSafe(F.col("_now"))).select(key, *attributes, load_date)


def point_in_time(hub: DataFrame, satellites: dict[str, DataFrame], dates: DataFrame, key: str, as_of: str, load_date: str) -> DataFrame:
    """For each key and date, every satellite's latest load date up to then. dates: a short list of one row a date.

    Keys and dates are the result's size. A satellite's loads join them in one
    window a key, in order of time, so that no date meets all loads of its key.
    """
    out = hub.select(key).join(dates.select(as_of))
    so_far = Window.partitionBy(key).orderBy(as_of, "_asks").rowsBetween(Window.unboundedPreceding, 0)
    for name, sat in satellites.items():
        loads = sat.select(key, F.col(load_date).alias(as_of), F.col(load_date).alias("_at"), F.lit(0).alias("_asks")).distinct()
        both = out.withColumn("_asks", F.lit(1)).unionByName(loads, allowMissingColumns=True)
        both = both.withColumn(name, F.last("_at", ignorenulls=True).over(so_far)).where("_asks = 1")
        out = both.drop("_at", "_asks")
    return out


def as_of_view(pit: DataFrame, satellites: dict[str, tuple[DataFrame, list[str]]], key: str, load_date: str) -> DataFrame:
    """The versions a point-in-time table names: an equi join on key and load date for each satellite."""
    out = pit
    for name, (sat, columns) in satellites.items():
        out = out.join(sat.select(key, F.col(load_date).alias(name), *columns), [key, name], "left")
    return out


def load_audit(tables: dict[str, DataFrame], load_date: str) -> DataFrame:
    """Rows of each table and load date, and the table's total."""
    counts = reduce(DataFrame.unionByName, (t.groupBy(load_date).agg(F.count("*").alias("delivered")).withColumn("name", F.lit(n)) for n, t in tables.items()))
    return counts.withColumn("total", F.sum("delivered").over(Window.partitionBy("name")))


def bridge(link_a: DataFrame, link_b: DataFrame, on: str, keys: list[str]) -> DataFrame:
    """keys and lines: two links joined through the hub that they share."""
    return link_a.join(link_b, on).groupBy(*keys).agg(F.count("*").alias("lines"))


def star_mart(facts: DataFrame, dims: list[tuple[DataFrame, str, str]], columns: list[str]) -> DataFrame:
    """Facts with the columns of dimensions, each a (table, key in facts or an earlier dimension, key in the table)."""
    out = facts
    for dim, left, right in dims:
        out = out.join(dim, F.col(left) == F.col(right))
    return out.select(*columns)
