"""Sketches that merge, kept as binary columns, and how far they are from the truth."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hll(col: str, lg_k: int = 12) -> Column:
    return F.hll_sketch_agg(col, F.lit(lg_k))


def hll_merge(sketches: DataFrame, keys: list[str], sketch: str = "sketch") -> DataFrame:
    """keys, estimate of stored sketches' union."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg(sketch)).alias("estimate"))


def kll(col: str, k: int = 200) -> Column:
    return F.expr(f"kll_sketch_agg_double(cast(`{col}` as double), {k})")


def kll_merge(sketches: DataFrame, keys: list[str], qs: dict[str, float], sketch: str = "sketch") -> DataFrame:
    """keys and quantiles of stored sketches merged."""
    merged = sketches.groupBy(*keys).agg(F.expr(f"kll_merge_agg_double(`{sketch}`)").alias("_s"))
    return merged.select(*keys, *(F.expr(f"kll_sketch_get_quantile_double(_s, {q}D)").alias(n) for n, q in qs.items()))


def within_rank(rows: DataFrame, keys: list[str], value: str, quantiles: DataFrame, qs: dict[str, float], bound: float) -> DataFrame:
    """keys and, for each name in qs, whether the value's true rank is within bound of the quantile."""
    both = rows.join(quantiles, keys) if keys else rows.crossJoin(quantiles)  # one row without keys
    near = lambda n, q: (F.avg((F.col(value) < F.col(n)).cast("double")) <= q + bound) & (F.avg((F.col(value) <= F.col(n)).cast("double")) >= q - bound)
    return both.groupBy(*keys).agg(*(near(n, q).alias(n) for n, q in qs.items()))


def theta_ops(df: DataFrame, col: str, a: str, b: str) -> DataFrame:
    """One row: estimates of union, intersection and difference of the distinct values where a holds and where b holds."""
    s = df.agg(F.expr(f"theta_sketch_agg(`{col}`) filter (where {a})").alias("a"), F.expr(f"theta_sketch_agg(`{col}`) filter (where {b})").alias("b"))
    return s.select(*(F.expr(f"theta_sketch_estimate(theta_{op}(a, b))").alias(op) for op in ("union", "intersection", "difference")))


def count_min(df: DataFrame, col: str, eps: float, confidence: float, seed: int = 1) -> DataFrame:
    """depth, bucket, n: a count-min table of ceil(2 / eps) buckets by rows that the confidence asks for. Tables of parts add up bucket by bucket."""
    width, depth = math.ceil(2 / eps), max(1, math.ceil(-math.log(1 - confidence) / math.log(2)))
    cells = F.array(*(F.struct(F.lit(d).alias("depth"), F.pmod(F.xxhash64(F.col(col), F.lit(seed * 1000 + d)), F.lit(width)).cast("int").alias("bucket")) for d in range(depth)))
    # values are counted first, so that a frequent one is hashed once a task
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_n"))
    return counts.select("_n", F.inline(cells)).groupBy("depth", "bucket").agg(F.sum("_n").alias("n"))


def count_min_estimate(table: DataFrame, values: DataFrame, col: str, eps: float, confidence: float, seed: int = 1) -> DataFrame:
    """values with estimate, never below the true count."""
    width, depth = math.ceil(2 / eps), max(1, math.ceil(-math.log(1 - confidence) / math.log(2)))
    cells = F.array(*(F.struct(F.lit(d).alias("depth"), F.pmod(F.xxhash64(F.col(col), F.lit(seed * 1000 + d)), F.lit(width)).cast("int").alias("bucket")) for d in range(depth)))
    asked = values.select(col, F.inline(cells))
    return asked.join(table, ["depth", "bucket"], "left").groupBy(col).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def heavy_hitters(df: DataFrame, col: str, k: int, most: int = 10_000) -> DataFrame:
    """item, count of the k most frequent values by mergeable summaries of most counters each; k is at most most.

    Values are dealt by hash to as many summaries as hold half their counters'
    number of distinct values each, so that none has to drop a value: one summary
    that drops values can't tell the frequent ones of many nearly equal counts.
    """
    rows = df.where(F.col(col).isNotNull()).select(col)
    distinct = rows.agg(F.approx_count_distinct(col)).first()[0]
    own = F.pmod(F.xxhash64(col), F.lit(math.ceil(2 * distinct / most) or 1)).alias("part")
    found = rows.groupBy(own).agg(F.expr(f"approx_top_k(`{col}`, {k}, {most})").alias("r")).select(F.explode("r").alias("r"))
    return found.select("r.item", "r.count").orderBy(F.desc("count"), "item").limit(k)


def accuracy_report(df: DataFrame, col: str, lg_ks: list[int]) -> DataFrame:
    """lg_k, estimate, exact, error (relative), bytes of distinct counts by size of sketch, in one pass over the rows."""
    row = df.agg(F.count_distinct(col).alias("exact"), *(hll(col, k).alias(f"s{k}") for k in lg_ks))
    cells = F.array(*(F.struct(F.lit(k).alias("lg_k"), F.hll_sketch_estimate(f"s{k}").alias("estimate"), F.length(f"s{k}").alias("bytes")) for k in lg_ks))
    out = row.select("exact", F.inline(cells))
    return out.withColumn("error", F.abs(F.col("estimate") - F.col("exact")) / F.col("exact"))
