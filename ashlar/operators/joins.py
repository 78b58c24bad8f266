"""Joins beyond the built-in equi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ashlar.operators.ordered import in_ranges


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], compare: str) -> DataFrame:
    """Full outer join with status: left_only, right_only, mismatch or ok."""
    left, right = a.select(*keys, F.col(compare).alias("left_value"), F.lit(1).alias("_l")), b.select(*keys, F.col(compare).alias("right_value"), F.lit(1).alias("_r"))
    status = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").when(~F.col("left_value").eqNullSafe(F.col("right_value")), "mismatch").otherwise("ok")
    return left.join(right, keys, "full_outer").withColumn("status", status).drop("_l", "_r")


def top_n_per(parents: DataFrame, children: DataFrame, on: str, order: list[Column], n: int, how: str = "inner") -> DataFrame:
    """Each parent with its n first children; children are ranked before the join."""
    ranked = children.withColumn("rn", F.row_number().over(Window.partitionBy(on).orderBy(*order))).where(F.col("rn") <= n)
    return parents.join(ranked, on, how)


#: Bins of a level are so many times as wide as those of the level below.
STEP = 16


def _level(length: Column, bin_width: int) -> Column:
    """The level whose bins are at least as wide as a range, so that it lies in two of them at most."""
    out = F.lit(0)
    for level in range(1, 16):
        if bin_width * STEP ** (level - 1) < 2**62:
            out = F.when(length > bin_width * STEP ** (level - 1), level).otherwise(out)
    return out


def _width(level: Column, bin_width: int, top: int) -> Column:
    return F.element_at(F.array(*(F.lit(bin_width * STEP**i).cast("long") for i in range(top + 1))), level + 1) if top else F.lit(bin_width)


def overlap_join(a: DataFrame, b: DataFrame, key: str, start: str, end: str, bin_width: int) -> DataFrame:
    """Pairs whose half-open integer ranges [start, end) meet, with the intersection.

    Ranges are dealt to bins, so that a hot key isn't paired wholly. Bins come
    in levels: a range is in the level of its length, where it lies in one or
    two bins, and in all coarser ones that are in use, so a range of any length
    gives few rows. A pair meets in the coarser of its two levels, in the bin
    where its intersection begins. b's columns are prefixed with other_.
    """
    fits = lambda df: df.where(F.col(start) < F.col(end)).withColumn("_own", _level(F.col(end) - F.col(start), bin_width))
    sides = [fits(a), fits(b)]
    top = sides[0].select("_own").union(sides[1].select("_own")).agg(F.coalesce(F.max("_own"), F.lit(0))).first()[0]

    def deal(df: DataFrame) -> DataFrame:
        rows = df.withColumn("_level", F.explode(F.sequence(F.col("_own"), F.lit(top)))) if top else df.withColumn("_level", F.lit(0))
        width = _width(F.col("_level"), bin_width, top)
        return rows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))

    left, right = map(deal, sides)
    right = right.select(*(F.col(c).alias(c if c in (key, "_bin", "_level") else f"other_{c}") for c in right.columns))
    lo, hi = F.greatest(start, f"other_{start}"), F.least(end, f"other_{end}")
    met = (lo < hi) & (F.col("_level") == F.greatest("_own", "other__own")) & (F.col("_bin") == F.floor(lo / _width(F.col("_level"), bin_width, top)))
    return left.join(right, [key, "_level", "_bin"]).where(met).withColumns({"from_": lo, "to_": hi}).drop("_bin", "_level", "_own", "other__own")


def contains_join(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str, bin_width: int) -> DataFrame:
    """Points with the ranges [start, end) of their key that contain them. A range is in the one or two bins of its level, a point in one bin of each level in use."""
    fits = ranges.where(F.col(start) < F.col(end)).withColumn("_level", _level(F.col(end) - F.col(start), bin_width))
    top = fits.agg(F.coalesce(F.max("_level"), F.lit(0))).first()[0]
    width = _width(F.col("_level"), bin_width, top)
    binned = fits.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    dealt = points.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(top))) if top else F.lit(0)).withColumn("_bin", F.floor(F.col(at) / width))
    return dealt.join(binned, [key, "_level", "_bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bin", "_level")


def _seconds(n: int) -> Column:
    """A span of time, exact to the microsecond and whatever the time zone."""
    return F.make_dt_interval(secs=F.lit(n).cast("decimal(18,6)"))


def asof_join(left: DataFrame, right: DataFrame, on: str, left_ts: str, right_ts: str, values: list[str], ttl_seconds: int | None = None, tie: str | None = None, ranges: int | None = None) -> DataFrame:
    """left with the values of the latest right row at or before left_ts.

    Both sides meet in one window per key, in order of time, so no range join
    is needed. Rows older than ttl_seconds (inclusive, to the microsecond) give
    nulls; among equal times the largest tie wins. Where keys may be hot, ranges deals each key's
    time line to so many tasks; what a range ends with is carried to the next.
    """
    tied = F.col(tie) if tie else F.lit(None).cast("bigint")
    lefts = left.select(F.col(on), F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType if tie else "bigint").alias("_tie"), F.struct(*left.columns).alias("_row"))
    rights = right.select(F.col(on), F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), tied.alias("_tie"), F.struct(F.col(right_ts).alias("_at"), *values).alias("_found"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    by_time = ["_ts", "_side", F.col("_tie").asc_nulls_first()]
    if ranges:
        both = in_ranges(both, [on, "_ts"], ranges)
    parts = [on, "_range"] if ranges else [on]
    order = Window.partitionBy(*parts).orderBy(*by_time).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_f", F.last("_found", ignorenulls=True).over(order))
    if ranges:
        found = F.max_by("_found", F.when(F.col("_side") == 0, F.struct("_ts", "_tie"))).alias("_end")
        ends = both.groupBy(*parts).agg(found)
        before = F.last("_end", ignorenulls=True).over(Window.partitionBy(on).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
        out = out.join(ends.select(*parts, before.alias("_before")), parts).withColumn("_f", F.coalesce("_f", "_before"))
    out = out.where("_side = 1")
    fresh = F.col("_f").isNotNull()
    if ttl_seconds is not None:
        fresh &= F.col("_ts") - F.col("_f")["_at"] <= _seconds(ttl_seconds)
    return out.select("_row.*", *(F.when(fresh, F.col("_f")[v]).alias(v) for v in values))


def historical_features(labels: DataFrame, key: str, ts: str, views: dict[str, tuple[DataFrame, str, list[str], str | None, int | None]], ranges: int | None = None) -> DataFrame:
    """labels with view__value for each value of each view: its newest row of the key at or before the label's time, in one shuffle of all of them.

    views: name to (rows, time, values, tie, seconds to live): of rows of one time
    that with the greatest tie is taken; older than its time to live it is null.
    Null keys meet none. ranges: for hot keys, rows are dealt by ranges of key and
    time, and each takes over what the ranges before it ended with.
    """
    parts = [labels.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*labels.columns).alias("_row"))]
    for i, (rows, at, values, tie, _) in enumerate(views.values()):
        tied = [F.struct(tie).alias(f"_tie{i}")] if tie else []
        parts.append(rows.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_key"), F.col(at).alias("_ts"), F.lit(0).alias("_side"), *tied, F.struct(F.col(at).alias("_at"), *values).alias(f"_v{i}")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    by = ["_key"]
    if ranges:
        both, by = in_ranges(both, ["_key", "_ts"], ranges), ["_key", "_range"]
    ties = [f"_tie{i}" for i, v in enumerate(views.values()) if v[3]]
    before = Window.partitionBy(*by).orderBy("_ts", "_side", *(F.col(x).asc_nulls_first() for x in ties)).rowsBetween(Window.unboundedPreceding, 0)
    found = {f"_f{i}": F.last(f"_v{i}", ignorenulls=True).over(before) for i in range(len(views))}
    out = both.withColumns(found)
    if ranges:
        last = [F.max_by(f"_v{i}", F.when(F.col(f"_v{i}").isNotNull(), F.struct("_ts", *([f"_tie{i}"] if f"_tie{i}" in ties else [])))).alias(f"_e{i}") for i in range(len(views))]
        ends = both.where("_side = 0").groupBy(*by).agg(*last)
        all_ = both.select(*by).distinct().join(ends, by, "left")  # ranges x the keys that lie in them
        so_far = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        carried = all_.select(*by, *(F.last(f"_e{i}", ignorenulls=True).over(so_far).alias(f"_b{i}") for i in range(len(views))))
        out = out.where("_side = 1").join(carried, by, "left").withColumns({f"_f{i}": F.coalesce(f"_f{i}", f"_b{i}") for i in range(len(views))})
    columns = []
    for i, (name, (_, _, values, _, ttl)) in enumerate(views.items()):
        age = F.col("_ts") - F.col(f"_f{i}")["_at"]
        fresh = F.lit(True) if ttl is None else age <= _seconds(ttl)
        columns += [F.when(fresh, F.col(f"_f{i}")[v]).alias(f"{name}__{v}") for v in values]
    return out.where("_side = 1").select("_row.*", *columns)


def enrich_or_reject(df: DataFrame, dim: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(enriched rows, rows whose key the dimension lacks, with a reason)."""
    known = dim.withColumn("_known", F.lit(True))
    joined = df.join(known, on, "left")
    good = joined.where("_known").drop("_known")
    bad = joined.where("_known is null").select(*df.columns).withColumn("reason", F.concat(F.lit("unknown " + on + " "), F.coalesce(F.col(on).cast("string"), F.lit("null"))))
    return good, bad


def join_dim(fact: DataFrame, dim: DataFrame, on: str, how: str = "left", most_bytes: int = 64 << 20) -> DataFrame:
    """fact with a dimension: broadcast if its rows, measured as text and by their fixed parts, have no more than most_bytes, else left to the engine."""
    fixed = 8 * (len(dim.columns) + 2)
    size = dim.agg(F.sum(F.length(F.to_json(F.struct(*dim.columns))) + fixed).alias("n")).first()["n"] or 0
    return fact.join(F.broadcast(dim) if size <= most_bytes else dim, on, how)


def maintain_join(view: DataFrame, left: DataFrame, right: DataFrame, changed: DataFrame, on: str) -> DataFrame:
    """The view left x right after a batch of changes: rows of changed keys are made anew from both sides' latest state, others stay."""
    keys = changed.select(on).distinct()
    new = left.join(keys, on, "left_semi").join(right.join(keys, on, "left_semi"), on)
    return view.join(keys, on, "left_anti").unionByName(new.select(view.columns))


def not_in(a: DataFrame, b: DataFrame, col: str, other: str) -> DataFrame:
    """Rows of a whose col is NOT IN b's other: none if b has a null, and none of a's nulls unless b is empty.

    One look at b for a null and for emptiness, then a plain anti join, so that
    b isn't broadcast whatever its size.
    """
    first = b.agg(F.count_if(F.col(other).isNull()).alias("nulls"), F.count("*").alias("n")).first()
    if first["nulls"]:
        return a.limit(0)
    rows = a.where(F.col(col).isNotNull()) if first["n"] else a
    right = b.select(F.col(other).alias("_other")).distinct()
    return rows.join(right, F.col(col) == F.col("_other"), "left_anti")


def repair_rollup(base: DataFrame, rollup: DataFrame, touched: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """A rollup after deletes and updates in base: touched groups computed anew, groups that are empty now dropped."""
    these = touched.select(*keys).distinct()
    again = base.join(these, keys, "left_semi").groupBy(*keys).agg(*aggs)
    return rollup.join(these, keys, "left_anti").unionByName(again)
