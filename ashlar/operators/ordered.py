"""What depends on an order: previous rows, versions, lifecycles, quantiles, and scans of hot keys in ranges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ashlar.lineage import cut


def previous(df: DataFrame, keys: list[str], order: list[str], col: str, name: str = "previous") -> DataFrame:
    """df with the column's value in the row before, of the same keys."""
    return df.withColumn(name, F.lag(col).over(Window.partitionBy(*keys).orderBy(*order)))


def unchanged_versions(df: DataFrame, key: str, ts: str, digest: Column) -> DataFrame:
    """Versions whose digest equals the one before: there should be none."""
    by_time = Window.partitionBy(key).orderBy(ts)
    return df.withColumn("_d", digest).withColumn("_p", F.lag("_d").over(by_time)).where("_d = _p").drop("_d", "_p")


def lifecycle_audit(events: DataFrame, key: str, seq: str, state: str, allowed: list[str]) -> DataFrame:
    """key, path, ok: whether the states of each key come, each at its first time, in the allowed order, without leaps.

    A path ends with the first state beyond as many as are allowed: the key has
    failed by then, and no path grows with a key's events or states.
    """
    first = events.groupBy(key, state).agg(F.min(seq).alias("_at"))
    first = first.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_at", state))).where(F.col("_n") <= len(allowed) + 1)
    path = F.transform(F.array_sort(F.collect_list(F.struct(F.col("_at"), F.col(state).alias("s")))), lambda x: x["s"])
    want = F.slice(F.array(*map(F.lit, allowed)), F.lit(1), F.size("path"))
    return first.groupBy(key).agg(path.alias("path")).withColumn("ok", F.col("path") == want)


def sort_by(df: DataFrame, spec: list[tuple[str, bool]]) -> DataFrame:
    """df in order of (column, descending) pairs, nulls last either way."""
    return df.orderBy(*(F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in spec))


def in_ranges(df: DataFrame, order: list[str], ranges: int) -> DataFrame:
    """df, written, with _range: rows dealt by ranges of order, so that a key of any size is spread over many tasks."""
    dealt = df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    return cut(dealt, "ranges")


def carried_total(df: DataFrame, keys: list[str], order: list[str], value: Column, ranges: int, name: str = "running") -> DataFrame:
    """df with the running total of value by keys, ROWS up to this one. Each range is scanned alone; the totals of the ranges before it are added."""
    dealt = in_ranges(df.withColumn("_v", value), [*keys, *order], ranges)
    ends = dealt.groupBy(*keys, "_range").agg(F.sum("_v").alias("_t"))  # ranges x the keys that lie in them
    before = ends.withColumn("_before", F.sum("_t").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.sum("_v").over(Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = dealt.withColumn("_own", own).join(before.select(*keys, "_range", "_before"), [*keys, "_range"])
    return out.withColumn(name, F.col("_own") + F.coalesce("_before", F.lit(0))).select(*df.columns, name)


def carried_previous(df: DataFrame, keys: list[str], order: list[str], value: Column, ranges: int, name: str = "previous") -> DataFrame:
    """df with value in the row before, of the same keys, by order, which must tell rows apart. Each range is scanned alone; its first row takes what the range before it ended with."""
    dealt = in_ranges(df.withColumn("_v", F.struct(value.alias("v"))), [*keys, *order], ranges)
    ends = dealt.groupBy(*keys, "_range").agg(F.max_by("_v", F.struct(*order)).alias("_e"))  # ranges x the keys that lie in them
    before = ends.withColumn("_before", F.lag("_e").over(Window.partitionBy(*keys).orderBy("_range")))
    own = F.lag("_v").over(Window.partitionBy(*keys, "_range").orderBy(*order))
    out = dealt.withColumn("_own", own).join(before.select(*keys, "_range", "_before"), [*keys, "_range"])
    return out.withColumn(name, F.coalesce("_own", "_before")["v"]).select(*df.columns, name)


def unchanged_in_ranges(df: DataFrame, key: str, order: list[str], digest: Column, ranges: int) -> DataFrame:
    """unchanged_versions() for hot keys."""
    return carried_previous(df.withColumn("_d", digest), [key], order, F.col("_d"), ranges, "_p").where("_d = _p").drop("_d", "_p")


def sequence_audit_in_ranges(df: DataFrame, key: str, seq: str, ts: str, ranges: int) -> DataFrame:
    """key, n, gaps (steps of seq over 1), disorders (ts before the one of the row before, by seq), for hot keys."""
    rows = carried_previous(df.select(key, seq, ts), [key], [seq], F.struct(F.col(seq).alias("s"), F.col(ts).alias("t")), ranges, "_p")
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(seq) - F.col("_p.s") > 1).alias("gaps"), F.count_if(F.col(ts) < F.col("_p.t")).alias("disorders"))


def sessions_in_ranges(df: DataFrame, key: str, at: Column, order: list[str], gap: int, ranges: int) -> DataFrame:
    """key, start, last, n of the runs of rows of a key with less than gap between neighbours; at: a whole number, first in order of time, then order. A session may lie over several ranges."""
    rows = df.withColumn("_at", at)
    order = ["_at", *order]
    rows = carried_previous(rows.select(key, *order), [key], order, F.col("_at"), ranges, "_p")
    fresh = F.when(F.col("_at") - F.col("_p") < gap, 0).otherwise(1)
    numbered = carried_total(rows.withColumn("_f", fresh), [key], order, F.col("_f"), ranges, "_s")
    return numbered.groupBy(key, "_s").agg(F.min("_at").alias("start"), F.max("_at").alias("last"), F.count("*").alias("n")).drop("_s")


def trailing_count(df: DataFrame, key: str, at: Column, width: int, ranges: int, name: str = "n") -> DataFrame:
    """df with the rows of its key from width before it (inclusive) up to its own time, rows of one time together.

    Rows are dealt by ranges of key and time; every range also gets, as a halo,
    the rows of its first key that lie less than width before its beginning, so
    each counts alone. The bounds, one a range, are what the driver sees.
    """
    dealt = in_ranges(df.withColumn("_at", at), [key, "_at"], ranges)
    first = dealt.groupBy("_range").agg(F.min_by(F.struct(F.col(key).alias("k"), F.col("_at").alias("a")), F.struct(F.col(key), F.col("_at"))).alias("b")).select(F.col("_range").alias("_to"), F.col("b.k").alias("_k"), F.col("b.a").alias("_a"))
    halo = dealt.select(key, "_at", "_range").join(F.broadcast(first), (F.col(key) == F.col("_k")) & (F.col("_at") < F.col("_a")) & (F.col("_at") >= F.col("_a") - width) & (F.col("_range") < F.col("_to")))
    rows = dealt.withColumn("_own", F.lit(True)).unionByName(halo.select(key, "_at", F.col("_to").alias("_range"), F.lit(False).alias("_own")), allowMissingColumns=True)
    window = Window.partitionBy(key, "_range").orderBy("_at").rangeBetween(-width, 0)
    return rows.withColumn(name, F.count("*").over(window)).where("_own").select(*df.columns, name)


def rate_peaks(counted: DataFrame, key: str, limits: DataFrame, limit: str, name: str = "n") -> DataFrame:
    """key, peak, limit, over: each key's highest trailing count beside its plan's limit; keys without a limit are never over."""
    peaks = counted.groupBy(key).agg(F.max(name).alias("peak"))
    return peaks.join(limits.select(key, limit), key, "left").withColumn("over", F.coalesce(F.col("peak") > F.col(limit), F.lit(False)))


def quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], ranges: int = 64, between: bool = False) -> DataFrame:
    """keys and the exact quantiles named in qs: the ceil(q x n)-th value, or interpolated between neighbours.

    Values are counted first, so no task holds a group's values: the distinct
    ones are dealt by ranges, and running counts carry over from range to range.
    """
    rows = df.where(F.col(value).isNotNull())
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    run = carried_total(counts, keys, [value], F.col("_n"), ranges, "_upto")
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    run = run.join(sizes, keys) if keys else run.crossJoin(sizes)  # one row without keys
    holds = lambda place: (F.col("_upto") >= place) & (F.col("_upto") - F.col("_n") < place)
    aggs = []
    for name, q in qs.items():
        if between:
            at = 1 + (F.col("_size") - 1) * F.lit(q)
            low, high = F.floor(at), F.ceil(at)
            a, b = F.max(F.when(holds(low), F.col(value))), F.max(F.when(holds(high), F.col(value)))
            share = F.max(at - low)
            aggs.append((a + (b - a) * share).alias(name))
        else:
            place = F.greatest(F.ceil(F.col("_size") * F.lit(q)), F.lit(1))
            aggs.append(F.max(F.when(holds(place), F.col(value))).alias(name))
    return run.groupBy(*keys).agg(*aggs)


def histogram(df: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """keys, counts (rows at or below each bound, then all) in one pass."""
    below = [F.count_if(F.col(value) <= b) for b in bounds]
    return df.groupBy(*keys).agg(F.array(*below, F.count(value)).alias("counts"))


def histogram_quantile(counts: Column, bounds: list[float], q: float) -> Column:
    """The quantile by linear interpolation inside its bucket, from 0; the last bound where it lies beyond."""
    edges = F.array(F.lit(0.0), *(F.lit(float(b)) for b in bounds))
    target = F.lit(q) * F.element_at(counts, -1)
    at = F.size(F.filter(F.slice(counts, 1, len(bounds)), lambda c: c < target))  # whole buckets below the target
    before = F.when(at > 0, F.get(counts, at - 1)).otherwise(0)
    inside = F.get(counts, at) - before
    value = F.get(edges, at) + (F.get(edges, at + 1) - F.get(edges, at)) * (target - before) / F.nullif(inside, F.lit(0))
    return F.when(at >= len(bounds), F.lit(float(bounds[-1]))).otherwise(value)


def share_within(counts: Column, bounds: list[float], bound: float) -> Column:
    """The share of rows at or below a bound of the histogram."""
    return F.get(counts, F.lit(bounds.index(bound))) / F.nullif(F.element_at(counts, -1), F.lit(0))


def combine_per_key(df: DataFrame, keys: list[str], init: Callable[[], list[float]], add: Callable[[list[float], tuple], list[float]], merge: Callable[[list[float], list[float]], list[float]], cols: list[str], held: int = 100_000, spread: int = 64) -> DataFrame:
    """keys, acc (array of doubles): an aggregate that the user defines by init(), add(acc, row of cols) and merge(acc, acc).

    Every task folds its rows to one accumulator a key and hands them on when it
    holds more than held keys; those of a key are merged in spread groups first,
    then into one.
    """
    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", acc array<double>"

    def fold(batches):
        accs: dict[tuple, list[float]] = {}
        for pdf in batches:
            for k, row in zip(pdf[keys].itertuples(index=False, name=None), pdf[cols].itertuples(index=False, name=None), strict=True):
                accs[k] = add(accs[k] if k in accs else init(), row)
            if len(accs) > held:
                yield pd.DataFrame([(*k, acc) for k, acc in accs.items()], columns=[*keys, "acc"])
                accs = {}
        yield pd.DataFrame([(*k, acc) for k, acc in accs.items()], columns=[*keys, "acc"])

    def join(batches):
        key, acc = None, None  # of the run of rows at hand: rows come in order of their keys
        for pdf in batches:
            done = []
            for k, x in zip(pdf[keys].itertuples(index=False, name=None), pdf["acc"], strict=True):
                k = tuple(None if pd.isna(v) else v for v in k)
                if k != key:
                    done += [] if key is None else [(*key, acc)]
                    key, acc = k, init()
                acc = merge(acc, list(x))
            yield pd.DataFrame(done, columns=[*keys, "acc"])
        if key is not None:
            yield pd.DataFrame([(*key, acc)], columns=[*keys, "acc"])

    return in_two_steps(df.select(*keys, *cols).mapInPandas(fold, schema), keys, join, schema, spread)


def in_two_steps(partial: DataFrame, keys: list[str], join: Callable, schema: str, spread: int) -> DataFrame:
    """Partial states merged by join in spread groups a key (by hash of the task that made them), then a key's groups into one. join gets a task's rows sorted by key, so that a key costs no call of its own."""
    part = F.pmod(F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(spread))
    dealt = partial.withColumn("_part", part).repartition(*keys, "_part").drop("_part").sortWithinPartitions(*keys)
    return dealt.mapInPandas(join, schema).repartition(*keys).sortWithinPartitions(*keys).mapInPandas(join, schema)


def batch_aggregate(df: DataFrame, keys: list[str], state: Callable, merge: dict[str, str], spread: int = 64) -> DataFrame:
    """keys and the columns of merge: an aggregate that the user defines over whole batches.

    state makes of a pandas batch (keys and the columns it reads) one double a
    row for each column of merge; merge names how states of one key come together
    (sum, min, max, prod). A batch gives one row a key, so no task holds a group.
    """
    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"`{c}` double" for c in merge)])

    def fold(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.concat([pdf[keys], state(pdf)[list(merge)]], axis=1).groupby(keys, dropna=False, as_index=False).agg(merge)

    # a batch's states are few and plain doubles: the engine merges them, first where they are made, then by key
    how = {"sum": F.sum, "min": F.min, "max": F.max, "prod": F.product}
    dealt = df.mapInPandas(fold, schema).withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(spread)))
    parts = dealt.groupBy(*keys, "_part").agg(*(how[m](c).alias(c) for c, m in merge.items()))
    return parts.groupBy(*keys).agg(*(how[m](c).alias(c) for c, m in merge.items()))
