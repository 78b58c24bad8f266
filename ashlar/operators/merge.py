"""Merge, history and change data over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union(*dfs: DataFrame) -> DataFrame:
    """Rows of all tables, columns by name; what a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The newest row of each key by the columns of order."""
    newest = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], when_newer: list[str] | None = None, precombine: str | None = None, delete_flag: str | None = None) -> DataFrame:
    """target with source merged in by key.

    precombine: of several source rows of a key the highest counts. when_newer:
    a source row replaces only an older one. delete_flag: source rows where it
    holds remove theirs. A null key equals a null key. Without precombine the
    source has each key once: a key that it repeats gives a row for each.
    """
    if precombine:
        source = latest(source, keys, precombine)
    flag = F.coalesce(F.col(f"s.{delete_flag}"), F.lit(False)) if delete_flag else F.lit(False)
    t, s = target.select(F.struct(*target.columns).alias("t"), *keys), source.select(F.struct(*source.columns).alias("s"), *keys)
    newer = F.struct(*(F.col(f"s.{c}") for c in when_newer)) > F.struct(*(F.col(f"t.{c}") for c in when_newer)) if when_newer else F.lit(True)
    wins = F.col("s").isNotNull() & (F.col("t").isNull() | newer)
    right = s.select("s", *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    joined = t.join(right, same, "full_outer").where(~(wins & flag))
    return joined.select(*(F.when(wins, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in target.columns))


def insert_new(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(source.join(target, keys, "left_anti"))


def replace_slice(target: DataFrame, source: DataFrame, slice_: Column) -> DataFrame:
    """target with the rows where slice_ holds replaced by source."""
    return target.where(~F.coalesce(slice_, F.lit(False))).unionByName(source)


def table_diff(before: DataFrame, after: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """keys and change: insert, update, delete or same."""
    b, a = (df.select(*keys, F.struct(*cols).alias(n), F.lit(1).alias(f"_{n}")) for df, n in ((before, "old"), (after, "new")))
    change = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("update")
    return b.join(a, keys, "full_outer").withColumn("change", change).drop("_old", "_new")


def change_feed(before: DataFrame, after: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Rows with _change_type: insert, update_preimage, update_postimage or delete."""
    d = table_diff(before, after, keys, cols).where("change <> 'same'")
    image = lambda kind, row: F.struct(F.lit(kind).alias("_change_type"), F.col(row).alias("row"))
    images = F.when(F.col("change") == "insert", F.array(image("insert", "new"))).when(F.col("change") == "delete", F.array(image("delete", "old"))).otherwise(F.array(image("update_preimage", "old"), image("update_postimage", "new")))
    return d.select(*keys, F.explode(images).alias("i")).select(*keys, "i._change_type", "i.row.*")


def as_of(history: DataFrame, keys: list[str], version: str, at: int, deleted: str) -> DataFrame:
    """The state of an append-only history at a version."""
    return latest(history.where(F.col(version) <= at), keys, version).where(~F.col(deleted)).drop(version, deleted)


def apply_cdc(state: DataFrame, events: DataFrame, key: str, seq: str, op: str = "op") -> DataFrame:
    """state after create, update, read and delete events (c, u, r, d); the last event of a key counts."""
    last = latest(events, [key], seq).withColumn("_gone", F.col(op) == "d")
    return upsert(state, last, [key], delete_flag="_gone")


def compact(log: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """Last value of each key; a null value removes it."""
    return latest(log, [key], seq).where(F.col(value).isNotNull())


def consolidate(delta: DataFrame, weight: str = "weight") -> DataFrame:
    """Weights of equal rows summed, zeros dropped."""
    return delta.groupBy(*(c for c in delta.columns if c != weight)).agg(F.sum(weight).alias(weight)).where(F.col(weight) != 0)


def fold_changelog(changes: DataFrame, kind: str = "kind") -> DataFrame:
    weight = F.when(F.col(kind).isin("INSERT", "UPDATE_AFTER"), 1).otherwise(-1)
    return consolidate(changes.withColumn("weight", weight).drop(kind))


def recompute_touched(aggregates: DataFrame, state: DataFrame, touched: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """aggregates with the touched groups computed anew from state; empty groups go."""
    new = state.join(touched.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(*aggs)
    return aggregates.join(touched.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def load_since(source: DataFrame, updated: str, id_col: str, after: tuple, until: object) -> DataFrame:
    """Rows past the watermark (updated, id) and not after until."""
    past = (F.col(updated) > F.lit(after[0])) | ((F.col(updated) == F.lit(after[0])) & (F.col(id_col) > F.lit(after[1])))
    return source.where(past & (F.col(updated) <= F.lit(until)))


def align_schema(df: DataFrame, target: dict[str, str], renames: dict[str, str] | None = None, defaults: dict[str, object] | None = None) -> DataFrame:
    """df with target's columns and types: renamed, cast, or filled with a default or null."""
    old = {new: name for name, new in (renames or {}).items()}
    have = set(df.columns)
    pick = lambda c: F.col(old.get(c, c)) if old.get(c, c) in have else F.lit((defaults or {}).get(c))
    return df.select(*(pick(c).cast(t).alias(c) for c, t in target.items()))


def first_seen(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key by the columns of order."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select(*keys, "_r.*").select(df.columns)


def checksum(df: DataFrame, cols: list[str] | None = None, row_hash: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """rows and digest: one row that doesn't depend on the rows' order. The digest sums row hashes, so repeated rows count."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row_hash(*(cols or df.columns)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("digest"))


def column_checksums(df: DataFrame, cols: list[str], cell_hash: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """column, digest: order-insensitive, all columns in one pass."""
    sums = F.array(*(F.struct(F.lit(c).alias("column"), F.sum(cell_hash(c).cast("decimal(38,0)")).alias("digest")) for c in cols))
    return df.agg(sums.alias("s")).select(F.inline("s"))


def agree(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows, digest, agrees: whether each table has the rows of the first."""
    sums = union(*(checksum(df).withColumn("name", F.lit(n)) for n, df in tables.items()))
    first = F.first_value(F.struct("rows", "digest")).over(Window.orderBy(F.col("name") != next(iter(tables))))  # one row a table
    return sums.withColumn("agrees", F.struct("rows", "digest") == first)


def drift(source: DataFrame, target: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """keys and drift: missing (in source only), extra (in target only) or stale (other values)."""
    kind = F.when(F.col("change") == "delete", "missing").when(F.col("change") == "insert", "extra").otherwise("stale")
    return table_diff(source, target, keys, cols).where("change <> 'same'").select(*keys, kind.alias("drift"))


def compare_versions(before: DataFrame, after: DataFrame, keys: list[str], **measures: Column) -> DataFrame:
    """keys and, for each measure, its value before and after and the difference; a group that one version lacks counts 0."""
    sides = [df.groupBy(*keys).agg(*(c.alias(f"{n}_{side}") for n, c in measures.items())) for df, side in ((before, "before"), (after, "after"))]
    out = sides[0].join(sides[1], keys, "full_outer").fillna(0)
    return out.withColumns({f"{n}_delta": F.col(f"{n}_after") - F.col(f"{n}_before") for n in measures})


def apply_diff(main: DataFrame, base: DataFrame, branch: DataFrame, keys: list[str]) -> DataFrame:
    """main after the edits that made branch of base; a key that main changed too takes the branch's row."""
    cols = [c for c in main.columns if c not in keys]
    edits = table_diff(base, branch, keys, cols).where("change <> 'same'").select(*keys, "new", (F.col("change") == "delete").alias("_gone"))
    edits = edits.select(*keys, *(F.col("new").getField(c).alias(c) for c in cols), "_gone")
    return upsert(main, edits, keys, delete_flag="_gone")


def sync_derived(before: DataFrame, after: DataFrame, derived: DataFrame, keys: list[str], cols: list[str], derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """derived after a change of its source: only inserted and updated rows are derived again, deleted ones go. derive: rows of after to rows of derived."""
    changed = table_diff(before, after, keys, cols).where("change <> 'same'").select(*keys, "change")
    touched = after.join(changed.where("change <> 'delete'").select(*keys), keys, "left_semi")
    return derived.join(changed.select(*keys), keys, "left_anti").unionByName(derive(touched))


def replay_version(log: DataFrame, seq: str, upto: int, rule: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A version rebuilt by rule from the log's start up to an offset."""
    return rule(log.where(F.col(seq) <= upto))


def swap_when_caught_up(current: DataFrame, rebuilt: DataFrame, rebuilt_upto: int, log_end: int) -> DataFrame:
    """The rebuilt version once it has read the whole log, the current one until then."""
    return rebuilt if rebuilt_upto >= log_end else current
