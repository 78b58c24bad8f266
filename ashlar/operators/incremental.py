"""Incremental loads: deltas, slices, backfills, and tables read with the changes that follow them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ashlar.lineage import cut
from ashlar.operators.merge import latest, upsert
from ashlar.operators.quality import validate
from ashlar.sources.files import ingest_landing


def delta_aggregate(state: DataFrame, delta: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """keys, old, new: a total before and after the delta, for touched keys only. state: keys and total."""
    touched = delta.groupBy(*keys).agg(F.sum(value).alias("_d"))
    old = F.coalesce("total", F.lit(0))
    return touched.join(state, keys, "left").select(*keys, old.alias("old"), (old + F.col("_d")).alias("new"))


def incremental(target: DataFrame, source: DataFrame, ts: str, keys: list[str]) -> DataFrame:
    """target with the source rows newer than its newest one upserted; all of them where it is empty."""
    high = target.agg(F.max(ts).alias("_high"))  # one row
    return upsert(target, source.join(high).where(F.col("_high").isNull() | (F.col(ts) > F.col("_high"))).drop("_high"), keys)


def backfill(target: DataFrame, events: DataFrame, day: str, wanted: Column, *aggs: Column) -> DataFrame:
    """target with the wanted days recomputed from events in one job; a rerun leaves the same rows."""
    redone = events.where(wanted).groupBy(day).agg(*aggs)
    return target.where(~wanted).unionByName(redone)


def version_metrics(history: DataFrame, valid_from: str, valid_to: str, value: Column) -> DataFrame:
    """version, rows, total of what is valid at each version at which anything opens or closes.

    Rows become openings and closings, summed by version before the running
    totals, so that no range join is needed and the last window sees one row a
    version.
    """
    ends = F.array(F.struct(F.col(valid_from).alias("version"), F.lit(1).alias("s")), F.struct(F.col(valid_to).alias("version"), F.lit(-1).alias("s")))
    steps = history.select(value.alias("v"), F.explode(ends).alias("e")).where("e.version is not null")
    steps = steps.groupBy("e.version").agg(F.sum("e.s").alias("n"), F.sum(F.col("e.s") * F.col("v")).alias("v"))
    so_far = Window.orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("version", F.sum("n").over(so_far).alias("rows"), F.sum("v").over(so_far).alias("total"))


def lambda_serving(master: DataFrame, log: DataFrame, seq: str, upto: int, keys: list[str]) -> DataFrame:
    """keys, n: the batch view up to an offset plus the log after it, each event counted once."""
    batch = master.where(F.col(seq) <= upto).groupBy(*keys).agg(F.count("*").alias("n"))
    speed = log.where(F.col(seq) > upto).dropDuplicates([seq]).groupBy(*keys).agg(F.count("*").alias("n"))
    return batch.unionByName(speed).groupBy(*keys).agg(F.sum("n").alias("n"))


def union_read(snapshot: DataFrame, log: DataFrame, keys: list[str], seq: str, offset: int) -> DataFrame:
    """The newest row of each key in the snapshot and the log after its offset."""
    return latest(snapshot.unionByName(log.where(F.col(seq) > offset)), keys, seq)


def schema_drift(landed: DataFrame, batch: str, record: str) -> DataFrame:
    """batch, field, n, first_batch, for each field of the JSON records; first_batch is when a field was first seen."""
    seen = landed.select(F.col(batch).alias("batch"), F.explode(F.json_object_keys(record)).alias("field")).groupBy("batch", "field").agg(F.count("*").alias("n"))
    return seen.withColumn("first_batch", F.min("batch").over(Window.partitionBy("field")))


def route(df: DataFrame, routes: dict[str, Column], default: str) -> DataFrame:
    """df with a row for each route whose predicate holds; rows without one go to default. Write it partitioned by route."""
    hits = F.array_compact(F.array(*(F.when(p, F.lit(n)) for n, p in routes.items())))
    return df.withColumn("route", F.explode(F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(default)))))


def choose_rollup(base: DataFrame, rollups: list[tuple[DataFrame, set[str]]], needed: set[str]) -> tuple[DataFrame, bool]:
    """The first rollup whose keys cover what a query needs, else the base table; and whether a rollup was found."""
    for rollup, keys in rollups:
        if needed <= keys:
            return rollup, True
    return base, False


def check_shape(landed: DataFrame, record: str, fields: list[str]) -> DataFrame:
    """problem, field, n: records that lack a field or have one too many."""
    keys, want = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>")), F.array(*map(F.lit, fields))
    tag = lambda name, xs: F.transform(xs, lambda x: F.struct(F.lit(name).alias("problem"), x.alias("field")))
    found = landed.select(F.explode(F.concat(tag("missing", F.array_except(want, keys)), tag("extra", F.array_except(keys, want)))).alias("p"))
    return found.groupBy("p.problem", "p.field").agg(F.count("*").alias("n"))


def gate_report(df: DataFrame, id_col: str, gates: dict[str, Column], sample: int = 3) -> DataFrame:
    """gate, failures, and the smallest failing ids of gates that fail."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in gates.items())))
    rows = df.select(F.col(id_col).alias("id"), F.explode(failed).alias("gate"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("gate").orderBy("id"))).where(F.col("r") <= sample)
    samples = first.groupBy("gate").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("sample"))
    return rows.groupBy("gate").agg(F.count("*").alias("failures")).join(samples, "gate")


def promote_batches(df: DataFrame, batch: str, gates: dict[str, Column]) -> DataFrame:
    """Rows with _status: promoted where every row of the batch passes every gate, else the whole batch is quarantined."""
    bad = F.lit(False)
    for ok in gates.values():
        bad = bad | ~F.coalesce(ok, F.lit(False))
    failing = df.where(bad).select(F.col(batch).alias("_b")).distinct().withColumn("_bad", F.lit(True))
    out = df.join(failing, df[batch].eqNullSafe(failing["_b"]), "left")
    return out.withColumn("_status", F.when(F.col("_bad"), "quarantined").otherwise("promoted")).drop("_b", "_bad")


def run_shards(events: DataFrame, table: str, ledger: str, shard: str, wanted: Column, *aggs: Column) -> None:
    """Recompute the wanted shards of a table partitioned by shard, in one job, and note each in the ledger.

    A shard is replaced as a whole, so a rerun leaves the same rows; the
    ledger has a row for each attempt that ended.
    """
    redone = events.where(wanted).groupBy(shard).agg(*aggs)
    redone.write.partitionBy(shard).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(table)
    done = events.where(wanted).select(shard).distinct().withColumn("run", F.lit(uuid.uuid4().hex))
    done.write.mode("append").parquet(ledger)


def medallion(spark: SparkSession, landing: str, columns: list[str], types: dict[str, str], rules: list[tuple[str, Column]], key: str, by: list[str], *aggs: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(silver, quarantine, gold) of landed CSV files, file by file in order of name and line.

    Bronze has all rows as strings with their provenance. Rows that break a rule
    are quarantined with the first reason; of the others the newest row of each
    key is typed and merged into silver; gold aggregates silver by groups.
    """
    bronze = cut(ingest_landing(spark, landing, columns, spark.createDataFrame([], "_source_file string")), "bronze")
    good, bad = validate(bronze, rules)
    newest = latest(good, [key], "_source_file", "_line")
    typed = newest.select(*(F.col(c).cast(k).alias(c) for c, k in types.items()))
    silver = cut(upsert(typed.limit(0), typed, [key]), "silver")
    return silver, bad, silver.groupBy(*by).agg(*aggs)
