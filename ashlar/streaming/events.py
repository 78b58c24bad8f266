"""Structured Streaming: file sources, windows, dedup, keyed state, joins, and idempotent sinks.

Every stream runs until it has caught up. Its sink and checkpoint lie in the
folder that the cluster shares, so that a restart goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ashlar.lineage import cut, scratch, spread


def read_events(spark: SparkSession, pattern: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files that match the pattern, as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def fresh_folder(spark: SparkSession, label: str) -> str:
    return scratch(spark, f"stream-{label}")


def write_stream(stream: DataFrame, folder: str) -> DataFrame:
    """Append to Parquet in folder until caught up; exactly once over restarts. Returns the table."""
    stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def each_batch(stream: DataFrame, folder: str, apply: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """apply(rows, batch id) for each micro-batch until caught up. A batch may come again after a failure, under the same id."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(apply).trigger(availableNow=True).start().awaitTermination()


def upsert_sink(stream: DataFrame, keys: list[str], folder: str, mode: str = "update", order: str | None = None) -> DataFrame:
    """The last row of each key, by batch or by the column order. A batch is written under its id, so one that comes twice changes nothing."""
    each_batch(stream, folder, lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/rows/batch_id={batch}"), mode)
    log = stream.sparkSession.read.parquet(f"{folder}/rows")
    last = F.max_by(F.struct(*stream.columns), F.struct(order, "batch_id") if order else F.col("batch_id")).alias("row")
    return spread(log, *keys).groupBy(*keys).agg(last).select("row.*")


def tumble(df: DataFrame, ts: str, size: str, keys: list[str], *aggs: Column, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Aggregates per window and keys: tumbling, or sliding by slide. With delay, rows later than that are dropped."""
    rows = df.withWatermark(ts, delay) if delay else df
    out = rows.groupBy(F.window(ts, size, slide).alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in out.columns if c != "w"])


def dedup_stream(stream: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """The first copy of each key; copies that come up to within later are ignored."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def join_streams(a: DataFrame, b: DataFrame, on: str, a_ts: str, b_ts: str, bound: str) -> DataFrame:
    """Rows of a with rows of b on the same key from up to bound before; state older than that is dropped."""
    right = b.withColumnRenamed(on, "__on").withWatermark(b_ts, bound)
    near = F.col(b_ts).between(F.col(a_ts) - F.expr(f"interval {bound}"), F.col(a_ts))
    return a.withWatermark(a_ts, bound).join(right, (F.col(on) == F.col("__on")) & near).drop("__on")


def count_per_key(stream: DataFrame, key: str) -> DataFrame:
    """key, n: a long key's rows so far, kept as state over restarts; a row for each batch that touches the key."""

    def count(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(x) for x in frames)
        state.update((n,))
        yield pd.DataFrame({key: [k[0]], "n": [n]})

    return stream.select(key).groupBy(key).applyInPandasWithState(count, f"{key} long, n long", "n long", "update", GroupStateTimeout.NoTimeout)


def running_events(stream: DataFrame, key: str, order: str, value: Column, folder: str) -> DataFrame:
    """Every row with the running total of its key, in arrival of batches and by order within one."""
    spark = stream.sparkSession
    totals = f"{folder}/totals"

    def apply(rows: DataFrame, batch: int) -> None:
        rows = rows.withColumn("__v", value)
        before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        now = rows.groupBy(key).agg(F.sum("__v").alias("t"))
        if batch:  # the totals up to the batch before this one, whether or not this one ran already
            base = spark.read.parquet(f"{totals}/batch_id={batch - 1}")
            rows = rows.join(base.select(F.col(key).alias("__k"), F.col("t").alias("base")), F.col(key) == F.col("__k"), "left").drop("__k")
            now = base.unionByName(now).groupBy(key).agg(F.sum("t").cast(base.schema["t"].dataType).alias("t"))
        else:
            rows = rows.withColumn("base", F.lit(0))
        out = rows.withColumn("running", F.sum("__v").over(before) + F.coalesce("base", F.lit(0))).drop("__v", "base")
        out.write.mode("overwrite").parquet(f"{folder}/rows/batch_id={batch}")
        now.write.mode("overwrite").parquet(f"{totals}/batch_id={batch}")

    each_batch(stream, folder, apply)
    return spark.read.parquet(f"{folder}/rows").drop("batch_id")


def enrich_events(df: DataFrame, raw: str, schema: str, tiers: Column) -> DataFrame:
    """Rows whose JSON parses, with its fields and a tier; the same on streams and tables."""
    parsed = df.withColumn("__j", F.from_json(raw, f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"}))
    return parsed.where("__j is not null and __j.__bad is null").select(*df.columns, "__j.*").drop("__bad").withColumn("tier", tiers)


def apply_once(stream: DataFrame, id_col: str, keys: list[str], folder: str) -> DataFrame:
    """keys, n: counts of events, each id once however often it is delivered.

    A batch writes the ids that it is the first to bring, under its id and in
    one write with their keys, so that ledger and view can't fall apart; a batch
    that comes twice replaces its own write.
    """
    spark = stream.sparkSession
    seen = f"{folder}/seen"

    def apply(rows: DataFrame, batch: int) -> None:
        new = rows.select(id_col, *keys).dropDuplicates([id_col])
        if batch:
            new = new.join(spark.read.parquet(seen).where(F.col("batch_id") < batch).select(id_col), id_col, "left_anti")
        new.write.mode("overwrite").parquet(f"{seen}/batch_id={batch}")

    each_batch(stream, folder, apply)
    return spark.read.parquet(seen).groupBy(*keys).agg(F.count("*").alias("n"))


def maintained_views(stream: DataFrame, folder: str, key: str, seq: str, views: dict[str, Callable[[dict[str, DataFrame]], DataFrame]]) -> None:
    """Views kept in step with the latest row of each key, all made in one batch, in order, each from the base and those before it.

    Base and views of a batch are written under its id, the mark that the batch
    is whole comes last: readers take the last marked batch, see read_view().
    """
    spark = stream.sparkSession

    def apply(rows: DataFrame, batch: int) -> None:
        rows = cut(rows, "batch")
        if batch:
            rows = rows.unionByName(spark.read.parquet(f"{folder}/base/batch_id={batch - 1}"))
        base = spread(rows, key).groupBy(key).agg(F.max_by(F.struct(*rows.columns), seq).alias("r")).select("r.*")
        base.write.mode("overwrite").parquet(f"{folder}/base/batch_id={batch}")
        made = {"base": spark.read.parquet(f"{folder}/base/batch_id={batch}")}
        for name, view in views.items():
            view(made).write.mode("overwrite").parquet(f"{folder}/{name}/batch_id={batch}")
            made[name] = spark.read.parquet(f"{folder}/{name}/batch_id={batch}")
        spark.range(1).select(F.lit(batch).alias("batch")).write.mode("overwrite").parquet(f"{folder}/whole/batch_id={batch}")

    each_batch(stream, folder, apply)


def last_batch(spark: SparkSession, folder: str, upto: int | None = None) -> int:
    """The last batch that is whole, or the last one up to a given batch."""
    whole = spark.read.parquet(f"{folder}/whole")
    return (whole if upto is None else whole.where(F.col("batch") <= upto)).agg(F.max("batch")).first()[0]


def read_view(spark: SparkSession, folder: str, name: str, batch: int | None = None) -> DataFrame:
    """A view as of a batch, so that several are read at the same one; the last whole batch by default."""
    return spark.read.parquet(f"{folder}/{name}/batch_id={last_batch(spark, folder) if batch is None else batch}")
