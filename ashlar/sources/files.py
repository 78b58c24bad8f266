"""Scans and sinks over files: declared schemas, provenance, logs, partitions and compaction."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ashlar.functions import every
from ashlar.lineage import cut

#: What a landing ledger holds: one row a file.
LEDGER = "_source_file string, _rows long"


def read_csv(spark: SparkSession, path: str, schema: StructType | str, **options: str) -> DataFrame:
    """A CSV with a header row, typed by schema; nothing is inferred. Rows that don't fit fail the read unless options say otherwise."""
    return spark.read.schema(schema).options(**{"header": "true", "mode": "FAILFAST"} | options).csv(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str, **options: str) -> DataFrame:
    """JSON lines, typed by schema."""
    return spark.read.schema(schema).options(**options).json(path)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None, fmt: str = "parquet", schema: StructType | str | None = None, **options: str) -> DataFrame:
    """columns of the rows where the predicate holds, both pushed into the scan where the format can."""
    reader = spark.read.format(fmt).options(**options)
    rows = (reader.schema(schema) if schema else reader).load(path)
    rows = rows.where(every(where))
    return rows.select(*columns) if columns else rows


def write_table(df: DataFrame, path: str | None = None, fmt: str = "parquet", mode: str = "overwrite", **options: str) -> None:
    """Write in any format that the session knows; a store without paths (JDBC and the like) takes its place from options."""
    writer = df.write.format(fmt).mode(mode).options(**options)
    writer.save(path) if path else writer.save()


def write_partitioned(df: DataFrame, path: str, by: list[str], fmt: str = "parquet") -> None:
    """Write by partition columns; of an existing table only the partitions that df has are replaced.

    Rows of one partition meet in few tasks, so that files are few; a partition
    beyond the advisory size is split by the engine.
    """
    df.hint("rebalance", *by).write.partitionBy(*by).format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic").save(path)


def read_images(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """path, length and content of the files that match; content is read only where it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def new_files(spark: SparkSession, folder: str, ledger: DataFrame, pattern: str = "*") -> list[str]:
    """Paths of the files in folder and below that the ledger lacks, by a listing: no file is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    found = found.select("path", F.col("_metadata.file_path").alias("_source_file"))
    return sorted(r.path for r in found.join(ledger.select("_source_file").distinct(), "_source_file", "left_anti").collect())  # a ledger may name a file for each of its rows


def ingest_landing(spark: SparkSession, folder: str, columns: list[str], ledger: DataFrame, pattern: str = "*") -> DataFrame:
    """Rows, all strings, of the landed CSV files that the ledger lacks, with _source_file, _line (from 1, within the file) and _ingested_at.

    Only new files are opened, each once: their rows are written to the shared
    folder, numbered within their block of the file, and the lines of the blocks
    before are added, so no task holds a file. No new files give no rows. Append
    the rows' files to the ledger with landed_files() once they are stored.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    paths = [re.sub(r"([\\\[\]{}*?])", r"\\\1", p) for p in new_files(spark, folder, ledger, pattern)]
    if not paths:
        return spark.createDataFrame([], f"{schema}, _source_file string, _line long, _ingested_at timestamp")
    raw = spark.read.schema(schema).option("header", "true").csv(paths)
    source = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    raw = cut(raw.select(F.struct(*columns).alias("row"), source.alias("source")), "landing")
    blocks = raw.groupBy("source.file", "source.block").agg(F.min("source.place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block")
    blocks = blocks.select("file", "block", (F.sum("n").over(before) - F.col("n") - F.col("first") + 1).alias("shift"))
    blocks = cut(blocks, "blocks")  # a row for each block of a file: few enough to be broadcast, once their size is known
    out = raw.join(blocks, (F.col("source.file") == F.col("file")) & (F.col("source.block") == F.col("block")))
    return out.select("row.*", F.col("file").alias("_source_file"), (F.col("source.place") + F.col("shift")).alias("_line"), F.current_timestamp().alias("_ingested_at"))


def landed_files(rows: DataFrame) -> DataFrame:
    """Ledger entries of ingested rows."""
    return rows.groupBy("_source_file").agg(F.count("*").alias("_rows"))


def source_audit(df: DataFrame, *aggs: Column) -> DataFrame:
    """Rows and totals of each source file of a scan."""
    return df.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"), *aggs)


def read_log(log: DataFrame, part: str, offset: str, start: dict | None = None, end: dict | None = None) -> DataFrame:
    """The rows of a log from start (inclusive) up to end (exclusive) offsets per part; a part that isn't named is read from its first or to its last row."""
    bound = lambda offsets, default: F.coalesce(F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv))[F.col(part)], F.lit(default)) if offsets else F.lit(default)
    return log.where((F.col(offset) >= bound(start, -(2**62))) & (F.col(offset) < bound(end, 2**62)))


def replay(log: DataFrame, seq: str, ts: str, from_seq: int | None = None, from_ts: Column | None = None, last_per: list[str] | None = None) -> DataFrame:
    """A log from a sequence number, from a time, or only the last row of each key; all of it by default."""
    rows = log.where(every(F.col(seq) >= from_seq if from_seq is not None else None, F.col(ts) >= from_ts if from_ts is not None else None))
    if last_per is None:
        return rows
    rest = [c for c in log.columns if c not in last_per]
    last = rows.groupBy(*last_per).agg(F.max_by(F.struct(*rest), seq).alias("_r"))
    return last.select(*last_per, "_r.*").select(log.columns)


def compact_files(spark: SparkSession, path: str, to: str, target_bytes: int = 256 << 20) -> DataFrame:
    """path's rows written to a new folder in files of about target_bytes; swap the folders once the rows agree. Returns the new table."""
    rows = spark.read.parquet(path)
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).agg(F.sum("length")).first()[0] or 0
    rows.repartition(max(1, -(-sizes // target_bytes))).write.mode("errorifexists").parquet(to)
    return spark.read.schema(rows.schema).parquet(to)


def pending_batches(markers: DataFrame, batch: str = "batch", name: str = "name", ready: str = "READY", done: str = "_SUCCESS") -> DataFrame:
    """Batches whose ready marker is there and whose done marker isn't yet. markers: batch and name of each marker file."""
    return markers.where(F.col(name) == ready).select(batch).distinct().join(markers.where(F.col(name) == done).select(batch), batch, "left_anti")


def marker_files(spark: SparkSession, folder: str, names: tuple[str, ...] = ("READY", "_SUCCESS")) -> DataFrame:
    """batch (folder name) and name of the marker files folder/<batch>/<name>, by a listing of the cluster's file system."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/{{{','.join(names)}}}")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return spark.createDataFrame([(f.getPath().getParent().getName(), f.getPath().getName()) for f in found], "batch string, name string")


def write_marker(spark: SparkSession, folder: str, name: str) -> None:
    """An empty marker file, made through the cluster's file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path).close()
