"""Cut a plan's lineage by writing it to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes the shuffle files of a query when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset and Spark is one local process, a temporary folder, set for later calls."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="ashlar-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one: all that it writes on the way lies there."""
    return f"{shared_dir(spark)}/ashlar-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name of this application."""
    return f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all that this application wrote on the way. Call it when the results are stored: nothing made before may be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back. Lost executors cost no recomputation beyond this point."""
    spark = df.sparkSession
    path = scratch(spark, label)
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")  # nothing reads this write's shuffles once it is done
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a table made by cut(); nothing may read it afterwards."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/ashlar-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def spread(df: DataFrame, *keys: str, part_bytes: int = 16 << 20) -> DataFrame:
    """df dealt by keys to partitions whose number grows with the bytes of the sources it reads, so that what a task sorts or hashes doesn't.

    Rows of one key meet in one task; an aggregate by the keys follows without a
    shuffle, nor any sort before this one. Sources of unknown size count nothing: cut them before.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    parts = -(-sum(n for n in sizes if n < 1 << 50) // part_bytes)
    return df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism), *keys)
