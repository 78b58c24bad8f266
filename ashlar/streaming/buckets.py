"""Tables kept in hash buckets, of which a batch rewrites only those it touches, and views kept by the changes of their source.

A table of a batch lies in <table>/batch_id=<n>/bucket=<b>. A mark, written last,
says for every table and bucket which batch wrote it; readers take the last whole
mark, so all tables are read as of one batch. A batch that fails leaves no mark,
and one that comes again starts from the mark before it, so it has no effect
twice. The mark has one row for each table and bucket that has rows: its size is
bounded by the number of buckets, a parameter that is kept for a folder's life.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType, StructType

from ashlar.lineage import cut, spread
from ashlar.streaming.events import each_batch

MARK = "name string, bucket int, batch long, schema string"


class Store:
    """The tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64) -> None:
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def batches(self) -> list[int]:
        """The batches that are whole, in order."""
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/marks/batch_id=*/_SUCCESS")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)

    def mark(self, batch: int | None = None) -> tuple[dict[tuple[str, int], int], dict[str, str]]:
        """Which batch wrote each table's bucket, and each table's schema, as of a batch; of the last one by default."""
        whole = [b for b in self.batches() if batch is None or b <= batch]
        rows = self.spark.read.schema(MARK).json(f"{self.folder}/marks/batch_id={whole[-1]}").collect() if whole else []
        return {(r.name, r.bucket): r.batch for r in rows if r.bucket is not None}, {r.name: r.schema for r in rows if r.schema is not None}

    def read(self, name: str, batch: int | None = None) -> DataFrame:
        """A table as of a batch."""
        written, schemas = self.mark(batch)
        if name not in schemas:
            raise ValueError(f"no table {name} as of that batch")
        return self.load(name, written, StructType.fromJson(json.loads(schemas[name])), range(self.buckets))

    def load(self, name: str, written: dict[tuple[str, int], int], schema: StructType, buckets: list[int] | range) -> DataFrame:
        """Some buckets of a table, of the batches that wrote them."""
        paths = [f"{self.folder}/{name}/batch_id={written[name, b]}/bucket={b}" for b in buckets if (name, b) in written]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def prune(self, keep: int = 1) -> int:
        """Delete what none of the last keep batches refers to; returns the number of folders deleted. Nothing may be reading them."""
        kept = self.batches()[-keep:]
        used = {(name, batch, bucket) for k in kept for (name, bucket), batch in self.mark(k)[0].items()}
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        system = path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        n = 0
        for f in system.globStatus(path(f"{self.folder}/*/batch_id=*/bucket=*")) or []:
            bucket, batch, name = (p.getName() for p in (f.getPath(), f.getPath().getParent(), f.getPath().getParent().getParent()))
            batch = int(batch.split("=")[1])
            if kept and batch <= kept[-1] and (name, batch, int(bucket.split("=")[1])) not in used:
                n += system.delete(f.getPath(), True)
        for b in self.batches()[:-keep]:
            system.delete(path(f"{self.folder}/marks/batch_id={b}"), True)
        return n


class Batch:
    """One batch's changes to a store; they count once commit() has written the mark."""

    def __init__(self, store: Store, batch: int) -> None:
        self.store, self.batch = store, batch
        self.written, self.schemas = store.mark(batch - 1)

    def bucket(self, keys: list[str]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.store.buckets)).cast("int")

    def change(self, name: str, keys: list[str], rows: DataFrame, merged: tuple[Column, Column], by: list[str] | None = None) -> DataFrame:
        """Merge rows into a table of the same columns; returns _old and _new, structs or null, of the keys whose row changed.

        merged: two aggregates over the rows of one key, those of the table
        (__new is 0) and the given ones (1): its row before and its row now, null
        if it has none. by: the keys that buckets go by, all by default. Columns
        can be compared, so they aren't maps. rows should be cut: they are read
        twice.
        """
        store, by = self.store, by or keys
        touched = self.touched(by, rows)
        table = store.load(name, self.written, rows.schema, touched)
        both = table.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)))
        made = cut(spread(both, *keys).groupBy(*keys).agg(merged[0].alias("_old"), merged[1].alias("_new")).select("_old", "_new"), "buckets")
        now = made.where("_new is not null").select("_new.*").withColumn("bucket", self.bucket(by))
        self.write(name, now, touched)
        return made.where(~F.col("_old").eqNullSafe(F.col("_new")))

    def touched(self, by: list[str], rows: DataFrame) -> list[int]:
        """The buckets of rows: at most as many as there are."""
        return sorted(r[0] for r in rows.select(self.bucket(by)).distinct().collect())

    def write(self, name: str, now: DataFrame, touched: list[int]) -> None:
        """All that a table holds now in the touched buckets, by the column bucket."""
        folder = f"{self.store.folder}/{name}/batch_id={self.batch}"
        now.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").parquet(folder)
        full = [r[0] for r in now.select("bucket").distinct().collect()]
        self.written = {k: b for k, b in self.written.items() if k[0] != name or k[1] not in touched} | {(name, b): self.batch for b in full}
        self.schemas[name] = now.drop("bucket").schema.json()

    def load(self, name: str, buckets: list[int]) -> DataFrame:
        """Some buckets of a table as this batch has left it."""
        return self.store.load(name, self.written, StructType.fromJson(json.loads(self.schemas[name])), buckets)

    def commit(self) -> None:
        rows = [(name, bucket, batch, None) for (name, bucket), batch in self.written.items()]
        rows += [(name, None, None, schema) for name, schema in self.schemas.items()]
        self.store.spark.createDataFrame(rows, MARK).coalesce(1).write.mode("overwrite").json(f"{self.store.folder}/marks/batch_id={self.batch}")


def newest(columns: list[str], seq: str | None) -> tuple[Column, Column]:
    """For change(): the row of the highest seq stays, of equal ones the one that came last; without seq the first that came."""
    row, tie = F.struct(*columns), F.xxhash64(*columns)
    rank = F.struct(F.col(seq), F.col("__new"), tie) if seq else F.struct(-F.col("__new"), tie)
    return F.max_by(row, F.when(F.col("__new") == 0, rank)), F.max_by(row, rank)


@dataclass(frozen=True)
class View:
    """Sums and the number n of the rows of a source, by keys. Sums are of whole numbers or decimals, so that what is taken back leaves nothing behind; nulls add nothing."""

    source: str
    keys: dict[str, Column]
    sums: dict[str, Column] = field(default_factory=dict)
    where: Column | None = None

    def parts(self, changes: DataFrame) -> DataFrame:
        """What changed rows add to the view's rows, and take from them."""
        signed = F.array(F.struct(F.lit(-1).alias("s"), F.col("_old").alias("r")), F.struct(F.lit(1).alias("s"), F.col("_new").alias("r")))
        rows = changes.select(F.explode(signed).alias("c")).where("c.r is not null").select(F.col("c.s").alias("__s"), "c.r.*")
        rows = rows if self.where is None else rows.where(self.where)
        rows = rows.select("__s", *(c.alias(k) for k, c in self.keys.items()), *(c.alias(v) for v, c in self.sums.items()))
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        if any(isinstance(kinds[v], (DoubleType, FloatType)) for v in self.sums):
            raise ValueError("sums of doubles are not exact: use whole numbers or decimals")
        add = [F.sum(F.col("__s") * F.coalesce(v, F.lit(0))).cast(f"decimal(38,{kinds[v].scale})" if isinstance(kinds[v], DecimalType) else "long").alias(v) for v in self.sums]
        return rows.groupBy(*self.keys).agg(*add, F.sum("__s").cast("long").alias("n"))

    def merged(self, schema: StructType) -> tuple[Column, Column]:
        """For change(): the row before and now; a row of no rows is none."""
        add = [*self.sums, "n"]
        before = F.struct(*self.keys, *(F.sum(F.when(F.col("__new") == 0, F.col(c))).cast(schema[c].dataType).alias(c) for c in add))
        now = F.struct(*self.keys, *(F.sum(c).cast(schema[c].dataType).alias(c) for c in add))
        return F.when(F.sum(F.when(F.col("__new") == 0, F.col("n"))) > 0, before), F.when(F.sum("n") > 0, now)


def maintain(stream: DataFrame, folder: str, key: list[str], seq: str | None, views: dict[str, View], buckets: int = 64) -> Store:
    """The newest row of each key (table "base") and views of it, or of each other in order, kept in step by their changes alone.

    A batch reads and writes the buckets that its rows touch, in the base and in
    each view; late and corrected rows move between a view's rows, and rows that
    came before change nothing. Without seq the first row of a key stays. All
    that a batch wrote counts from its mark on. Returns the store to read from.
    """
    store = Store(stream.sparkSession, folder, buckets)

    def apply(rows: DataFrame, batch: int) -> None:
        run = Batch(store, batch)
        changes = {"base": run.change("base", key, cut(rows, "batch"), newest(rows.columns, seq))}
        for name, view in views.items():
            parts = cut(view.parts(changes[view.source]), "parts")
            changes[name] = run.change(name, list(view.keys), parts, view.merged(parts.schema))
        run.commit()

    each_batch(stream, folder, apply)
    return store


def join_changes(left: DataFrame, right: DataFrame, on: str, id_col: str, seq: str, folder: str, buckets: int = 64) -> Store:
    """left x right, two streams of upserts, kept in step as table "view": id_col, the other columns of left, those of right.

    left has a row for each version of an id, right for each version of a value
    of on; the greatest seq counts, versions may come in any order. A left or
    right row whose other columns are all null is a delete. An id must keep its
    value of on; a null one joins nothing. Both sides' latest rows and the view
    lie in buckets of on, and a batch joins anew those that its rows touch.
    Returns the store to read from.
    """
    store = Store(left.sparkSession, folder, buckets)
    keys, parts = {"left": [on, id_col], "right": [on]}, []
    for name, df in (("left", left), ("right", right)):
        rest = [c for c in df.columns if c not in (*keys[name], seq)]
        row = F.when(reduce(or_, (F.col(c).isNotNull() for c in rest)), F.struct(*rest))
        parts.append(df.where(F.col(on).isNotNull()).select(F.lit(name).alias("side_"), *keys[name], F.col(seq).alias("seq_"), row.alias(name)))
    both = parts[0].unionByName(parts[1], allowMissingColumns=True)

    def apply(rows: DataFrame, batch: int) -> None:
        run, rows = Batch(store, batch), cut(rows, "batch")
        for name in ("left", "right"):
            columns = [*keys[name], "seq_", name]
            run.change(name, keys[name], rows.where(F.col("side_") == name).select(columns), newest(columns, "seq_"), [on])
        touched = run.touched([on], rows)
        now = [run.load(name, touched).where(F.col(name).isNotNull()).drop("seq_") for name in ("left", "right")]
        view = now[0].join(now[1], on)
        run.write("view", cut(view.select(id_col, "left.*", "right.*", run.bucket([on]).alias("bucket")), "view"), touched)
        run.commit()

    each_batch(both, folder, apply)
    return store


def running_totals(stream: DataFrame, key: str, order: str, value: Column, folder: str, buckets: int = 64) -> DataFrame:
    """Every row with the running total of its key, in arrival of batches and by order within one. value: whole numbers or decimals; null adds nothing.

    A batch reads and rewrites the totals of the buckets it touches. Its rows are
    written under its id before its mark; both are made anew if it comes again.
    """
    store = Store(stream.sparkSession, folder, buckets)

    def apply(rows: DataFrame, batch: int) -> None:
        run = Batch(store, batch)
        rows = cut(rows.withColumn("__v", value), "batch")
        now = View("rows", {"__k": F.col(key)}, {"t": F.col("__v")})
        parts = cut(now.parts(rows.select(F.lit(None).cast(rows.schema).alias("_old"), F.struct(*rows.columns).alias("_new"))), "parts")
        before = run.change("totals", ["__k"], parts, now.merged(parts.schema)).where("_old is not null").select("_old.__k", F.col("_old.t").alias("__base"))
        till = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        out = rows.join(before, F.col(key).eqNullSafe(F.col("__k")), "left").withColumn("running", F.coalesce(F.sum("__v").over(till), F.lit(0)) + F.coalesce("__base", F.lit(0)))
        out.drop("__v", "__k", "__base").write.mode("overwrite").parquet(f"{folder}/rows/batch_id={batch}")
        run.commit()

    each_batch(stream, folder, apply)
    return stream.sparkSession.read.parquet(f"{folder}/rows").drop("batch_id")
