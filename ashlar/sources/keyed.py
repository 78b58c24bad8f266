"""A table by keys in the shared folder: rows of a partition key lie together, in the order of clustering columns; written by upserts, read by key.

It is Parquet in hash buckets with a mark a batch (see streaming.buckets). The
partition key picks spread neighbouring buckets and the whole key one of them, so
a write touches the buckets of its keys, a lookup opens those of the keys it asks
for, and a key with very many rows is still spread over tasks. Folder, buckets and
spread stay as they are for a table's life; there is one writer at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ashlar.lineage import cut
from ashlar.streaming.buckets import Batch, Store, newest
from ashlar.streaming.events import each_batch


class KeyedTable:
    """partition and cluster: the key's columns; seq: what tells which write of a key is the newest (an equal one that comes later wins); deleted: a boolean column whose true deletes the key.

    A deleted key keeps its row as a mark, so that an older write which comes late
    doesn't bring it back. Nulls in keys are values like others.
    """

    def __init__(self, spark: SparkSession, folder: str, partition: list[str], cluster: list[str], seq: str, deleted: str | None = None, buckets: int = 64, spread: int = 4) -> None:
        self.partition, self.cluster, self.seq, self.deleted = partition, cluster, seq, deleted
        self.buckets, self.spread, self.folder = buckets, spread, folder
        self.store = Store(spark, folder, buckets * spread)

    def group(self) -> Column:
        return F.pmod(F.xxhash64(*self.partition), F.lit(self.buckets)).cast("int")

    def upsert(self, rows: DataFrame, batch: int | None = None) -> None:
        """Write rows as one batch, by default the next one; a batch that comes again under its number has no further effect."""
        run = _Batch(self, (self.store.batches() or [-1])[-1] + 1 if batch is None else batch)
        run.change("rows", [*self.partition, *self.cluster], cut(rows, "batch"), newest(rows.columns, self.seq))
        run.commit()

    def write_stream(self, stream: DataFrame) -> None:
        """Upsert a stream's batches until it is caught up."""
        each_batch(stream, self.folder, self.upsert)

    def _open(self, groups: list[int] | None, batch: int | None) -> DataFrame:
        written, schemas = self.store.mark(batch)
        if "rows" not in schemas:
            raise ValueError("nothing was written to the table as of that batch")
        wanted = range(self.store.buckets) if groups is None else [g * self.spread + i for g in groups for i in range(self.spread)]
        rows = self.store.load("rows", written, StructType.fromJson(json.loads(schemas["rows"])), wanted)
        return rows.where(~F.coalesce(F.col(self.deleted), F.lit(False))).drop(self.deleted) if self.deleted else rows

    def read(self, batch: int | None = None) -> DataFrame:
        """All rows, as of a batch."""
        return self._open(None, batch)

    def lookup(self, keys: DataFrame, batch: int | None = None) -> DataFrame:
        """The rows whose partition key is among those of keys; no bucket but theirs is opened."""
        kinds = StructType.fromJson(json.loads(self.store.mark(batch)[1]["rows"]))
        asked = cut(keys.select(*(F.col(c).cast(kinds[c].dataType).alias(c) for c in self.partition)).distinct(), "asked")
        groups = sorted(r[0] for r in asked.select(self.group()).distinct().collect())  # at most as many as there are buckets
        rows = self._open(groups, batch)
        same = [rows[c].eqNullSafe(asked[c]) for c in self.partition]
        return rows.join(asked, same, "left_semi")

    def slice(self, key: tuple, where: Column | None = None, batch: int | None = None) -> DataFrame:
        """One partition's rows in the order of the clustering columns; key and condition reach the scan."""
        kinds = StructType.fromJson(json.loads(self.store.mark(batch)[1]["rows"]))
        values = {c: F.lit(v).cast(kinds[c].dataType) for c, v in zip(self.partition, key, strict=True)}
        group = self.store.spark.range(1).select(*(v.alias(c) for c, v in values.items())).select(self.group()).first()[0]
        rows = self._open([group], batch)
        for c, v in values.items():
            rows = rows.where(F.col(c).eqNullSafe(v))
        return (rows if where is None else rows.where(where)).orderBy(*self.cluster)


class _Batch(Batch):
    def __init__(self, table: KeyedTable, batch: int) -> None:
        super().__init__(table.store, batch)
        self.table = table

    def bucket(self, keys: list[str]) -> Column:
        return (self.table.group() * self.table.spread + F.pmod(F.xxhash64(F.lit(7), *keys), F.lit(self.table.spread))).cast("int")
