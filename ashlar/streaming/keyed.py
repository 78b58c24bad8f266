"""Keyed state of the newer kind: value state in RocksDB, event-time timers, time to live.

State lies with the query's checkpoint in the shared folder, so a query that was
stopped, or whose executors were lost, goes on with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.streaming.listener import StreamingQueryListener

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession, empty_batches: bool = True) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, whose size isn't bounded by memory.

    empty_batches: whether batches without rows follow, which event-time timers
    need; with state that goes by processing time they would never end.
    """
    want = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": str(empty_batches).lower()}
    before = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


class Sessions(StatefulProcessor):
    """A row for each session of a key once it is closed: by a timer when the watermark is idle after its last row, or by a row that comes that much later.

    A key has one value, with its kinds as a map, and one timer: rows that
    prolong a session leave the timer, which is set anew when it fires too early.
    """

    def __init__(self, key: str, idle: int) -> None:
        self.key, self.idle = key, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "start long, last long, n long, kinds map<string, long>")

    def row(self, key: tuple, start: int, last: int, n: int, kinds: dict[str, int]) -> Row:
        top = min(kinds, key=lambda k: (-kinds[k], k))
        return Row(**{self.key: key[0], "start": start, "last": last, "n": n, "kinds": len(kinds), "top_kind": top})

    def ends(self, last: int) -> int:
        """When a session is over, in whole milliseconds, as timers count."""
        return (last + self.idle + 999) // 1000

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = self.session.get()
        start, last, n, kinds = (*held[:3], dict(held[3])) if held else (None, None, 0, {})
        for at, kind in sorted((r["at_"], r["kind_"]) for r in rows):
            if n and at - last >= self.idle:
                yield self.row(key, start, last, n, kinds)
                n, kinds = 0, {}
            start, last, n = (start, max(at, last), n + 1) if n else (at, at, 1)
            kinds[kind] = kinds.get(kind, 0) + 1
        self.session.update((start, last, n, kinds))
        if held is None:
            self.handle.registerTimer(self.ends(last))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        held = self.session.get()
        if self.ends(held[1]) > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(self.ends(held[1]))
            return
        yield self.row(key, *held)
        self.session.clear()

    def close(self) -> None:
        pass


def sessions(stream: DataFrame, key: str, ts: str, kind: str, idle_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """key, start, last, n, kinds (distinct), top_kind (most frequent, ties to the first name) of each closed session; start it inside rocksdb().

    A session ends where the next row of its key is idle_seconds or more later,
    and is given out, and its state dropped, when the watermark has passed that
    point. Rows later than delay are dropped. A null kind counts as empty.
    """
    dtype = stream.schema[key].dataType.simpleString()
    rows = stream.withWatermark(ts, delay).select(F.col(key), F.col(ts), F.unix_micros(ts).alias("at_"), F.coalesce(F.col(kind), F.lit("")).alias("kind_"))
    out = rows.groupBy(key).transformWithState(Sessions(key, idle_seconds * 1_000_000), f"`{key}` {dtype}, start long, last long, n long, kinds long, top_kind string", "Append", "EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("start", "last")})


class Counter(StatefulProcessor):
    """A key's rows so far; its state goes when no row came for the time to live."""

    def __init__(self, key: str, ttl_seconds: int | None) -> None:
        self.key, self.ttl = key, ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.n = handle.getValueState("n", "n long", self.ttl * 1000 if self.ttl else None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        n = (self.n.get()[0] if self.n.exists() else 0) + sum(len(x) for x in rows)
        self.n.update((n,))
        yield pd.DataFrame({self.key: [key[0]], "n": [n]})

    def close(self) -> None:
        pass


def count_with_ttl(stream: DataFrame, key: str, ttl_seconds: int | None = None) -> DataFrame:
    """key, n: a key's rows so far, a row for each batch that touches it; start it inside rocksdb(spark, False). A key that is idle, in processing time, for the time to live begins anew."""
    dtype = stream.schema[key].dataType.simpleString()
    return stream.select(key).groupBy(key).transformWithStateInPandas(Counter(key, ttl_seconds), f"`{key}` {dtype}, n long", "Update", "ProcessingTime")


class DroppedRows(StreamingQueryListener):
    """Rows that stateful operators dropped as later than the watermark, by query and by the operator's place."""

    def __init__(self) -> None:
        self.dropped: dict[str, list[int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = [s.numRowsDroppedByWatermark for s in event.progress.stateOperators]
        before = self.dropped.setdefault(str(event.progress.runId), [0] * len(found))
        self.dropped[str(event.progress.runId)] = [a + b for a, b in zip(before or [0] * len(found), found, strict=False)]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def windows_and_late(stream: DataFrame, folder: str, id_col: str, ts: str, size: str, keys: list[str], delay: str, *aggs: Column) -> tuple[DataFrame, int]:
    """(closed windows of the stream with each id once, rows dropped as late).

    Ids are told apart before windows are made: that operator sees the raw rows,
    so its count of dropped rows, taken from the query's progress, is one of rows
    and not of partial groups. Runs until caught up.
    """
    spark = stream.sparkSession
    once = stream.withWatermark(ts, delay).dropDuplicates([id_col, ts])
    out = once.groupBy(F.window(ts, size).alias("w"), *keys).agg(*aggs)
    out = out.select(F.col("w.start").alias("start"), *[c for c in out.columns if c != "w"])
    counter = DroppedRows()
    spark.streams.addListener(counter)
    try:
        query = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows").trigger(availableNow=True).start()
        run = str(query.runId)
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(counter)
    return spark.read.schema(out.schema).parquet(f"{folder}/rows"), max(counter.dropped.get(run) or [0])
