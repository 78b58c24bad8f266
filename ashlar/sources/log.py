"""A partitioned log as a data source of the library's own: spark.read, readStream, write and writeStream of format ashlar_log.

A log is a folder: segments of rows in Arrow files, and commits, small JSON files
that say which segments, of which part and from which offset on, belong to the
log. Offsets are given at commit time, one after another within a part. A commit
is one new file, made at once; segments that no commit names don't count, so a
write that failed, or was done twice under one batch number, leaves no trace.

Options: path; parts (of a write; rows go to part crc32(key) % parts); starting
and ending, JSON of part -> offset (inclusive, exclusive), for a bounded read;
rows, the most of a read partition. The folder must be one that pyarrow's file
systems reach (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

SCHEMA = "part int, offset long, key string, value string, ts timestamp"
#: Rows of a segment at most.
SEGMENT = 50_000


class Folder:
    """The files of one log."""

    def __init__(self, url: str) -> None:
        from pyarrow import fs

        self.system, self.path = fs.FileSystem.from_uri(url)
        self.fs = fs

    def commits(self) -> list[dict]:
        """In order of their numbers."""
        found = self.system.get_file_info(self.fs.FileSelector(f"{self.path}/commits", allow_not_found=True))
        return [json.loads(self.system.open_input_stream(f.path).read()) for f in sorted(found, key=lambda f: f.base_name) if f.base_name.endswith(".json")]

    def segments(self) -> list[dict]:
        """part, first, n and file of each segment, offsets going on from commit to commit."""
        at: dict[int, int] = {}
        out = []
        for commit in self.commits():
            for s in commit["segments"]:
                first = at.get(s["part"], 0)
                out.append({"part": s["part"], "first": first, "n": s["n"], "file": s["file"]})
                at[s["part"]] = first + s["n"]
        return out

    def ends(self) -> dict[int, int]:
        out: dict[int, int] = {}
        for s in self.segments():
            out[s["part"]] = s["first"] + s["n"]
        return out

    def write_segment(self, rows: pa.Table) -> str:
        name = f"{uuid.uuid4().hex}.arrow"
        self.system.create_dir(f"{self.path}/segments")
        with self.system.open_output_stream(f"{self.path}/segments/{name}") as sink, pa.ipc.new_file(sink, rows.schema) as writer:
            writer.write_table(rows)
        return name

    def read_segment(self, name: str) -> pa.Table:
        with self.system.open_input_file(f"{self.path}/segments/{name}") as source:
            return pa.ipc.open_file(source).read_all()

    def commit(self, segments: list[dict], batch: str | None) -> None:
        """One file with the next number; nothing if the batch is in the log already."""
        self.system.create_dir(f"{self.path}/commits")
        before = self.commits()
        if batch is not None and any(c["batch"] == batch for c in before):
            return
        made = f"{self.path}/commits/{uuid.uuid4().hex}.tmp"
        with self.system.open_output_stream(made) as out:
            out.write(json.dumps({"batch": batch, "segments": segments}).encode())
        self.system.move(made, f"{self.path}/commits/{len(before):012d}.json")


@dataclass
class Range(InputPartition):
    """Rows of one segment: from the from_-th up to before the to-th, which have offsets from first on."""

    file: str
    part: int
    first: int
    from_: int
    to: int


def ranges(segments: list[dict], start: dict[int, int], end: dict[int, int], rows: int) -> list[Range]:
    """The parts of segments within the offsets; segments that lie outside aren't named, so they are never opened."""
    out = []
    for s in segments:
        low = max(start.get(s["part"], 0) - s["first"], 0)
        high = min(end.get(s["part"], 2**62) - s["first"], s["n"])
        out.extend(Range(s["file"], s["part"], s["first"], at, min(at + rows, high)) for at in range(low, high, rows))
    return out


def read_range(url: str, r: Range | None) -> Iterator[pa.RecordBatch]:
    if r is None:  # a read without partitions
        return
    rows = Folder(url).read_segment(r.file).slice(r.from_, r.to - r.from_)
    n = rows.num_rows
    yield from pa.table({"part": pa.array([r.part] * n, pa.int32()), "offset": pa.array(range(r.first + r.from_, r.first + r.to), pa.int64()), **{c: rows[c] for c in ("key", "value", "ts")}}).to_batches()


def offsets(text: str | None) -> dict[int, int]:
    return {int(k): int(v) for k, v in json.loads(text).items()} if text else {}


class LogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.url, self.rows = options["path"], int(options.get("rows", SEGMENT))
        self.start, self.end = offsets(options.get("starting")), offsets(options.get("ending"))

    def partitions(self) -> list[Range]:
        return ranges(Folder(self.url).segments(), self.start, self.end, self.rows)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(self.url, partition)


class LogStream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.url, self.rows, self.start = options["path"], int(options.get("rows", SEGMENT)), offsets(options.get("starting"))

    def initialOffset(self) -> dict:
        return {str(k): v for k, v in self.start.items()}

    def latestOffset(self) -> dict:
        return {str(k): v for k, v in Folder(self.url).ends().items()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        bounds = [{int(k): v for k, v in x.items()} for x in (start, end)]
        return ranges([s for s in Folder(self.url).segments() if s["part"] in bounds[1]], *bounds, self.rows)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(self.url, partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    segments: list[dict]


def write_rows(url: str, parts: int, batches: Iterator[pa.RecordBatch]) -> Written:
    """Segments of a task's rows, in their order within a part."""
    folder, out = Folder(url), []

    def flush(rows: list[pa.Table]) -> None:
        table = pa.concat_tables(rows)
        of = [zlib.crc32((k or "").encode()) % parts for k in table["key"].to_pylist()]
        for p in sorted(set(of)):
            some = table.filter(pa.array([x == p for x in of]))
            out.append({"part": p, "n": some.num_rows, "file": folder.write_segment(some)})

    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held.append(pa.table({"key": table["key"].cast(pa.string()), "value": table["value"].cast(pa.string()), "ts": table["ts"].cast(pa.timestamp("us", "UTC"))}))
        if sum(x.num_rows for x in held) >= SEGMENT:
            flush(held)
            held = []
    if sum(x.num_rows for x in held):
        flush(held)
    return Written(out)


class LogWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.url, self.parts = options["path"], int(options.get("parts", 4))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return write_rows(self.url, self.parts, iterator)

    def commit(self, messages: list[Written | None]) -> None:
        Folder(self.url).commit([s for m in messages if m for s in m.segments], None)

    def abort(self, messages: list[Written | None]) -> None:
        pass  # no commit names what was written


class LogStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict) -> None:
        self.url, self.parts, self.name = options["path"], int(options.get("parts", 4)), options.get("writer", "stream")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return write_rows(self.url, self.parts, iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        Folder(self.url).commit([s for m in messages if m for s in m.segments], f"{self.name}-{batchId}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        pass


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ashlar_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStream:
        return LogStream(self.options)

    def writer(self, schema, overwrite: bool) -> LogWriter:
        if overwrite:
            raise ValueError("a log is only appended to")
        return LogWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> LogStreamWriter:
        return LogStreamWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format ashlar_log known to the session."""
    spark.dataSource.register(LogSource)
