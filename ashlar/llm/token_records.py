"""Token ids in files of length-delimited binary records, with an offset index.

A record is the length of its payload (8 bytes, little-endian), the masked
CRC-32C of these bytes (4), the payload, and the masked CRC-32C of the payload
(4): the framing of TFRecord files. A payload is one document's ids, its end id
included, as little-endian unsigned integers of 2 bytes, or of 4 where the
vocabulary needs them. The index, a Parquet table beside the files, has for each
record its file, place in the file, offset, payload length and ids before it in
the file, so that records can be read in any order.

Documents are dealt to files by ranges of their id, a hot id by ranges of its
texts' hashes, so ids ascend over the files in order. A task writes one file
under a name of its own attempt; only the index, which Spark commits as a whole,
says which files count, so lost executors and repeated attempts leave the table
right. Files are written and read through pyarrow's file systems, so the folder
must be one that these reach (file, hdfs, s3, gs). Texts are held a batch of
bounded size at a time.

Defined cases: null and empty texts have the end id alone; null ids come first;
rows of one id are in order of their texts' hashes, then of the texts; repeated
rows have a record each; an empty table gives no records; other columns, whatever
their names, aren't read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ashlar.lineage import CLEAN_UP, scratch
from ashlar.llm.bpe import chunks
from ashlar.llm.subwords import loaded

#: CRC-32C: the reversed polynomial, and what masks a checksum.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
#: Words that a worker keeps encoded; characters encoded at once; bytes of a block that checksums are made of.
KEPT, CHUNK, BLOCK = 900_000, 4_000_000, 256


def _byte_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(POLYNOMIAL), out >> 1)
    return out


#: The checksum register after one byte, and after two.
TABLE = _byte_table()
_two = np.arange(65536, dtype=np.uint32)
for _ in range(2):
    _two = TABLE[_two & 0xFF] ^ (_two >> 8)
TABLE2 = _two


def _zeros_operator(n_bytes: int) -> np.ndarray:
    """What n zero bytes do to a register: the image of each of its four bytes' values, as tables."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    step, out = (bits >> 8) ^ TABLE[bits & 0xFF], bits.copy()
    while n_bytes:
        if n_bytes & 1:
            out = _apply_bits(step, out)
        step = _apply_bits(step, step)
        n_bytes >>= 1
    values = np.arange(256, dtype=np.uint32)
    return np.stack([_apply_bits(out, values << np.uint32(8 * i)) for i in range(4)])


def _apply_bits(images: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros_like(values)
    for i in range(32):
        out ^= np.where((values >> np.uint32(i)) & 1, images[i], np.uint32(0))
    return out


BLOCK_ZEROS = _zeros_operator(BLOCK)


def _bytes_by_step(state: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Registers of many equally long byte rows, two columns at a time."""
    pairs = rows.shape[1] // 2
    words = np.ascontiguousarray(rows[:, : 2 * pairs]).view("<u2").T.astype(np.uint32)
    for column in words:
        state = TABLE2[(state ^ column) & 0xFFFF] ^ (state >> 16)
    if rows.shape[1] % 2:
        state = TABLE[(state ^ rows[:, -1]) & 0xFF] ^ (state >> 8)
    return state


def crc32c(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of the slices of data (bytes). Slices are cut to blocks, whose registers are made side by side and then chained."""
    blocks = lengths // BLOCK
    total = int(blocks.sum())
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    if total:
        first = np.cumsum(blocks) - blocks
        begin = np.repeat(starts, blocks) + (np.arange(total) - np.repeat(first, blocks)) * BLOCK
        own = np.empty(total, np.uint32)
        for at in range(0, total, 8192):  # a bounded part of the gathered bytes at a time
            some = begin[at : at + 8192]
            own[at : at + 8192] = _bytes_by_step(np.zeros(len(some), np.uint32), data[some[:, None] + np.arange(BLOCK)])
        left = np.flatnonzero(blocks)
        for i in range(int(blocks.max())):
            left = left[blocks[left] > i]
            s = state[left]
            state[left] = own[first[left] + i] ^ BLOCK_ZEROS[0][s & 0xFF] ^ BLOCK_ZEROS[1][(s >> 8) & 0xFF] ^ BLOCK_ZEROS[2][(s >> 16) & 0xFF] ^ BLOCK_ZEROS[3][s >> 24]
    rest = lengths % BLOCK
    at = starts + blocks * BLOCK
    order = np.argsort(-rest, kind="stable")
    ends = np.searchsorted(-rest[order], -np.arange(1, BLOCK), side="right")  # how many slices have a further byte
    for i, n in enumerate(ends):
        if not n:
            break
        some = order[:n]
        s = state[some]
        state[some] = TABLE[(s ^ data[at[some] + i]) & 0xFF] ^ (s >> 8)
    return state ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return (((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)).astype(np.uint32)


def frame(payloads: list[bytes]) -> list[bytes]:
    """The records of payloads."""
    lengths = np.array([len(x) for x in payloads], np.int64)
    starts = np.cumsum(lengths) - lengths
    body = masked(crc32c(np.frombuffer(b"".join(payloads), np.uint8), starts, lengths)).astype("<u4").tobytes()
    head = lengths.astype("<u8").tobytes()
    crcs = masked(crc32c(np.frombuffer(head, np.uint8), np.arange(len(payloads)) * 8, np.full(len(payloads), 8))).astype("<u4").tobytes()
    return [b"".join((head[8 * i : 8 * i + 8], crcs[4 * i : 4 * i + 4], x, body[4 * i : 4 * i + 4])) for i, x in enumerate(payloads)]


def unframe(data: bytes, offsets: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """The payloads of the records at offsets in data; an error where a length or checksum is wrong."""
    raw = np.frombuffer(data, np.uint8)
    if len(offsets) and (offsets.min() < 0 or (offsets + lengths).max() + 16 > len(raw)):
        raise ValueError("a record ends beyond its file")
    word = lambda at, n, kind: raw[at[:, None] + np.arange(n)].reshape(-1).view(kind)
    right = word(offsets, 8, "<u8") == lengths.astype(np.uint64)
    right &= word(offsets + 8, 4, "<u4") == masked(crc32c(raw, offsets, np.full(len(offsets), 8)))
    right &= word(offsets + 12 + lengths, 4, "<u4") == masked(crc32c(raw, offsets + 12, lengths))
    if not right.all():
        raise ValueError(f"the record at offset {int(offsets[~right][0])} is damaged")
    return [data[x + 12 : x + 12 + n] for x, n in zip(offsets.tolist(), lengths.tolist(), strict=True)]


def open_file(url: str, mode: str) -> BinaryIO:
    """A file of the shared folder, as a task opens it."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(url)
    return system.open_output_stream(path) if mode == "wb" else system.open_input_file(path)


def write_records(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", end: int = 0) -> DataFrame:
    """The index of docs written to folder: doc id, file, place, offset, length, before (ids before it in its file), n_tokens, width (bytes an id). tokenizer: the file of a byte-level BPE."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "hash").sortWithinPartitions("id", "hash", "text").select("id", "text")
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name, out = f"part-{part:06d}-{uuid.uuid4().hex}.rec", None
        coder = loaded("byte_level", tokenizer, KEPT)
        width = 2 if max(len(coder.token_bytes) - 1, end) < 1 << 16 else 4
        place = offset = before = 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for some in chunks(texts, CHUNK):
                coded, counts, _ = coder.encode(texts[some])
                ids = coded.astype(f"<u{width}").tobytes()
                cuts = np.concatenate([[0], np.cumsum(counts) * width]).tolist()
                last = end.to_bytes(width, "little")
                framed = frame([ids[x:y] + last for x, y in zip(cuts, cuts[1:], strict=False)])
                if out is None:
                    out = open_file(f"{folder}/{name}", "wb")
                out.write(b"".join(framed))
                sizes, counts = np.array([len(x) for x in framed], np.int64), counts + 1
                n = len(framed)
                yield pa.record_batch([batch.column(0).slice(some.start, n), pa.array([name] * n), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n)), pa.array(offset + np.cumsum(sizes) - sizes), pa.array(sizes - 16), pa.array(before + np.cumsum(counts) - counts), pa.array(counts), pa.array(np.full(n, width, np.int32))], names=["id", "file", "file_no", "place", "offset", "length", "before", "n_tokens", "width"])
                place, offset, before = place + n, offset + int(sizes.sum()), before + int(counts.sum())
        if out is not None:
            out.close()

    index = rows.mapInArrow(write, f"id {kind.simpleString()}, file string, file_no int, place long, offset long, length long, before long, n_tokens long, width int")
    was = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        index.write.parquet(f"{folder}/index")
    finally:
        spark.conf.set(CLEAN_UP, was)
    return spark.read.schema(index.schema).parquet(f"{folder}/index").withColumnRenamed("id", id_col)


def read_index(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """The index of a folder that was written before."""
    return spark.read.parquet(f"{folder}/index").withColumnRenamed("id", id_col)


#: Bytes of a file that are read at once.
SPAN = 8 << 20


def read_records(index: DataFrame, folder: str, id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The records that the index names, read from their files and checked: id, the columns in keep, ids (array) with the end id, ids_crc32 (of the ids as 4-byte little-endian integers).

    Records are read in the order of the index's rows, whatever it is: records
    that follow each other in a file in spans, others one by one.
    """
    keep = keep or []
    kinds = {f.name: f.dataType.simpleString() for f in index.schema.fields}
    rows = index.select(F.col(id_col).alias("id"), "file", "offset", "length", "width", *(F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            files, offsets = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            lengths, width = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            begin = 0
            while begin < len(files):
                stop = begin + 1
                while stop < len(files) and files[stop] == files[begin] and offsets[stop] == offsets[stop - 1] + lengths[stop - 1] + 16 and offsets[stop] - offsets[begin] < SPAN:
                    stop += 1
                if files[begin] != name:
                    if source is not None:
                        source.close()
                    name, source = files[begin], open_file(f"{folder}/{files[begin]}", "rb")
                source.seek(int(offsets[begin]))
                data = source.read(int(offsets[stop - 1] + lengths[stop - 1] + 16 - offsets[begin]))
                payloads = unframe(data, offsets[begin:stop] - offsets[begin], lengths[begin:stop])
                ids = [np.frombuffer(x, f"<u{w}").astype("<u4") for x, w in zip(payloads, width[begin:stop].tolist(), strict=True)]
                flat = np.concatenate(ids).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                some = slice(begin, stop)
                yield pa.record_batch([batch.column(0).slice(begin, stop - begin), *(batch.column(5 + i).slice(begin, stop - begin) for i in range(len(keep))), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())], names=["id", *(f"k_{i}" for i in range(len(keep))), "ids", "ids_crc32"])
                begin = some.stop
        if source is not None:
            source.close()

    more = "".join(f", k_{i} {kinds[c]}" for i, c in enumerate(keep))
    out = rows.mapInArrow(read, f"id {kinds[id_col]}{more}, ids array<int>, ids_crc32 long")
    return out.withColumnRenamed("id", id_col).withColumnsRenamed({f"k_{i}": c for i, c in enumerate(keep)})


def token_records(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", end: int = 0) -> DataFrame:
    """id_col, start (ids of all documents before it), n_tokens, ids_crc32 of docs written to files and read back from them."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "records")
    make_folder(spark, folder)
    index = write_records(docs, tokenizer, folder, id_col, end)
    files = index.groupBy("file", "file_no").agg(F.sum("n_tokens").alias("n"))  # a row a file
    before = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    found = read_records(index, folder, id_col, ["file", "before"])
    lengths = found.select(id_col, "file", "before", F.size("ids").cast("long").alias("n_tokens"), "ids_crc32")
    return lengths.join(before, "file").select(id_col, (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def make_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
