"""Two tokenizers' tokens of the same texts, aligned by the byte offsets where tokens of both end.

The ends of a text's tokens are two ascending lists. The shorter list drives:
each of its ends gallops into the longer one from the text's first token, by
steps that double until they pass it, and is then found by bisection between the
last two steps. The common ends cut both lists into groups; differences of their
ranks are the groups' ranges of tokens in either list, and every token of one
range overlaps a group of the other.

Texts are encoded once, in chunks of bounded size, and stay with their chunk: a
chunk keeps its distinct linked id pairs once, texts hold places in that list.
Only the chunks' pairs are shuffled to count the texts that hold a pair, and the
counts go back to their chunks, so a pair that all texts hold has a row a chunk,
not a row a text.

Defined cases: null and empty texts, and texts whose joined token bytes differ
from the text's, have no tokens: zeros and no digest; repeated rows count as
texts of their own; special tokens' strings are plain text; an empty table gives
an empty table; other columns, whatever their names, aren't read. A group in
which both sides have many tokens is reduced to distinct ids with their numbers
before pairs are made, so a run of one character gives few pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ashlar.lineage import cut
from ashlar.llm.bpe import chunks
from ashlar.llm.subwords import loaded

#: Groups with more links than this are reduced to distinct ids first; characters of a chunk; words that a worker keeps of either tokenizer.
WIDE, CHUNK, KEPT = 64, 1_500_000, 300_000


def gallop(ends: np.ndarray, longer: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The first place in longer, from start on, whose value isn't below each of ends, which ascend; len(longer) if there is none.

    Every 4,096th end gallops first; the ones between gallop from where the last one before them was found, in ever finer steps.
    """
    found = np.zeros(len(ends), np.int64)
    before = 0
    for stride in (4096, 256, 16, 1):
        at = np.arange(0, len(ends), stride)
        if before:
            at = at[at % before != 0]
            found[at] = search(ends[at], longer, np.maximum(start[at], found[at - at % before]))
        else:
            found[at] = search(ends[at], longer, start[at])
        before = stride
    return found


def search(ends: np.ndarray, longer: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Doubling steps from start until an end is passed, then bisection between the last two."""
    n = len(longer)
    low, step = start.copy(), np.ones_like(start)
    below = (low < n) & (longer[np.minimum(low, n - 1)] < ends)
    high = np.where(below, np.minimum(low + 1, n), low)
    open_ = np.flatnonzero(below & (high < n))
    while len(open_):  # low is below the end, high isn't known yet
        open_ = open_[longer[high[open_]] < ends[open_]]
        low[open_] = high[open_]
        step[open_] *= 2
        high[open_] = np.minimum(low[open_] + step[open_], n)
        open_ = open_[high[open_] < n]
    open_ = np.flatnonzero(high - low > 1)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        less = longer[middle] < ends[open_]
        low[open_[less]] = middle[less]
        high[open_[~less]] = middle[~less]
        open_ = open_[high[open_] - low[open_] > 1]
    return high


def common_ends(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the ends that both have. a, b: ascending ends of texts one after another, n_a and n_b of each text, all above zero."""
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    found = []
    for short, longer, n, first, other, swap in ((a, b, n_a, first_a, first_b, False), (b, a, n_b, first_b, first_a, True)):
        drives = (n_a <= n_b) if not swap else (n_a > n_b)
        if not drives.any():
            continue
        places = np.flatnonzero(np.repeat(drives, n))
        to = gallop(short[places], longer, np.repeat(other[drives], n[drives]))
        hit = longer[np.minimum(to, len(longer) - 1)] == short[places]
        pair = (places[hit], to[hit])
        found.append(pair[::-1] if swap else pair)
    at_a, at_b = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(at_a)
    return at_a[order], at_b[order]


@cache
def digit_table(most: int) -> tuple[np.ndarray, np.ndarray]:
    """(the digits of 0 to most, on the right of rows of one width; how many each has)."""
    ids, width = np.arange(most + 1), len(str(most))
    rows = np.stack([48 + ids // 10**k % 10 for k in range(width - 1, -1, -1)], axis=1).astype(np.uint8)
    return rows, 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, width))


def decimal_lists(ids: np.ndarray, separators: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each id's text with its separator ends) of decimal ids of up to most, each followed by its separator."""
    rows, digits = digit_table(most)
    width, n = rows.shape[1], digits[ids]
    out = np.empty((len(ids), width + 1), np.uint8)
    out[:, :width], out[:, width] = rows[ids], separators
    return out[np.arange(width + 1) >= (width - n)[:, None]], np.cumsum(n + 1)


def linked_pairs(ids_a: np.ndarray, ids_b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair as a << 32 | b, links) of the groups' tokens; rows of one text and pair may come several times."""
    small = n_a * n_b <= WIDE
    texts, pairs, times = [], [], []
    links = (n_a * n_b)[small]
    group = np.repeat(np.flatnonzero(small), links)
    i = np.arange(len(group)) - np.repeat(np.cumsum(links) - links, links)
    a, b = ids_a[from_a[group] + i // n_b[group]], ids_b[from_b[group] + i % n_b[group]]
    texts.append(text[group])
    pairs.append(a.astype(np.int64) << 32 | b.astype(np.int64))
    times.append(np.ones(len(group), np.int64))
    for g in np.flatnonzero(~small):
        x, x_times = np.unique(ids_a[from_a[g] : from_a[g] + n_a[g]], return_counts=True)
        y, y_times = np.unique(ids_b[from_b[g] : from_b[g] + n_b[g]], return_counts=True)
        pairs.append((x.astype(np.int64)[:, None] << 32 | y.astype(np.int64)).ravel())
        times.append((x_times[:, None] * y_times).ravel())
        texts.append(np.full(len(x) * len(y), text[g]))
    return np.concatenate(texts), np.concatenate(pairs), np.concatenate(times)


def align_chunk(ids_a: np.ndarray, ids_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray) -> dict[str, np.ndarray | list]:
    """Of texts that both tokenizers give back whole: n_groups, n_links, groups_sha256, and the rows (text, pair, links)."""
    at_a, at_b = common_ends(np.cumsum(length_a[ids_a]), np.cumsum(length_b[ids_b]), n_a, n_b)
    text = np.repeat(np.arange(len(n_a)), n_a)[at_a]
    from_a, from_b = np.concatenate([[0], at_a[:-1] + 1]), np.concatenate([[0], at_b[:-1] + 1])
    g_a, g_b = at_a + 1 - from_a, at_b + 1 - from_b  # differences of ranks
    groups = np.bincount(text, minlength=len(n_a))
    links = np.zeros(len(n_a), np.int64)
    np.add.at(links, text, g_a * g_b)
    # the groups' texts: the tokens of a, then those of b
    place_a = np.arange(len(ids_a)) + np.repeat(from_b, g_a)
    place_b = np.arange(len(ids_b)) + np.repeat(at_a + 1, g_b)
    ids, separators = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
    ids[place_a], ids[place_b] = ids_a, ids_b
    separators[place_a[at_a]], separators[place_b[at_b]] = ord("|"), ord(";")
    written, ends = decimal_lists(ids, separators, max(len(length_a), len(length_b)) - 1)
    stops = ends[np.cumsum(n_a + n_b) - 1].tolist()
    data = written.tobytes()
    digests = [hashlib.sha256(data[x : y - 1]).hexdigest() for x, y in zip([0, *stops[:-1]], stops, strict=True)]
    return {"n_groups": groups, "n_links": links, "groups_sha256": digests, "rows": linked_pairs(ids_a, ids_b, from_a, from_b, g_a, g_b, text)}


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id") -> DataFrame:
    """id, the counts and digest of each row, its linked pairs as places in its chunk's list (at) with their links (times), the chunk, and, in a chunk's first row, the list (pairs) and the rows that hold each (held)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = loaded("byte_level", a_path, KEPT), loaded("pieces", b_path, KEPT)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            lengths = pc.utf8_length(batch.column(1)).fill_null(0).to_pylist()
            for part in chunks([range(n) for n in lengths], CHUNK):  # by length; only a chunk's texts become Python strings
                some = [" " + (x or "") for x in batch.column(1).slice(part.start, part.stop - part.start).to_pylist()]
                (ids_a, n_a, like_a), (ids_b, n_b, like_b) = a.encode(some), b.encode(some)
                whole = like_a & like_b & np.array([len(x) > 1 for x in some])
                good, n = np.flatnonzero(whole), len(some)
                counts = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
                digests = [""] * n
                at, times, n_pairs = np.empty(0, np.int32), np.empty(0, np.int64), np.zeros(n, np.int64)
                pairs = held = np.empty(0, np.int64)
                if len(good):
                    out = align_chunk(ids_a[np.repeat(whole, n_a)].astype(np.int64), ids_b[np.repeat(whole, n_b)].astype(np.int64), n_a[good], n_b[good], a.length, b.length)
                    for k, v in (("n_a", n_a[good]), ("n_b", n_b[good]), ("n_groups", out["n_groups"]), ("n_links", out["n_links"])):
                        counts[k][good] = v
                    for i, x in zip(good.tolist(), out["groups_sha256"], strict=True):
                        digests[i] = x
                    text, pair, links = out["rows"]
                    pairs, code = np.unique(pair, return_inverse=True)
                    key, first = np.unique(text * len(pairs) + code, return_inverse=True)
                    times = np.bincount(first, weights=links).astype(np.int64)
                    at = (key % len(pairs)).astype(np.int32)
                    n_pairs[good] = np.bincount(key // len(pairs), minlength=len(good))
                    held = np.bincount(at, minlength=len(pairs))
                lead = np.zeros(n, np.int64)
                lead[0] = len(pairs)
                yield pa.record_batch([batch.column(0).slice(part.start, n), *map(pa.array, counts.values()), pa.array(digests), _lists(at, n_pairs), _lists(times, n_pairs), pa.array(np.full(n, chunk)), _lists(pairs, lead), _lists(held.astype(np.int64), lead)], names=["id", *counts, "groups_sha256", "at", "times", "chunk", "pairs", "held"])
                chunk += 1

    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at array<int>, times array<long>, chunk long, pairs array<long>, held array<long>"
    return docs.select(F.col(id_col).alias("id"), "text").mapInArrow(run, schema)


def pair_counts(made: DataFrame) -> DataFrame:
    """pair, n: how many rows hold each linked pair, and best: whether no other pair of its a id is held by more."""
    counts = made.where(F.size("pairs") > 0).select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("n"))
    of_a = Window.partitionBy(F.shiftright("pair", 32))  # an id has as many rows as ids of the other vocabulary at most
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_a))


def token_align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row. a_path: a byte-level BPE file; b_path: a sentencepiece model."""
    made = cut(aligned(docs, a_path, b_path, id_col), "aligned")
    known = pair_counts(made)
    lists = made.where(F.size("pairs") > 0).select(F.col("chunk").alias("of"), F.posexplode("pairs").alias("place", "pair"))
    back = lists.join(known, "pair").select("of", "place", "n", "best")
    kind = docs.schema[id_col].dataType
    texts = made.select(F.col("id").cast("string").alias("id"), "chunk", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times")

    def add(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        """A chunk's rows with sums over their links; a chunk's list is as long as its texts at most."""
        n, best = np.zeros(len(y), np.int64), np.zeros(len(y), np.int64)
        n[y["place"].to_numpy()], best[y["place"].to_numpy()] = y["n"].to_numpy(), y["best"].to_numpy()
        total = [int((n[i] * t).sum()) for i, t in zip(x["at"], x["times"], strict=True)]
        top = [int((best[i] * t).sum()) for i, t in zip(x["at"], x["times"], strict=True)]
        return x.drop(columns=["chunk", "at", "times"]).assign(n_best=top, count_sum=total)

    out = texts.groupBy("chunk").cogroup(back.groupBy("of")).applyInPandas(add, "id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return out.select(F.col("id").cast(kind).alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
