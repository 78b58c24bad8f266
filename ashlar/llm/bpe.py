"""Byte-level BPE by DuckDB recursive queries, one small database a partition.

A text is parted by the tokenizer's pattern; each distinct word becomes
token-position rows, which a recursive query joins with the merge table: every
round contracts each word's leftmost pair of least rank, until no pair is left.
Decoding joins the ids with the vocabulary and aggregates the bytes in order.
Texts stay in their tasks: nothing is shuffled. Words go to DuckDB in bounded
chunks, and what a worker has encoded is kept in a bounded table of words.

Long words are first cut where no token of the vocabulary could lie across: no
merge crosses such a place, so the pieces contract on their own. What is still
long (a run of digits, of one character) is contracted by a second query, whose
rounds contract all places of the least rank from the left, up to the first one
that makes a pair of lower rank; that is what one at a time comes to, in about
as many rounds as ranks occur. The rows that a query holds are bounded by
giving it fewer rounds the longer the word is.

Defined cases: null and empty texts have no ids and decode to no bytes; special
tokens' strings are ordinary text; repeated rows are encoded alike; an empty
table gives an empty table; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of texts in a chunk, words kept for later chunks, bytes of words in one query, rounds of one query, rows that a query may hold, tokens decoded by one query.
CHUNK, KEPT, QUERY_BYTES, ROUNDS, ROWS, DECODED = 2_000_000, 1_200_000, 120_000, 24, 4_000_000, 500_000
#: Longer words are cut before they are contracted; longer pieces have a query each.
CUT, LONG = 64, 256
#: Bytes of memory that DuckDB may take for each byte of a long piece.
PIECE_X = 500

#: A row of first: word, places of a pair's tokens, the tokens (the word's first row has none on the left), and a key of rank, left place and left length in one number, null for pairs that no merge has: a word's least key is its leftmost pair of least rank.
FIRST = """
CREATE OR REPLACE TEMP TABLE first AS
SELECT g.*, CASE WHEN m.rank IS NOT NULL THEN (m.rank::BIGINT << 32) | (g.p::BIGINT << 8) | m.len END AS key
FROM given g LEFT JOIN merges m ON m.pair = CASE WHEN g.p >= 0 THEN (g.a::BIGINT << 32) | g.b END
"""

#: Rounds from 0; -1: the word is done; -2: it goes on in another query. Only the pairs beside a contraction are looked up again.
CONTRACT = f"""
CREATE OR REPLACE TEMP TABLE done AS
WITH RECURSIVE r AS (
    SELECT w, p, q, a, b, key, 0 AS round FROM first
    UNION ALL
    (
        WITH s AS (SELECT * FROM r WHERE round >= 0),
        least AS (SELECT w, min(key) AS key FROM s GROUP BY w),
        best AS (SELECT w, ((key >> 8) & 16777215)::INTEGER AS p, ((key >> 8) & 16777215)::INTEGER + (key & 255)::INTEGER AS q, (key >> 32)::INTEGER AS t FROM least),
        n AS (
            SELECT s.w, CASE WHEN s.p = best.q THEN best.p ELSE s.p END AS p, s.q, CASE WHEN s.p = best.q THEN best.t ELSE s.a END AS a, CASE WHEN s.q = best.p THEN best.t ELSE s.b END AS b,
                s.key, s.p = best.q OR s.q = best.p AS fresh, CASE WHEN best.t IS NULL THEN -1 WHEN s.round = {ROUNDS} THEN -2 ELSE s.round + 1 END AS round
            FROM s JOIN best USING (w) WHERE s.q IS DISTINCT FROM best.q
        )
        SELECT n.w, n.p, n.q, n.a, n.b, CASE WHEN fresh IS NOT TRUE THEN n.key WHEN m.rank IS NOT NULL THEN (m.rank::BIGINT << 32) | (n.p::BIGINT << 8) | m.len END, round
        FROM n LEFT JOIN merges m ON m.pair = CASE WHEN fresh AND n.p >= 0 THEN (n.a::BIGINT << 32) | n.b END
    )
)
SELECT * FROM r WHERE round < 0
"""

#: One long piece: places of its tokens, the tokens. A round contracts every place of the least rank, overlaps from the left, up to the first that makes a pair of lower rank.
CONTRACT_LONG = """
CREATE OR REPLACE TEMP TABLE long AS
WITH RECURSIVE r AS (
    SELECT p, t, 0 AS round FROM given_long
    UNION ALL
    (
        WITH s AS MATERIALIZED (
            SELECT p, t, round, row_number() OVER by_p AS i, lag(t) OVER by_p AS before, lead(t) OVER by_p AS next, lead(t, 2) OVER by_p AS after
            FROM r WHERE round BETWEEN 0 AND {rounds} - 1 WINDOW by_p AS (ORDER BY p)
        ),
        k AS MATERIALIZED (SELECT s.*, m.rank FROM s LEFT JOIN merges m ON m.pair = CASE WHEN next IS NOT NULL THEN (t::BIGINT << 32) | next END),
        least AS (SELECT min(rank) AS best FROM k),
        places AS (SELECT k.*, best, i - row_number() OVER (ORDER BY i) AS run FROM k, least WHERE rank = best),
        odd AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY i) % 2 = 1 AS taken FROM places),
        taken AS (SELECT i, best, after, CASE WHEN lag(i) OVER (ORDER BY i) = i - 2 THEN best ELSE before END AS left_ FROM odd WHERE taken),
        stop AS (
            SELECT min(i) AS i FROM taken
            LEFT JOIN merges x ON x.pair = CASE WHEN left_ IS NOT NULL THEN (left_::BIGINT << 32) | best END
            LEFT JOIN merges y ON y.pair = CASE WHEN after IS NOT NULL THEN (best::BIGINT << 32) | after END
            WHERE x.rank < best OR y.rank < best
        ),
        now AS MATERIALIZED (SELECT taken.i, best FROM taken, stop WHERE stop.i IS NULL OR taken.i <= stop.i)
        SELECT k.p, coalesce(own.best, k.t), CASE WHEN least.best IS NULL THEN -1 ELSE k.round + 1 END
        FROM k CROSS JOIN least LEFT JOIN now own ON own.i = k.i LEFT JOIN now other ON other.i + 1 = k.i
        WHERE other.i IS NULL
    )
)
SELECT p, t, round FROM r WHERE round IN (-1, {rounds})
"""


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a .tiktoken file in order of rank, which runs from 0."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    out = [b""] * len(rows)
    for token, rank in rows:
        out[int(rank)] = base64.b64decode(token)
    return out


class Coder:
    """Encodes and decodes the words and ids of one partition."""

    def __init__(self, path: str, pattern: str, memory_mb: int = 256) -> None:
        import duckdb
        import pyarrow as pa
        import regex

        self.find = regex.compile(pattern).findall
        tokens = read_ranks(path)
        rank = {t: i for i, t in enumerate(tokens)}
        self.byte = [rank[bytes([i])] for i in range(256)]
        self.whole = {t: str(i) for t, i in rank.items()}
        pair, to, length = [], [], []
        for t, i in rank.items():
            for at in range(1, len(t)):
                a, b = rank.get(t[:at]), rank.get(t[at:])
                if a is not None and b is not None:
                    pair.append(a << 32 | b)
                    to.append(i)
                    length.append(at)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{memory_mb}MB", "preserve_insertion_order": False, "temp_directory": ""})
        self.db.register("given_merges", pa.table({"pair": pa.array(pair, pa.int64()), "rank": pa.array(to, pa.int32()), "len": pa.array(length, pa.int32())}))
        self.db.register("given_vocab", pa.table({"id": pa.array(range(len(tokens)), pa.int32()), "b": pa.array(tokens, pa.binary())}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given_merges; CREATE TABLE vocab AS SELECT id, hex(b) AS b FROM given_vocab")
        self.pa, self.memory_mb = pa, memory_mb
        self.byte_ids = np.array(self.byte, np.int32)
        self.lie_across = None
        self.known: dict[str, str] = {}
        self.long: dict[str, str] = {}

    def pieces(self, word: bytes) -> list[bytes]:
        """The word, cut wherever no token of the vocabulary lies across."""
        if self.lie_across is None:
            import ahocorasick

            self.lie_across = ahocorasick.Automaton()
            for t in self.whole:
                if len(t) > 1:
                    self.lie_across.add_word(t.decode("latin-1"), len(t))
            self.lie_across.make_automaton()
        reach = np.arange(1, len(word) + 1)
        for last, n in self.lie_across.iter(word.decode("latin-1")):  # shorter tokens of one end come later, longer ones earlier
            begin = last + 1 - n
            reach[begin] = max(reach[begin], last + 1)
        reach = np.maximum.accumulate(reach)
        ends = np.flatnonzero(reach == np.arange(1, len(word) + 1)) + 1
        return [word[x:y] for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def contract(self, words: list[bytes]) -> list[str]:
        """Decimal ids of each word, joined by commas; words of LONG bytes at most."""
        flat = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        lengths = np.array([len(x) for x in words])
        w = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        q = (np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        self.db.register("given", self.pa.table({"w": w, "p": q - 1, "q": q, "a": np.roll(flat, 1), "b": flat}))
        self.db.execute(FIRST)
        out = [""] * len(words)
        while True:
            self.db.execute(CONTRACT)
            for i, ids in self.db.execute("SELECT w, string_agg(b, ',' ORDER BY q) FROM done WHERE round = -1 GROUP BY w").fetchall():
                out[i] = ids
            self.db.execute("CREATE OR REPLACE TEMP TABLE first AS SELECT w, p, q, a, b, key FROM done WHERE round = -2")
            if not self.db.execute("SELECT count(*) FROM first").fetchall()[0][0]:
                return out

    def contract_long(self, piece: bytes) -> str:
        self.db.execute(f"SET memory_limit = '{max(self.memory_mb, len(piece) * PIECE_X // 1_000_000)}MB'")
        state = self.pa.table({"p": np.arange(len(piece), dtype=np.int32), "t": self.byte_ids[np.frombuffer(piece, np.uint8)]})
        while True:
            self.db.register("given_long", state)
            self.db.execute(CONTRACT_LONG.format(rounds=max(1, min(256, ROWS // state.num_rows))))
            done = self.db.execute("SELECT count(*) FROM long WHERE round = -1").fetchall()[0][0]
            state = self.db.sql(f"SELECT p, t FROM long {'WHERE round = -1' if done else ''} ORDER BY p").to_arrow_table()
            if done:
                self.db.execute(f"DROP TABLE long; SET memory_limit = '{self.memory_mb}MB'")
                return ",".join(map(str, state["t"].to_pylist()))

    def learn(self, words: set[str]) -> None:
        """Fill known with the short words, and long with the others, which are kept for one chunk only."""
        if len(self.known) + len(words) > KEPT:
            self.known.clear()
        self.long.clear()
        known, whole = self.known, self.whole
        new: list[bytes] = []
        names: list[str] = []
        parts: dict[str, list[bytes]] = {}
        for word in words - known.keys():
            b = word.encode()
            if b in whole:  # a match that is a token is that token
                known[word] = whole[b]
            elif len(b) <= CUT:
                new.append(b)
                names.append(word)
            else:
                parts[word] = self.pieces(b)
        short = {p for x in parts.values() for p in x if p not in whole and len(p) <= LONG}
        found = dict(zip(names, self.batches(new), strict=True))
        of_piece = dict(zip(short, self.batches(list(short)), strict=True))
        known.update(found)
        for word, x in parts.items():
            self.long[word] = ",".join(whole.get(p) or of_piece.get(p) or self.contract_long(p) for p in x)

    def batches(self, words: list[bytes]) -> list[str]:
        out = [""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))  # words of about one length end in about one round
        begin = 0
        while begin < len(order):
            end = min(len(order), begin + max(1, QUERY_BYTES // len(words[order[begin]])))
            while end - 1 > begin and (end - begin) * len(words[order[end - 1]]) > 2 * QUERY_BYTES:
                end -= max(1, (end - begin) // 2)
            for i, ids in zip(order[begin:end], self.contract([words[i] for i in order[begin:end]]), strict=True):
                out[i] = ids
            begin = end
        return out

    def encode(self, texts: list[str]) -> list[str]:
        """Decimal ids of each text, joined by commas."""
        parts = [self.find(x) for x in texts]
        self.learn(set().union(*parts))
        if self.long:
            both = {**self.long, **{x: self.known[x] for x in set().union(*parts) if x not in self.long}}
            get = both.__getitem__
        else:
            get = self.known.__getitem__
        return [",".join(map(get, x)) for x in parts]

    def decode(self, ids: list[str]) -> list[bytes]:
        """The bytes of each text's ids."""
        counts = np.array([x.count(",") + 1 if x else 0 for x in ids], np.int32)
        flat = np.fromstring(",".join(x for x in ids if x), np.int32, sep=",") if counts.any() else np.empty(0, np.int32)
        text = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
        parts: list[list[bytes]] = [[] for _ in ids]
        for at in range(0, len(flat), DECODED):
            some = slice(at, at + DECODED)
            self.db.register("coded", self.pa.table({"d": text[some], "pos": np.arange(len(flat[some]), dtype=np.int32), "id": flat[some]}))
            for d, b in self.db.execute("SELECT d, array_to_string(list(b ORDER BY pos), '') FROM coded JOIN vocab USING (id) GROUP BY d").fetchall():
                parts[d].append(bytes.fromhex(b))
        return [b"".join(x) for x in parts]


#: A worker process keeps its coder, with the words that it has encoded, for the partitions that come after.
_CODERS: dict[tuple[str, str], Coder] = {}


def coder_of(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(path, pattern)
    return _CODERS[path, pattern]


def chunks(texts: list[str], most: int = CHUNK) -> Iterator[slice]:
    """Slices of bounded size; a longer text has one of its own."""
    begin = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(x)
    if texts:
        yield slice(begin, len(texts))


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids: bool = False) -> DataFrame:
    """One row for each row of docs: id_col, n_tokens, ids_sha256, decoded_sha256, and with ids also ids (array) and decoded (binary)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = coder_of(path, pattern)
        for pdf in batches:
            texts = ["" if x is None else x for x in pdf["text"]]
            for part in chunks(texts):
                coded = coder.encode(texts[part])
                decoded = coder.decode(coded)
                out = {"id": pdf["id"].iloc[part], "n_tokens": [x.count(",") + 1 if x else 0 for x in coded], "ids_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in coded], "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in decoded]}
                if ids:
                    out |= {"ids": [[int(y) for y in x.split(",")] if x else [] for x in coded], "decoded": decoded}
                yield pd.DataFrame(out)

    more = ", ids array<int>, decoded binary" if ids else ""
    out = docs.select(F.col(id_col).cast("string").alias("id"), "text").mapInPandas(run, f"id string, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)
