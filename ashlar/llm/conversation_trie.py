"""The prefix trie of conversations, by burst tries.

A conversation is a string of turns; a turn is 20 bytes, the digest of its role
and text and the text's code points. Equal conversations are one string with
its members' number, least id and digest. Strings lie as suffixes in containers,
each below a trie head and all with one next turn. A container of more than
limit strings bursts: its common turns become trie nodes down to a new head,
below which its strings are dealt to containers by their next turn. What remains
is sorted, container by container, and swept once: a stack of open nodes gives
each node its sums when the sweep leaves it. Heads are few (strings over limit);
sums of what lies below them are rolled up along their paths.

A hot first turn, or one conversation that thousands share a beginning with, is
thereby dealt to as many tasks as its strings need; a task holds the open nodes
of one container, a conversation takes 20 bytes a turn. Digests of equal
conversations' ids are made from sorted runs of ids, each the join of bounded
groups; the last step of one digest runs in one task, as SHA-256 goes byte by
byte, over runs of up to 1,024 ids a row.

Defined cases: a null turn comes first, turns of one place are in order of their
digests, so repeated rows are repeated turns; null roles and texts are empty;
rows without conv_id are no conversation; an empty table has no node, not even
the root; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ashlar.lineage import cut

#: Bytes of a turn: a digest of 16 and a length of 4.
TURN = 20
#: The most strings of a container.
LIMIT = 1_000
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, head binary"


def as_strings(turns: DataFrame) -> DataFrame:
    """conv_id, seq: each conversation's turns in order, TURN bytes each."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turn = F.unhex(F.concat(digest, F.lpad(F.hex(F.length(text)), 8, "0")))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), turn.alias("t")).alias("s"))
    ordered = F.transform(F.sort_array(F.collect_list("s")), lambda s: F.hex(s["t"]))  # null turns sort first
    return rows.groupBy("conv_id").agg(F.unhex(F.array_join(ordered, "")).alias("seq"))


def turns_from(seq: Column, begin: Column | int, n: Column | int | None = None) -> Column:
    """n turns (all by default) of a string, from the begin-th on, which counts from 0."""
    at = (F.lit(begin) if isinstance(begin, int) else begin) * TURN + 1
    return F.substring(seq, at.cast("int"), F.lit(2**31 - 1) if n is None else ((F.lit(n) if isinstance(n, int) else n) * TURN).cast("int"))


def grafted(strings: DataFrame, block: int, most: int) -> DataFrame:
    """Strings whose first turns, crc32(conv_id) % most of them, are those of the first conversation of their block of ids."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most))
    base = strings.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), turns_from(F.col("seq"), 0, most - 1).alias("lead"))
    rows = strings.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).join(base, "base", "left")  # a base has under 2 x block rows
    lead = turns_from(F.coalesce("lead", F.lit(b"")), 0, h)
    return rows.select("conv_id", F.concat(lead, turns_from(F.col("seq"), h)).alias("seq"))


def ends_digests(strings: DataFrame) -> DataFrame:
    """key, ends_sha256: of each distinct string, of its conversations' ids in order."""
    run = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    runs = strings.groupBy(F.md5("seq").alias("key"), F.shiftright("conv_id", 10).alias("run")).agg(run.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, hashlib.sha256()
        for batch in batches:
            keys, found = [], []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k == key:
                    sha.update(b",")
                else:
                    if key is not None:
                        keys.append(key)
                        found.append(sha.hexdigest())
                    key, sha = k, hashlib.sha256()
                sha.update(ids.encode())
            yield pa.record_batch([pa.array(keys, pa.string()), pa.array(found, pa.string())], names=["key", "ends_sha256"])
        if key is not None:
            yield pa.record_batch([[key], [sha.hexdigest()]], names=["key", "ends_sha256"])

    return runs.repartition("key").sortWithinPartitions("key", "run").select("key", "ids").mapInArrow(digest, "key string, ends_sha256 string")


class Open:
    """A node that the sweep is in."""

    __slots__ = ("children", "conv", "ends", "leaves", "length", "n", "pending", "saved")

    def __init__(self, length: int) -> None:
        self.length, self.n, self.conv, self.children, self.leaves, self.saved, self.ends = length, 0, None, 0, 0, 0, NOTHING
        self.pending: list[tuple] = []


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of sorted containers: a node is complete when a string outside it comes."""
    names = [x.split()[0] for x in NODE.split(", ")]
    out: list[tuple] = []
    stack: list[Open] = []
    container, before, depth, head, head_conv = None, b"", 0, b"", None

    def leave(upto: int) -> None:
        while len(stack) > upto:
            x = stack.pop()
            x.saved += (x.n - 1) * x.length
            x.leaves = x.leaves or 1
            out.extend((*c[:2], x.conv, *c[3:]) for c in x.pending)
            above = stack[-1] if stack else None
            row = (x.conv, depth + len(stack) + 1, head_conv, x.n, x.children, x.leaves, x.saved, x.ends, None if above else head)
            if above is None:
                out.append(row)
            else:
                above.pending.append(row)
                above.n += x.n
                above.conv = x.conv if above.conv is None else min(above.conv, x.conv)
                above.children += 1
                above.leaves += x.leaves
                above.saved += x.saved

    def batch() -> pa.RecordBatch:
        made = pa.record_batch([pa.array(c, pa.string() if n == "ends_sha256" else pa.binary() if n == "head" else pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)], names=names)
        out.clear()
        return made

    for b in batches:
        for c, suffix, n, conv, ends, d, h, hc in zip(*(x.to_pylist() for x in b.columns), strict=True):
            same = 0
            if c == container:
                most = min(len(before), len(suffix))
                while same < most and before[same : same + TURN] == suffix[same : same + TURN]:
                    same += TURN
            leave(same // TURN)
            container, before, depth, head, head_conv = c, suffix, d, h, hc
            stack.extend(Open(int.from_bytes(suffix[i + 16 : i + TURN], "big")) for i in range(same, len(suffix), TURN))
            top = stack[-1]
            top.n, top.ends = top.n + n, ends
            top.conv = conv if top.conv is None else min(top.conv, conv)
            if len(out) > 20_000:
                yield batch()
    leave(0)
    if out:
        yield batch()


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two strings, which share the first one, begin with alike."""
    n = (F.least(F.length(a), F.length(b)) / TURN).cast("int")
    unlike = F.array_position(F.transform(F.sequence(F.lit(0), n - 1), lambda i: turns_from(a, i, 1) == turns_from(b, i, 1)), False)
    return F.when(unlike > 0, unlike - 1).otherwise(n).cast("int")


def prefix_trie(strings: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of the trie of strings (conv_id, seq): conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    strings = cut(strings, "conversations")
    seqs = strings.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).withColumn("key", F.md5("seq"))
    seqs = cut(seqs.join(ends_digests(strings), "key").drop("key"), "strings")
    whole = seqs.agg(F.sum("n").alias("n"), F.min("conv_id").alias("conv_id")).first()
    root = F.lit(b"")
    first = seqs.where(F.length("seq") > 0).withColumn("container", F.unhex(F.md5(turns_from(F.col("seq"), 0, 1))))
    rows = first.select("container", root.alias("head"), F.lit(0).alias("depth"), F.lit(whole["conv_id"]).cast("long").alias("head_conv"), F.array(root).alias("path"), F.col("seq").alias("suffix"), "n", "conv_id", F.col("ends_sha256").alias("ends"))
    stays, heads, ended = [], [], [seqs.where(F.length("seq") == 0).select(root.alias("head"), F.col("ends_sha256").alias("ends"))]
    rest = ["head", "depth", "head_conv", "path"]
    while True:
        sizes = rows.groupBy("container").agg(F.count("*").alias("m"), F.min("suffix").alias("lo"), F.max("suffix").alias("hi"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), *(F.first(c).alias(c) for c in rest))
        large = sizes.where(F.col("m") > limit).withColumn("lcp", common_turns(F.col("lo"), F.col("hi")))
        large = cut(large.withColumn("chain", turns_from(F.col("lo"), 0, F.col("lcp"))).drop("m", "lo", "hi"), "burst")
        if large.isEmpty():
            break
        heads.append(large)
        stays.append(rows.join(large.select("container"), "container", "left_anti"))
        below = rows.drop(*rest).join(large.select("container", "lcp", F.col("conv_id").alias("head_conv"), *("depth", "path")), "container")
        below = below.select(F.col("container").alias("head"), (F.col("depth") + F.col("lcp")).alias("depth"), "head_conv", F.concat("path", F.array("container")).alias("path"), turns_from(F.col("suffix"), F.col("lcp")).alias("suffix"), "n", "conv_id", "ends")
        below = cut(below, "below")
        ended.append(below.where(F.length("suffix") == 0).select("head", "ends"))
        rows = below.where(F.length("suffix") > 0).withColumn("container", F.unhex(F.md5(F.concat("head", turns_from(F.col("suffix"), 0, 1)))))
    stays.append(rows)
    held = stays[0].select("container", "suffix", "n", "conv_id", "ends", "depth", "head", "head_conv")
    for x in stays[1:]:
        held = held.unionByName(x.select(held.columns))
    swept = cut(held.repartition("container").sortWithinPartitions("container", "suffix").mapInArrow(sweep, NODE), "swept")
    return swept.drop("head").unionByName(head_nodes(seqs, swept, heads, ended, whole["n"] or 0, whole["conv_id"]))


def head_nodes(seqs: DataFrame, swept: DataFrame, heads: list[DataFrame], ended: list[DataFrame], n: int, conv_id: int | None) -> DataFrame:
    """The nodes above and at the trie heads: each head's common turns, and the root."""
    spark = seqs.sparkSession
    columns = [x.split()[0] for x in NODE.split(", ") if not x.startswith("head")]
    own = swept.where("head is not null").groupBy("head").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    root = spark.range(1 if n else 0).select(F.lit(b"").alias("container"), F.lit(None).cast("binary").alias("head"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("head_conv"), F.array().cast("array<binary>").alias("path"), F.lit(n).cast("long").alias("n"), F.lit(conv_id).cast("long").alias("conv_id"), F.lit(b"").alias("chain"))
    every, ends = root, ended[0]
    for h in heads:
        every = every.unionByName(h.drop("lcp"))
    for e in ended[1:]:
        ends = ends.unionByName(e)
    code_points = F.transform(F.sequence(F.lit(0), (F.length("chain") / TURN).cast("int") - 1), lambda i: F.conv(F.hex(F.substring("chain", i * TURN + 17, F.lit(4))), 16, 10).cast("long"))
    every = every.withColumn("lengths", F.when(F.length("chain") > 0, code_points).otherwise(F.array().cast("array<long>")))
    every = every.withColumn("chain_saved", (F.col("n") - 1) * F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x))
    every = cut(every.join(own.withColumnRenamed("head", "container"), "container", "left").join(ends.withColumnRenamed("head", "container"), "container", "left"), "heads")
    parts = every.select(F.explode(F.concat("path", F.array("container"))).alias("at"), "container", "leaves", "saved", "chain_saved")
    sums = parts.groupBy(F.col("at").alias("container")).agg(F.sum("leaves").alias("all_leaves"), (F.coalesce(F.sum("saved"), F.lit(0)) + F.sum(F.when(F.col("at") != F.col("container"), F.col("chain_saved")).otherwise(0))).alias("all_saved"))
    kids = every.where("head is not null").groupBy(F.col("head").alias("container")).agg(F.count("*").alias("kids"))
    full = every.join(sums, "container").join(kids, "container", "left").withColumns({"n_children": F.coalesce("children", F.lit(0)) + F.coalesce("kids", F.lit(0)), "ends": F.coalesce("ends", F.lit(NOTHING)), "n_leaves": F.greatest(F.coalesce("all_leaves", F.lit(0)), F.lit(1))})
    top = full.where("head is null").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("all_saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
    turns = full.where("head is not null").select("*", F.posexplode("lengths").alias("i", "length"))
    below = F.sum("length").over(Window.partitionBy("container").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0))
    last = F.col("i") == F.size("lengths") - 1
    chain = turns.withColumn("below", below).select(
        "conv_id",
        (F.col("depth") + F.col("i") + 1).cast("long").alias("depth"),
        F.when(F.col("i") == 0, F.col("head_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("all_saved") + (F.col("n") - 1) * F.col("below")).alias("saved_tokens"),
        F.when(last, F.col("ends")).otherwise(NOTHING).alias("ends_sha256"),
    )
    return top.unionByName(chain).select(columns)


def conversation_trie(turns: DataFrame, block: int | None = None, most: int = 6, limit: int = LIMIT) -> DataFrame:
    """The prefix trie of a table of turns (conv_id, turn, role, text); with block, of conversations grafted on the first one of their block of ids."""
    strings = cut(as_strings(turns), "turns")
    return prefix_trie(grafted(strings, block, most) if block else strings, limit)
