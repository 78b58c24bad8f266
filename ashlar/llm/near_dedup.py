"""MinHash near-dedup.

Universal hash minima of each document's shingle set, cut into bands; documents
that share a band are candidates; signatures screen them, full sets confirm
them, and components come from alternating large-star and small-star.

Documents with one set are a class and stand in by their smallest id. In a
band's bucket every member is first compared with the bucket's smallest id, so
a bucket of any size gives no more pairs than members. Large buckets whose
members are in several components then have further stars, around members drawn
by hash, for a few rounds. What is left to compare are pairs of one bucket in
different components: small buckets pair them by a join, large ones in blocks
of full sets, so no link between different texts that share a band is lost.

With 40 bands of 5 minima a pair of similarity 0.8 shares no band with a chance
of 1.3e-7. The screen drops a pair of that similarity if fewer than 0.63 (six
standard deviations below 0.8) of its 200 minima are equal, with a chance of
2.0e-8 by the binomial sum. Pairs of a higher similarity are missed less often.

Defined cases: null, empty or wordless text has an empty set, links with
nothing and is kept; fewer words than a shingle make the whole sequence one
shingle; rows that repeat an id are one document, whose text is the one with
the greatest hash where they differ; a row without an id links with nothing, is
kept and has no component; an empty table gives an empty table; other columns,
whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ashlar.lineage import cut, drop_cut

BANDS, ROWS = 40, 5
#: Buckets of up to that many classes are compared by a join, larger ones in blocks.
SMALL, BLOCK = 12, 1024
#: Standard deviations below the limit at which the screen drops a pair; rounds of further stars.
SIGMAS, STARS = 6, 1
MASK = 2**64 - 1


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """Distinct 64-bit hashes of the k-word shingles, sorted."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode().lower().split()  # A-Z only; ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=k)], np.uint64)
    known: dict[bytes, int] = {}
    hashes = np.fromiter((known[w] if w in known else known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words), np.uint64, len(words))
    n = len(words) - k + 1
    out = hashes[:n].copy()
    for i in range(1, k):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[i : i + n] * np.uint64(2 * i + 1)
    return np.unique(out ^ (out >> np.uint64(32)))


def hash_family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, np.uint64)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """32-bit minima of multiply-shift hashes."""
    out = np.full(len(a), MASK, np.uint64)
    for at in range(0, len(shingles), 512):
        out = np.minimum(out, (a[:, None] * shingles[None, at : at + 512] + b[:, None]).min(axis=1))
    return (out >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, id_col: str, k: int, bands: int, rows: int, seed: int) -> DataFrame:
    """id, h (the text's hash), n (set size), key (16 bytes that name the set), sig (16 bits of each minimum), bands (one hash each; both null for empty sets)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = hash_family(bands * rows, seed)
        for pdf in batches:
            out = []
            for i, h, text in zip(pdf["id"], pdf["h"], pdf["text"], strict=True):
                s = shingle_hashes(text, k)
                if not len(s):
                    out.append((i, h, 0, None, None, None))
                    continue
                m = minima(s, a, b)
                band = m.reshape(bands, rows)
                out.append((i, h, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), (m & 0xFFFF).astype(np.uint16).tobytes(), [xxhash.xxh3_64_intdigest(band[j].tobytes(), seed=j) - 2**63 for j in range(bands)]))
            yield pd.DataFrame(out, columns=["id", "h", "n", "key", "sig", "bands"])

    return docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64("text").alias("h"), "text").mapInPandas(run, "id string, h long, n long, key binary, sig binary, bands array<long>").withColumn("id", F.col("id").cast("long"))


def likely(sig_a: pd.Series, sig_b: pd.Series, least: float) -> pd.Series:
    """Whether the share of equal minima is at least least."""
    if not len(sig_a):
        return pd.Series([], dtype=bool)
    a, b = (np.frombuffer(b"".join(x), np.uint16).reshape(len(x), -1) for x in (sig_a, sig_b))
    return pd.Series((a == b).mean(axis=1) >= least)


def full_sets(docs: DataFrame, id_col: str, k: int, ids: DataFrame) -> DataFrame:
    """id, s: the shingle sets of the documents in ids."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "s": [shingle_hashes(t, k).view(np.int64) for t in pdf["text"]]})

    # merged at every size, so that small inputs tell what large ones need
    texts = docs.select(F.col(id_col).cast("long").alias("id"), "text").join(ids.hint("merge"), "id", "left_semi")
    texts = texts.groupBy("id").agg(F.max_by("text", F.xxhash64("text")).alias("text"))
    return texts.mapInPandas(sets, "id long, s array<long>")


def confirm(pairs: DataFrame, classes: DataFrame, percent: int, least: float, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs (a, b) of class ids whose full sets are similar enough. sets_of: ids to a table of sets that has them."""
    screen = F.pandas_udf(lambda x, y: likely(x, y, least), "boolean")

    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"s_{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where((100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a")))
    near = cut(near.where(screen("s_a", "s_b")).select("a", "b", "n_a", "n_b"), "near-pairs")
    full = sets_of(near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct())
    both = near.join(full.select(F.col("id").alias("b"), F.col("s").alias("t_b")), "b").join(full.select(F.col("id").alias("a"), F.col("s").alias("t_a")), "a")
    common = F.size(F.array_intersect("t_a", "t_b"))
    links = cut(both.where(100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b"), "near-links")
    drop_cut(near)
    return links


def components(links: DataFrame, most: int = 64) -> DataFrame:
    """id, component (the smallest id reachable) of every id in links (a, b), by alternating large-star and small-star."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        """Neighbours v of u go to the least of u and its neighbours: those above u, or those below u along with u."""
        if large:
            both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = both.join(low, "u")
        out = joined.where("v > u") if large else joined
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            out = out.union(low.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    mark = None
    for _ in range(most):
        seen = Observation()  # counted while it is written
        new = cut(star(star(edges, True), False).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")), "cc")
        now = (seen.get["n"], seen.get["s"])
        drop_cut(edges)
        edges = new
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    # settled: every edge points to its component's smallest id
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


def join_components(found: DataFrame, more: DataFrame) -> DataFrame:
    """found (id, component) after further links (a, b): only the components that these join are worked on again."""
    of = lambda x: found.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}"))
    lifted = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    joined = components(lifted).withColumnRenamed("component", "joined")
    ends = more.select(F.col("a").alias("id")).union(more.select(F.col("b").alias("id"))).distinct().join(found, "id", "left_anti")
    known = found.unionByName(ends.withColumn("component", F.col("id")))
    return known.join(joined.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("joined", "component").alias("component"))


def _family_links(members: DataFrame, classes: DataFrame, full: DataFrame, percent: int, least: float) -> DataFrame:
    """Links (a, b) that join different components within families of large buckets, found block against block.

    members: a (the bucket's smallest id), id, component; full: their sets. Buckets that share
    members are a family, so that a pair is compared once. A block's task holds
    two blocks of full sets and gives links that join what is still apart, never
    all pairs.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] != 1], pdf[pdf["side"] != 0]
        links: list[tuple[int, int]] = []
        if len(left) and len(right):
            (a, b) = (np.frombuffer(b"".join(x["sig"]), np.uint16).reshape(len(x), -1) for x in (left, right))
            ids_a, ids_b, comp_a, comp_b, n_a, n_b, set_a, set_b = (x[c].to_numpy() for c in ("id", "component", "n", "s") for x in (left, right))
            above: dict[int, int] = {}

            def top(x: int) -> int:
                while x in above:
                    x = above[x]
                return x

            for i in range(len(left)):
                open_ = np.flatnonzero((comp_b != comp_a[i]) & (100 * n_b >= percent * n_a[i]) & (100 * n_a[i] >= percent * n_b))
                for j in open_[(b[open_] == a[i]).mean(axis=1) >= least] if len(open_) else ():
                    x, y = top(comp_a[i]), top(comp_b[j])
                    if x == y:
                        continue
                    common = len(np.intersect1d(set_a[i], set_b[j], assume_unique=True))
                    if 100 * common >= percent * (n_a[i] + n_b[j] - common):
                        links.append((min(ids_a[i], ids_b[j]), max(ids_a[i], ids_b[j])))
                        above[max(x, y)] = min(x, y)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    family = components(members.where("a <> id").select("a", F.col("id").alias("b")).distinct()).withColumnRenamed("component", "family")
    placed = cut(members.select("id", "component").distinct().join(family, "id"), "families")
    sizes = placed.groupBy("family").agg(F.count("*").alias("size"))
    dealt = placed.join(sizes, "family").join(classes.select("id", "n", "sig"), "id").join(full, "id")
    dealt = dealt.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("at", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("at"), j).alias("x"), F.greatest(F.col("at"), j).alias("y")))
    sent = dealt.withColumn("p", F.explode(pairs)).select("family", "id", "component", "n", "sig", "s", "at", "p.x", "p.y")
    side = F.when(F.col("x") == F.col("y"), 2).when(F.col("at") == F.col("x"), 0).otherwise(1)  # 2: a block with itself
    return cut(sent.withColumn("side", side).drop("at").groupBy("family", "x", "y").applyInPandas(compare, "a long, b long"), "family-links")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, seed: int = 7) -> DataFrame:
    """One row for each row of docs: id_col, n_shingles, component_id, kept (whether it is its component's smallest id)."""
    least = percent / 100 - SIGMAS * (percent / 100 * (1 - percent / 100) / (bands * rows)) ** 0.5
    full = cut(signatures(docs, id_col, k, bands, rows, seed), "signatures")
    signed = cut(full.select("id", "h", "n", "key"), "sets")
    one = full.where("n > 0 and id is not null")
    texts_of = signed.where("id is not null").groupBy("id").agg(F.max("h").alias("h"), F.min("h").alias("other"))
    several = cut(texts_of.where("h <> other").select("id", "h"), "repeated-ids")
    repeats = not several.isEmpty()
    if repeats:
        lost = signed.join(several.withColumnRenamed("h", "own"), "id").where("h <> own").select("id", "h").distinct()
        one = one.join(lost, ["id", "h"], "left_anti")
    classes = cut(one.groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "classes")
    drop_cut(full)
    by_band = classes.select("id", F.explode("bands").alias("h"))
    buckets = cut(by_band.groupBy("h").agg(F.min("id").alias("a"), F.count("*").alias("size")).where("size > 1"), "buckets")
    members = cut(by_band.join(buckets, "h"), "bucket-members")
    drop_cut(buckets)
    stars = members.where("id <> a").select("a", F.col("id").alias("b")).distinct()
    fresh = lambda ids: cut(full_sets(docs, id_col, k, ids), "near-sets")
    found = cut(components(confirm(stars, classes, percent, least, fresh)), "components")

    def open_buckets(among: DataFrame) -> DataFrame:
        """The members, with components, of buckets that hold several components."""
        placed = among.where("size > 2").select("h", "a", "id", "size").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        apart = placed.groupBy("h").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("h")
        return cut(placed.join(apart, "h", "left_semi").select("h", "a", "id", "component", "size"), "open-buckets")

    open_ = open_buckets(members)
    if not open_.isEmpty():
        sets = fresh(open_.select("id").distinct())  # once for all that follows
        for turn in range(STARS):
            large = open_.where(F.col("size") > SMALL)
            centre = large.groupBy("h").agg(F.min_by(F.struct("id", "component"), F.xxhash64("id", F.lit(turn))).alias("c"))
            pairs = large.join(centre, "h").where(F.col("component") != F.col("c.component"))
            pairs = pairs.select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b")).distinct()
            new = confirm(pairs, classes, percent, least, lambda ids: sets)
            if new.isEmpty():
                break
            found = cut(join_components(found, new), "components")
            open_ = open_buckets(open_)

        few = open_.where(F.col("size") <= SMALL)
        other = few.select("h", F.col("id").alias("b"), F.col("component").alias("component_b"))
        pairs = few.select("h", F.col("id").alias("a"), "component").join(other, "h").where("a < b and component <> component_b").select("a", "b").distinct()
        more = confirm(pairs.join(stars, ["a", "b"], "left_anti"), classes, percent, least, lambda ids: sets)
        large = open_.where(F.col("size") > SMALL)
        if not large.isEmpty():
            more = more.union(_family_links(large.select("a", "id", "component"), classes, sets, percent, least))
        if not more.isEmpty():
            found = cut(join_components(found, more), "components")
        drop_cut(sets)
    for old in (open_, members):
        drop_cut(old)

    by_key = classes.select("key", F.col("id").alias("rep")).join(found.withColumnRenamed("id", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    rows_ = signed
    if repeats:  # all rows of an id have the component of the text that counts
        counted = signed.join(several, ["id", "h"], "left_semi").select("id", F.col("key").alias("own")).dropDuplicates(["id"])
        rows_ = signed.join(counted, "id", "left").withColumn("key", F.coalesce("own", "key"))
    out = rows_.select("id", "n", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(by_key, "key", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
