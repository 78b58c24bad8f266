"""Vector tables: coarse partitions, hashed joins, embeddings, chunk means, recommendations."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ashlar.lineage import cut
from ashlar.operators.neighbours import distances, lowest, pivots, slices, usable
from ashlar.operators.search import knn_many


def unit(vector: str | Column) -> Column:
    """The vector over its length; null for a zero vector."""
    v = F.col(vector) if isinstance(vector, str) else vector
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def ivf_build(base: DataFrame, id_col: str, vector: str, lists: int, sample: int = 50_000, rounds: int = 8, seed: int = 5) -> tuple[DataFrame, np.ndarray]:
    """(id, v, list; the centres) of a coarse index by cosine: centres by k-means over a bounded sample by hash, all rows dealt to their nearest one."""
    rows = base.where(F.exists(vector, lambda x: x != 0)).select(F.col(id_col).alias("id"), unit(vector).alias("v"))
    learned = lowest(rows, F.xxhash64("id", F.lit(seed)), rows.count(), sample).select("v").toPandas()
    points = np.stack(learned["v"].to_numpy()) if len(learned) else np.zeros((1, 1))
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(lists, len(points)), replace=False)]
    for _ in range(rounds):
        own = (points @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                mean = points[own == c].mean(axis=0)
                centres[c] = mean / max(np.linalg.norm(mean), 1e-12)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            near = (np.stack(pdf["v"].to_numpy()) @ centres.T).argmax(axis=1) if len(pdf) else np.empty(0, int)
            yield pdf.assign(list=near)

    kind = base.schema[id_col].dataType.simpleString()
    return cut(rows.mapInPandas(deal, f"id {kind}, v array<double>, list long"), "ivf"), centres


def ivf_search(index: DataFrame, centres: np.ndarray, queries: DataFrame, id_col: str, vector: str, k: int, probes: int, share: int = 20_000) -> DataFrame:
    """query_id, id, score: the k nearest by cosine among the probes nearest lists of each query, exactly ranked there.

    A list of more than share rows is searched in several tasks, and so many
    queries come to it at a time; a task holds the scores of 250 of them.
    """
    kind = queries.schema[id_col].dataType.simpleString()
    asked = queries.where(F.exists(vector, lambda x: x != 0)).select(F.col(id_col).alias("query_id"), unit(vector).alias("q"))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            near = np.argsort(-(np.stack(pdf["q"].to_numpy()) @ centres.T), axis=1)[:, :probes] if len(pdf) else []
            yield pdf.assign(lists=list(near))

    routed = asked.mapInPandas(probe, f"query_id {kind}, q array<double>, lists array<long>").select("query_id", "q", F.explode("lists").alias("list"))
    routed = cut(routed, "ivf-routed")
    turns = routed.groupBy("list").agg(F.ceil(F.count("*") / share).cast("int").alias("turns"))
    loads = index.groupBy("list").agg(F.ceil(F.count("*") / share).cast("int").alias("parts")).join(turns, "list")
    loads = cut(loads, "ivf-lists")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    rows = index.join(loads, "list").select("id", "v", "list", F.expr("cast(pmod(xxhash64(id), parts) as int)").alias("part"), every("turns").alias("turn"))
    routed = routed.join(loads, "list").select("query_id", "q", "list", F.expr("cast(pmod(xxhash64(query_id, 1), turns) as int)").alias("turn"), every("parts").alias("part"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        a = a.sort_values("id")
        ids, points, out = a["id"].to_numpy(), np.stack(a["v"].to_numpy()).T, []
        for s in range(0, len(b), 250):
            part = b.iloc[s : s + 250]
            scores = np.stack(part["q"].to_numpy()) @ points
            at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"query_id": np.repeat(part["query_id"].to_numpy(), at.shape[1]), "id": ids[at].ravel(), "score": np.take_along_axis(scores, at, 1).ravel()}))
        return pd.concat(out)

    keys = ["list", "part", "turn"]
    found = rows.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInPandas(best, f"query_id {kind}, id {index.schema['id'].dataType.simpleString()}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def copies(base: DataFrame, id_col: str, vector: str) -> DataFrame:
    """class, id: each row whose vector, as stored, is also that of a smaller id, and the smallest such id. With lsh_join's pairs, which are between classes, these are all links."""
    rows = usable(base, id_col, vector)
    classes = rows.groupBy("v").agg(F.min("id").alias("class"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(classes, "v").where("id <> class").select("class", "id")


def lsh_join(base: DataFrame, id_col: str, vector: str, least: float, tables: int = 12, bits: int = 10, seed: int = 9, block: int = 16_000, most_cells: int = 256, sample: int = 20_000) -> DataFrame:
    """a, b, score: all pairs a < b with a cosine of at least least, each once.

    First meet the vectors that share a bucket of signs of random projections in
    one of the tables; each pair comes from the first table that joins it. Then the
    rest: vectors lie in cells round pivots, and the pairs that share no bucket come
    from the pairs of cells, left out only where two cells are farther apart than a
    pair can be by the triangle inequality. Where the vectors have no clusters, or
    least is low, that rules out nothing and all pairs are compared, so time
    goes with the square of the vectors.

    Vectors are compared where they meet, and only pairs that reach least leave.
    Buckets and cells of more than block rows are compared part by part, so a task
    holds about twice block rows, and 250 times block scores. The driver holds the
    pivots, from a sample that decides on speed alone, and the cells' sizes. Rows
    of one vector stand in by their smallest id, so copies give no pairs: copies()
    has them. Choose bits by the logarithm of the rows, so that buckets stay small.
    """
    rows = usable(base, id_col, vector).groupBy("v").agg(F.min("id").alias("id"))
    rows = cut(rows, "lsh-vectors")
    width = rows.select(F.size("v")).first()
    if width is None:
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("score"))
    planes = np.random.default_rng(seed).standard_normal((width[0], tables * bits))
    slack = (width[0] + 8) * 2.0**-22  # more than a product in single precision can be off

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            if len(pdf):
                v = np.stack(pdf["v"].to_numpy())
                v = v / np.abs(v).max(axis=1, keepdims=True)  # the squares of very large or small components are not doubles
                v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
                keys = (v @ planes > 0).reshape(len(v), tables, bits) @ (1 << np.arange(bits))
                yield pd.DataFrame({"v": list(v), "id": pdf["id"], "keys": list(keys)})

    kind = base.schema[id_col].dataType.simpleString()
    signed = cut(rows.mapInPandas(sign, f"v array<double>, id {kind}, keys array<long>"), "lsh-signs")
    size = signed.count()
    learned = lowest(signed.select("id", "v"), F.xxhash64("id"), size, sample).toPandas()
    centres = pivots(np.stack(learned["v"].to_numpy()), min(most_cells, -(-size // block)))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            if len(pdf):
                away = distances(np.stack(pdf["v"].to_numpy()), centres)
                yield pdf.assign(cell=away.argmin(axis=1), away=away.min(axis=1))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(batches)).sort_values("id")
        table, p, q = own[["table", "p", "q"]].iloc[0]
        one, two = (own[own["part"] == x] for x in (p, q))
        if one.empty or two.empty:
            return
        (ids, signs, v), (ids2, signs2, v2) = ((x["id"].to_numpy(), np.stack(x["keys"].to_numpy()).astype(np.min_scalar_type((1 << bits) - 1)), np.stack(x["v"].to_numpy())) for x in (one, two))
        rough, rough2 = v.astype(np.float32), v2.astype(np.float32)
        for s in range(0, len(v), 250):
            met = [np.empty((2, 0), int)]
            for t in range(s if p == q else 0, len(v2), 2000):
                score = rough[s : s + 250] @ rough2[t : t + 2000].T
                i, j = np.divmod(np.flatnonzero(score >= np.float32(least - slack)), score.shape[1])
                met.append(np.stack([i + s, j + t]))
            i, j = np.concatenate(met, axis=1)
            if p == q:
                i, j = i[i < j], j[i < j]
            for c in range(0, len(i), 100_000):
                a, b = i[c : c + 100_000], j[c : c + 100_000]
                new = ~(signs[:, :table].take(a, 0) == signs2[:, :table].take(b, 0)).any(axis=1)  # an earlier table has the others
                a, b = a[new], b[new]
                score = (v.take(a, 0) * v2.take(b, 0)).cumsum(axis=1)[:, -1]  # summed in order, whatever the block
                near = score >= least
                a, b = ids[a[near]], ids2[b[near]]
                yield pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "score": score[near]})

    bucket = F.posexplode("keys").alias("table", "key")
    hot = signed.select(bucket).groupBy("table", "key").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).where("parts > 1")
    sent = signed.select("id", "v", "keys", bucket).join(cut(hot, "lsh-hot"), ["table", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    sent = sent.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sent = sent.select("id", "v", "keys", "table", "key", "part", F.least("part", "o").alias("p"), F.greatest("part", "o").alias("q"))

    dealt = cut(signed.mapInPandas(deal, f"v array<double>, id {kind}, keys array<long>, cell int, away double"), "lsh-cells")
    plan = F.broadcast(_cell_pairs(dealt, centres, math.sqrt(max(0.0, 2 - 2 * least)), block))
    rest = dealt.join(plan, "cell").withColumn("part", F.col("start") + F.pmod(F.xxhash64("id", F.lit(seed)), F.col("parts")).cast("int"))
    rest = rest.withColumn("o", F.explode(F.sequence(F.col("other_start"), F.col("other_start") + F.col("other_parts") - 1)))
    rest = rest.select("id", "v", "keys", F.lit(tables).alias("table"), F.lit(0).cast("long").alias("key"), "part", F.least("part", "o").alias("p"), F.greatest("part", "o").alias("q"))
    return sent.unionByName(rest).groupBy("table", "key", "p", "q").applyInPandas(compare, f"a {kind}, b {kind}, score double")


def _cell_pairs(dealt: DataFrame, centres: np.ndarray, reach: float, block: int) -> DataFrame:
    """cell, start, parts, other_start, other_parts: for each cell, those that may hold points within reach of one of its points, itself included. A cell's parts of about block rows are numbered from start."""
    cells = dealt.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"), F.max("away").alias("radius")).orderBy("cell").toPandas()
    at, parts, radius = centres[cells["cell"]], cells["parts"].to_numpy(), cells["radius"].to_numpy()
    start = parts.cumsum() - parts
    c, d = np.nonzero(distances(at, at) - radius[:, None] - radius <= reach + 1e-6)
    plan = pd.DataFrame({"cell": cells["cell"].to_numpy()[c], "start": start[c], "parts": parts[c], "other_start": start[d], "other_parts": parts[d]})
    return dealt.sparkSession.createDataFrame(plan, "cell int, start int, parts int, other_start int, other_parts int")


def recommend(base: DataFrame, examples: DataFrame, id_col: str, vector: str, k: int, where: Column | None = None) -> DataFrame:
    """query_id, id_col, score: the k nearest of each stored example, itself excluded."""
    found = knn_many(base, examples, id_col, vector, k + 1, where).where(F.col("query_id") != F.col(id_col))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return found.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def mean_vector(chunks: DataFrame, key: str, vector: str) -> DataFrame:
    """key, vector: the mean of the key's vectors, of length 1. Sums are by place, so no task holds a key's vectors."""
    cells = chunks.select(key, F.posexplode(vector).alias("_i", "_x")).groupBy(key, "_i").agg(F.avg("_x").alias("_x"))
    means = cells.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda c: c["_x"]).alias("_v"))
    return means.select(key, unit("_v").alias(vector))


def hash_embed(df: DataFrame, id_col: str, text: str, dim: int = 256) -> DataFrame:
    """id_col, vector: signed counts of the text's lower-case tokens in dim places given by md5, of length 1; null without tokens."""
    tokens = df.select(F.col(id_col), F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))).alias("t")).groupBy(id_col, "t").agg(F.count("*").alias("n"))
    digest = F.md5("t")
    place = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")
    sign = F.when(F.substring(digest, 9, 1) < "8", 1).otherwise(-1)
    sums = tokens.groupBy(id_col, place.alias("i")).agg(F.sum(sign * F.col("n")).cast("double").alias("x")).groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(0.0)))
    return df.select(id_col).distinct().join(sums, id_col, "left").select(id_col, F.when(F.col("m").isNotNull(), unit(dense)).alias("vector"))


def embed(df: DataFrame, id_col: str, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """id_col, vector: by a model that load() brings up once a task, batch by batch; null text is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "vector": list(np.asarray(model(list(pdf["text"].fillna(""))), float))})

    kind = df.schema[id_col].dataType
    out = df.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text")).mapInPandas(run, "id string, vector array<double>")
    return out.select(F.col("id").cast(kind).alias(id_col), "vector")
