"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Unit vectors are projected by a few Gaussian (2-stable) directions, so that a
projected squared distance over the true one is chi-square distributed. A
kd-tree over the projections is split in two levels: its top, learned from a
bounded sample, deals all vectors into cells; each cell's task builds the rest.
A query meets projected neighbours in order of distance and verifies them on
the original vectors, until the chi-square test says that what is farther holds
no nearer vector with chance ``sure``. The first round searches the query's own
cell; with the distance found there, the second visits only the cells that the
test doesn't rule out.

Equal vectors are searched once, under their smallest ids, so that a vector
that a third of the rows share costs no more than another. Points of a large
cell and queries for one cell are dealt in blocks.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do those of another length than most have (of two
lengths as common, the shorter counts); with fewer candidates than k, all are returned; ties
go to the smaller id; an empty table gives an empty table. Ids are unique;
repeated rows of one id and vector count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ashlar.lineage import cut

DIMS = 8
#: Vectors that teach the top of the tree, vectors of a cell, most cells, points and queries of a task, points of a leaf.
SAMPLE, CELL, CELLS, POINTS, QUERIES, LEAF = 20_000, 8_192, 4_096, 16_384, 4_096, 256


def chi_square_quantile(m: int, sure: float) -> float:
    """Of m degrees of freedom (an even number), by bisection on the closed form."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        term = total = 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        low, high = (x, high) if 1 - np.exp(-x / 2) * total < sure else (low, x)
    return high


def directions(dims: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, m))


def split_tree(points: np.ndarray, leaves: int) -> list:
    """Nested (axis, value, left, right); leaves are numbers."""
    count = 0

    def grow(rows: np.ndarray, n: int):
        nonlocal count
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(1)
        if n <= 1 or not spread.max() > 0:
            count += 1
            return count - 1
        axis = int(spread.argmax())
        value = float(np.quantile(rows[:, axis], (n // 2) / n))
        left = rows[:, axis] <= value
        if left.all():
            left = rows[:, axis] < value
            value = float(np.nextafter(value, -np.inf))
        return (axis, value, grow(rows[left], n // 2), grow(rows[~left], n - n // 2))

    return grow(points, leaves)


def place(tree, points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int32)

    def go(node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, int):
            out[rows] = node
            return
        left = points[rows, node[0]] <= node[1]
        go(node[2], rows[left])
        go(node[3], rows[~left])

    go(tree, np.arange(len(points)))
    return out


def leaves_of(points: np.ndarray) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree split at medians."""
    out: list[np.ndarray] = []
    todo = [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        part = points[rows]
        axis = int((part.max(axis=0) - part.min(axis=0)).argmax())
        order = np.argpartition(part[:, axis], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


def stack(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(np.float64)


def box_distance(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distance of a point from boxes."""
    gap = np.maximum(np.maximum(low - point, point - high), 0)
    return (gap * gap).sum(axis=1)


def search_block(points: pd.DataFrame, queries: pd.DataFrame, need: int, quantile: float) -> pd.DataFrame:
    """The need nearest of a block's points to each query: q, id, score. queries: q, v, p, d2 (squared distance that is known to hold need vectors)."""
    vectors, projected = stack(points["v"]), stack(points["p"])
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    ids = points["ids"].to_numpy()
    leaves = leaves_of(projected)
    low, high = (np.array([f(projected[x], axis=0) for x in leaves]) for f in (np.min, np.max))
    out = []
    for q, v, p, d2 in zip(queries["q"], stack(queries["v"]), stack(queries["p"]), queries["d2"], strict=True):
        far = box_distance(low, high, p)
        norm = np.sqrt((v * v).sum())
        best: list[tuple[float, int]] = []
        for leaf in np.argsort(far):
            if far[leaf] > d2 * quantile:
                break
            rows = leaves[leaf]
            score = (vectors[rows] * v).sum(axis=1) / (norms[rows] * norm)
            good = score >= -best[need - 1][0] if len(best) >= need else np.ones(len(rows), bool)
            if good.any():
                top = np.flatnonzero(good)
                best += [(-score[i], int(x)) for i in top for x in ids[rows[i]]]
                best = sorted(best)[:need]
                if len(best) >= need:
                    d2 = min(d2, max(0.0, 2 + 2 * best[-1][0]))
        out += [(q, i, -s) for s, i in best]
    return pd.DataFrame(out, columns=["q", "id", "score"])


def nearest(rows: DataFrame, queries: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = 5, sure: float = 0.99, seed: int = 11) -> DataFrame:
    """query_id, rank, id_col, score: the k nearest by cosine to each row where queries holds, itself excluded."""
    need = k + 1  # of the distinct vector, with the query's own id
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    base = rows.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    dims = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    base = base.where(F.size("v") == (dims[0] if dims else 0)).dropDuplicates(["id"])
    first = Window.partitionBy("v").orderBy("id")
    kept = base.withColumn("r", F.row_number().over(first)).where(F.col("r") <= need)
    distinct = kept.groupBy("v").agg(F.min("id").alias("key"), F.sort_array(F.collect_list("id")).alias("ids"))
    if dims is None:
        return rows.select(F.col(id_col).cast("long").alias("query_id"), F.lit(1).alias("rank"), F.col(id_col).cast("long").alias(id_col), F.lit(0.0).alias("score")).limit(0)
    turn = directions(dims[0], DIMS, seed)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = stack(pdf["v"]) if len(pdf) else np.empty((0, dims[0]))
            yield pdf.assign(p=list((v / np.sqrt((v * v).sum(axis=1))[:, None]) @ turn))

    points = cut(distinct.mapInPandas(project, "v array<double>, key long, ids array<long>, p array<double>"), "ann-points")
    n = points.count()
    sample = points.orderBy(F.xxhash64("key")).limit(SAMPLE).select("p").toPandas()
    tree = split_tree(stack(sample["p"]), min(CELLS, -(-n // CELL)))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(cell=place(tree, stack(pdf["p"])) if len(pdf) else np.empty(0, np.int32))

    points = cut(points.mapInPandas(deal, "v array<double>, key long, ids array<long>, p array<double>, cell int"), "ann-cells")
    cells = points.groupBy("cell").agg(F.count("*").alias("n"), *(f(F.col("p")[i]).alias(f"{name}{i}") for i in range(DIMS) for f, name in ((F.min, "low"), (F.max, "high")))).toPandas()
    number = cells["cell"].to_numpy()
    low, high = (cells[[f"{name}{i}" for i in range(DIMS)]].to_numpy(float) for name in ("low", "high"))
    quantile = chi_square_quantile(DIMS, sure)
    blocks = rows.sparkSession.createDataFrame([(int(c), int(-(-m // POINTS))) for c, m in zip(number, cells["n"], strict=True)], "cell int, blocks int")

    asking = base.where("asks").select(F.col("id").alias("query_id"), "v").join(points.select("v", "key", "p", "cell"), "v").select("query_id", "key", "v", "p", "cell")
    asking = cut(asking, "ann-asking")
    once = asking.dropDuplicates(["key"]).select(F.col("key").alias("q"), "v", "p", "cell")

    def search(routed: DataFrame) -> DataFrame:
        """routed: q, v, p, d2, cell."""
        loads = routed.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("shares"))
        near = points.join(loads, "cell").join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        near = near.select("cell", "block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "v", "p", "ids")
        far = routed.join(loads, "cell").join(blocks, "cell").withColumn("share", F.pmod(F.xxhash64("q"), F.col("shares")).cast("int"))
        far = far.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "share", "q", "v", "p", "d2")

        def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return search_block(a, b, need, quantile) if len(a) and len(b) else pd.DataFrame({"q": [], "id": [], "score": []})

        keys = ["cell", "block", "share"]
        return near.groupBy(*keys).cogroup(far.groupBy(*keys)).applyInPandas(both, "q long, id long, score double")

    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    own = cut(search(once.withColumn("d2", F.lit(4.0))), "ann-own")
    own = own.withColumn("r", F.row_number().over(best)).where(F.col("r") <= need).drop("r")
    reach = own.groupBy("q").agg(F.when(F.count("*") >= need, F.greatest(2 - 2 * F.min("score"), F.lit(0.0))).otherwise(4.0).alias("d2"))
    asked = once.join(reach, "q", "left").withColumn("d2", F.coalesce("d2", F.lit(4.0)))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = stack(pdf["p"]) if len(pdf) else ()
            yield pdf.assign(cells=[number[(box_distance(low, high, x) <= d2 * quantile) & (number != c)] for x, d2, c in zip(p, pdf["d2"], pdf["cell"], strict=True)])

    routed = asked.mapInPandas(route, "q long, v array<double>, p array<double>, cell int, d2 double, cells array<int>")
    routed = cut(routed.select("q", "v", "p", "d2", F.explode("cells").alias("cell")), "ann-routed")
    found = cut(own.unionByName(search(routed)).withColumn("r", F.row_number().over(best)).where(F.col("r") <= need).drop("r"), "ann-found")
    out = asking.select("query_id", F.col("key").alias("q")).join(found, "q").where("id <> query_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("id").alias(id_col), "score")
