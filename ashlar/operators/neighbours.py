"""Exact nearest neighbours over cells round pivots: cells that can't hold one of the k nearest are never searched."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ashlar.lineage import cut


def usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, v (doubles): rows whose vector is not null, not zero and has finite components only."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return df.select(F.col(id_col).alias("id"), v.alias("v")).where(finite & F.exists("v", lambda x: x != 0))


def placed(column: pd.Series, metric: str) -> np.ndarray:
    """Vectors as points: of length 1 for cosine, whose order is that of their distances."""
    v = np.stack(column.to_numpy())
    return v / np.linalg.norm(v, axis=1, keepdims=True) if metric == "cosine" else v


def pivots(points: np.ndarray, cells: int, rounds: int = 5, seed: int = 3) -> np.ndarray:
    """Centres of a sample: drawn by squared distance from those drawn before, then moved to their cells' means."""
    rng = np.random.default_rng(seed)
    centres = points[rng.integers(len(points))][None]
    away = ((points - centres[0]) ** 2).sum(axis=1)
    while len(centres) < cells and away.sum() > 0:
        new = points[rng.choice(len(points), p=away / away.sum())]
        centres = np.vstack([centres, new])
        away = np.minimum(away, ((points - new) ** 2).sum(axis=1))
    for _ in range(rounds):
        own = distances(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0))


def nearest(q: pd.DataFrame, b: pd.DataFrame, id_col: str, k: int, metric: str) -> pd.DataFrame:
    """query_id, id_col, score: the k nearest of each row of q in b by unrounded double scores, ties to the smaller id.

    A matrix product finds all rows within its own error of the k-th; these are
    scored anew, each from its original components.
    """
    out: list[pd.DataFrame] = []
    if len(q) and len(b):
        b = b.sort_values("id")
        ids, points, asked = b["id"].to_numpy(), placed(b["v"], metric), placed(q["v"], metric)
        raw, given = np.stack(b["v"].to_numpy()), np.stack(q["v"].to_numpy())
        lengths = (points * points).sum(axis=1)
        last = max(0, len(ids) - k)
        for s in range(0, len(q), 256):
            part = asked[s : s + 256]
            own = (part * part).sum(axis=1)[:, None]
            scores = 2 * (part @ points.T) - own - lengths  # the negative square
            least = np.partition(scores, last, axis=1)[:, [last]] - 1e-9 * (1 + own + float(lengths.max()))
            for i, row in enumerate(scores):
                among = np.flatnonzero(row >= least[i])
                x, y = given[s + i], raw[among]
                exact = -np.sqrt(((y - x) ** 2).sum(axis=1)) if metric == "l2" else (y * x).sum(axis=1) / np.sqrt((y**2).sum(axis=1) * (x**2).sum())
                best = np.argsort(-exact, kind="stable")[:k]
                out.append(pd.DataFrame({"query_id": q["id"].iloc[s + i], id_col: ids[among[best]], "score": exact[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], id_col: [], "score": []})


def top(found: DataFrame, id_col: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def lowest(rows: DataFrame, digest: Column, size: int, most: int) -> DataFrame:
    """The most rows of the lowest digest, a 64-bit hash, of about size: only about twice as many are sorted, so no task and not the driver gets more."""
    share = min(1.0, (2 * most + 200) / max(size, 1))
    few = rows if share == 1 else rows.where(digest <= int(-(2**63) + share * (2**64 - 2**12)))
    return few.orderBy(digest, "id").limit(most)


#: A cell is searched in parts of at least so many rows: smaller ones cost more calls than they save.
PART = 4000

#: So many points are held against all pivots at once.
POINTS = 500


def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches in pieces, so that what a task holds against the pivots is small whatever their number."""
    for pdf in batches:
        for s in range(0, len(pdf), POINTS):
            yield pdf.iloc[s : s + POINTS]


def knn_in_cells(base: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int, block: int = 4000, metric: str = "cosine", most_cells: int = 1024, sample: int = 20_000) -> tuple[DataFrame, dict[str, int]]:
    """(query_id, id_col, score: the k nearest of each query; the pairs of a query and a row that were compared, and all there are).

    metric: cosine, or l2, whose score is the distance's negative. Ids of queries
    are unique. Vectors that are null, zero or hold a null or non-finite component
    take no part.

    Base rows go to the nearest of at most most_cells pivots (centres of a sample
    of bounded size; they decide on speed alone). A cell's rows lie between two
    distances from its pivot and on its side of the plane between its pivot and any
    other, so a query has a least distance to each cell. First a query searches
    the cells nearest to it that hold k rows; then those whose least distance is
    within its k-th best so far. The driver holds the pivots and two distances of
    each, whatever the table's size. Cells hold about block rows, up to most_cells. A
    cell of over PART or block rows is searched in parts of that size, and queries come
    to it in turns of as many, so a hot cell is spread over tasks.
    """
    rows, asked = usable(base, id_col, vector), usable(queries, id_col, vector)
    kinds = [df.schema[id_col].dataType.simpleString() for df in (queries, base)]
    size = rows.count()
    cells = min(most_cells, max(1, math.ceil(size / block)))
    learned = lowest(rows, F.xxhash64("id"), size, sample if cells > 1 else 1).toPandas()
    centres = pivots(placed(learned["v"], metric), cells) if len(learned) else np.zeros((1, 1))
    if not len(learned):
        asked = asked.limit(0)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            if len(pdf):
                away = distances(placed(pdf["v"], metric), centres)
                yield pdf.assign(cell=away.argmin(axis=1), away=away.min(axis=1))

    dealt = cut(rows.mapInPandas(deal, f"id {kinds[1]}, v array<double>, cell int, away double"), "cells")
    n, inner, outer = np.zeros(len(centres), int), np.zeros(len(centres)), np.zeros(len(centres))
    for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("a"), F.max("away").alias("b")).collect():  # at most most_cells rows
        n[r["cell"]], inner[r["cell"]], outer[r["cell"]] = r["n"], r["a"], r["b"]
    between = distances(centres, centres)
    scale = 1 + float(np.abs(centres).max()) * math.sqrt(centres.shape[1]) + float(outer.max())

    def least(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distances to the pivots, least distances to the cells' rows, and what rounding may have added to them."""
        to = distances(points, centres)
        close = to.argmin(axis=1)
        apart = between[close]
        plane = np.where(apart > 1e-5 * scale, (to**2 - to.min(axis=1)[:, None] ** 2) / (2 * np.maximum(apart, 1e-5 * scale)), 0)
        low = np.maximum(np.maximum(to - outer, inner - to), np.maximum(plane, 0))
        return to, np.where(n > 0, low, np.inf), 1e-5 * (scale + np.linalg.norm(points, axis=1))

    def homes(points: np.ndarray) -> list[np.ndarray]:
        to, low, _ = least(points)
        order = np.lexsort((to, low), axis=1)
        held = n[order].cumsum(axis=1)
        need = (held < k).sum(axis=1) + 1  # cells until k rows are held
        return [o[:m][n[o[:m]] > 0] for o, m in zip(order, need, strict=True)]

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            if len(pdf):
                yield pdf.assign(cells=homes(placed(pdf["v"], metric)))

    def later(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            points = placed(pdf["v"], metric)
            _, low, slack = least(points)
            kth = pdf["kth"].to_numpy(float)
            reach = np.sqrt(np.maximum(2 - 2 * kth, 0)) if metric == "cosine" else -kth
            reach = np.where(np.isnan(reach), np.inf, reach) + slack
            inside = (low <= reach[:, None]) & (n > 0)
            seen = homes(points)
            yield pdf[["id", "v"]].assign(cells=[np.setdiff1d(np.flatnonzero(row), s) for row, s in zip(inside, seen, strict=True)])

    compared = {"compared": 0, "all": size * asked.count()}

    def meet(routed: DataFrame) -> DataFrame:
        sent = routed.select("id", "v", F.explode("cells").alias("cell"))
        counted = sent.groupBy("cell").agg(F.count("*").alias("n")).collect()
        loads = [(r["cell"], math.ceil(n[r["cell"]] / max(block, PART)), math.ceil(r["n"] / max(block, PART))) for r in counted]
        compared["compared"] += sum(int(n[r["cell"]]) * r["n"] for r in counted)
        plan = F.broadcast(dealt.sparkSession.createDataFrame(loads, "cell int, parts int, turns int"))  # at most most_cells rows
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        own = lambda c, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(c)).cast("int")
        left = sent.join(plan, "cell").select("id", "v", "cell", own("turns", 1).alias("turn"), every("parts").alias("part"))
        right = dealt.join(plan, "cell").select("id", "v", "cell", own("parts", 2).alias("part"), every("turns").alias("turn"))
        keys = ["cell", "part", "turn"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda q, b: nearest(q, b, id_col, k, metric), f"query_id {kinds[0]}, `{id_col}` {kinds[1]}, score double")

    schema = f"id {kinds[0]}, v array<double>, cells array<int>"
    near = cut(top(meet(cut(asked.mapInPandas(first, schema), "routed")), id_col, k), "near")
    if len(centres) == 1:
        return near, compared
    kth = near.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    rest = cut(asked.join(kth, "id", "left").mapInPandas(later, schema).where(F.size("cells") > 0), "routed")
    return top(near.unionByName(meet(rest)), id_col, k), compared
