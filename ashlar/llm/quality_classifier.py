"""Quality classifier: random Fourier features, ridge, isotonic calibration.

Document statistics, standardised, go through random Fourier features that
approximate a Gaussian kernel. Each partition sums its normal equations; the
sums of a matrix of fixed size are solved on the driver. Raw scores of rows
that the ridge hasn't seen are calibrated by isotonic regression over bins.

Only statistics of a text are inputs. Labelled rows beyond ``most_rows`` are
left out by a hash of their id, a documented bound of the fit alone; all
documents are scored.

Defined cases: null and empty texts have the statistics of no words; rows that
repeat an id share a label, the largest, and teach by the greatest vector of
statistics among them; null labels teach nothing; without
labels every score is 0.5; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.lineage import cut
from ashlar.llm.quality_rules import base_statistics, vector
from ashlar.llm.text import uniform

FEATURES, WIDTH, RIDGE = 256, 2.0, 1.0
FIT_TASKS = 16
BINS, BIN_LOW, BIN_HIGH = 300, -1.0, 2.0


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep and x: the statistics as an array."""
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = base_statistics(docs)
    n, size = F.greatest("n_words", F.lit(1)), F.greatest(F.length(body), F.lit(1))
    more = [F.sqrt(F.regexp_count(body, F.lit("[0-9]")) / size), F.sqrt(F.regexp_count(body, F.lit("[!?]")) / n), F.log1p(n / F.greatest("__lines", F.lit(1))), (F.octet_length(body) - F.length(body)) / size]
    return rows.select(*keep, F.array(*(x.cast("double") for x in [*vector(), *more])).alias("x"))


def fourier(x: np.ndarray, mean: np.ndarray, spread: np.ndarray, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    w, b = rng.standard_normal((x.shape[1], FEATURES - 1)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES - 1)
    z = np.clip((x - mean) / spread, -8, 8) @ w + b
    return np.hstack([np.sqrt(2.0 / (FEATURES - 1)) * np.cos(z), np.ones((len(x), 1))])


def pool(total: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Isotonic regression of good / total, weighted by total, by pooling adjacent violators."""
    blocks: list[list[float]] = []  # good, total, bins
    for g, t in zip(good, total, strict=True):
        blocks.append([g, t, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    return np.concatenate([np.full(int(k), g / t) for g, t, k in blocks])


def quality_scores(docs: DataFrame, labels: DataFrame, learns: Column, id_col: str = "doc_id", label: str = "quality", most_rows: int = 200_000, threshold: float = 0.3, seed: int = 3) -> DataFrame:
    """One row for each row of docs: id_col, score (0 to 1), predicted.

    learns: over id_col, which labelled rows teach.
    """
    stats = cut(statistics(docs.select(id_col, "text"), [id_col]), "classifier-statistics")
    truth = labels.where(F.col(label).isNotNull() & F.coalesce(learns, F.lit(False))).groupBy(id_col).agg((F.max(label) > 0).cast("double").alias("y"))
    rows = stats.join(truth, id_col).groupBy(id_col).agg(F.max("x").alias("x"), F.max("y").alias("y")).withColumn("u", uniform(F.col(id_col), F.lit(seed)))
    rows = cut(rows, "classifier-labelled")
    n = rows.count()
    if not n:
        return stats.select(id_col, F.lit(0.5).alias("score"), F.lit(int(0.5 >= threshold)).alias("predicted"))
    rows = rows.where(F.col("u") < min(1.0, most_rows / n))
    rows = rows.withColumn("fits", F.pmod(F.xxhash64(id_col, F.lit(seed + 1)), F.lit(4)) > 0)
    width = rows.select(F.size("x")).first()[0]
    sums = rows.agg(*(f(F.col("x")[i]) for i in range(width) for f in (F.avg, F.stddev_pop))).first()
    mean, spread = np.array(sums[::2], float), np.maximum(np.array(sums[1::2], float), 1e-3)

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FEATURES, FEATURES + 1))
        for pdf in batches:
            if len(pdf):
                z = fourier(np.stack(pdf["x"]), mean, spread, seed)
                total += z.T @ np.hstack([z, pdf[["y"]].to_numpy()])
        yield pd.DataFrame({"i": range(FEATURES), "row": list(total)})

    # the rows are bounded, so few tasks sum them, and few matrices meet in the shuffle
    parts = rows.where("fits").select("x", "y").repartition(FIT_TASKS).mapInPandas(equations, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    matrix = np.zeros((FEATURES, FEATURES + 1))
    matrix[cells["i"], cells["j"]] = cells["v"]
    ridge = np.linalg.solve(matrix[:, :-1] + RIDGE * np.eye(FEATURES), matrix[:, -1])

    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns="x").assign(raw=fourier(np.stack(pdf["x"]), mean, spread, seed) @ ridge if len(pdf) else np.empty(0))

    place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("raw") - BIN_LOW) * (BINS / (BIN_HIGH - BIN_LOW))))).cast("int")
    seen = rows.where(~F.col("fits")).select("x", "y").mapInPandas(raw, "y double, raw double")
    bins = seen.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("good")).toPandas().sort_values("bin")
    if len(bins):
        level = np.interp(np.arange(BINS), bins["bin"], pool(bins["n"].to_numpy(float), bins["good"].to_numpy(float)))
    else:
        level = np.linspace(BIN_LOW, BIN_HIGH, BINS).clip(0, 1)
    table = F.array(*(F.lit(float(x)) for x in level))
    scored = stats.select(F.col(id_col).cast("string").alias("id"), "x").mapInPandas(raw, "id string, raw double")
    # within a bin of equal level the raw score still orders
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.999 * F.element_at(table, place + 1) + 0.001 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("raw")))))
    return scored.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
