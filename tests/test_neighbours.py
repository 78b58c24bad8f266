"""Exact nearest neighbours over cells: against plain numpy, with copies, odd vectors and clusters."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ashlar.operators import neighbours
from ashlar.operators.neighbours import knn_in_cells

KIND = "id long, v array<double>"


def frame(spark, points, start=0):
    return spark.createDataFrame([(start + i, None if p is None else [float(x) for x in p]) for i, p in enumerate(points)], KIND)


def truth(points, asked, k, metric):
    out = {}
    for q in asked:
        scored = []
        for i, p in enumerate(points):
            raw = -np.sqrt(((p - points[q]) ** 2).sum()) if metric == "l2" else (p * points[q]).sum() / np.sqrt((p**2).sum() * (points[q] ** 2).sum())
            scored.append((-raw, i))
        out[q] = [i for _, i in sorted(scored)[:k]]
    return out


def answers(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, -r.score, r.id)):
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_cells_give_the_plain_neighbours_of_clusters(spark, metric):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(12, 8)) * 10
    points = np.vstack([m + rng.normal(size=(50, 8)) * 0.5 for m in middles])
    base = frame(spark, points)
    found, compared = knn_in_cells(base, base.where("id % 20 = 0"), "id", "v", 7, block=40, metric=metric)
    assert answers(found) == truth(points, range(0, 600, 20), 7, metric)
    assert compared["all"] == 600 * 30 and compared["compared"] < 0.3 * compared["all"]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_cells_without_clusters_and_with_many_copies(spark, metric):
    rng = np.random.default_rng(2)
    points = np.vstack([rng.normal(size=(200, 6)), np.tile(rng.normal(size=6), (100, 1))])
    base = frame(spark, points)
    found, _ = knn_in_cells(base, base.where("id % 20 = 0"), "id", "v", 5, block=30, metric=metric)
    assert answers(found) == truth(points, range(0, 300, 20), 5, metric)


def test_odd_vectors_few_rows_and_empty_tables(spark):
    base = frame(spark, [[1, 0], None, [0, 0], [2, 0], [float("nan"), 1], [float("inf"), 1], [0, 3]]).unionByName(spark.createDataFrame([(9, [1.0, None])], KIND))
    found, _ = knn_in_cells(base, base, "id", "v", 10, block=2)
    assert answers(found) == {0: [0, 3, 6], 3: [0, 3, 6], 6: [6, 0, 3]}
    assert knn_in_cells(base.limit(0), base, "id", "v", 3)[0].count() == 0
    assert knn_in_cells(base, base.limit(0), "id", "v", 3, block=2)[0].count() == 0


def test_clustered_query_compares_few_pairs(spark):
    from ashlar.plans.catalog import Tables
    from ashlar.plans.retrieval import clustered

    found, compared = clustered(Tables(spark, "/root/testdata/sf0.01"))
    assert found.count() > 0 and 0 < compared["compared"] < compared["all"] / 3


def test_samples_and_pieces_are_bounded(spark):
    rows = spark.range(20_000)
    digest = F.xxhash64("id", F.lit(7))
    few = neighbours.lowest(rows, digest, 20_000, 50)
    assert [r.id for r in few.collect()] == [r.id for r in rows.orderBy(digest, "id").limit(50).collect()]
    assert "Filter" in few._jdf.queryExecution().analyzed().toString()  # what is sorted isn't the table
    assert neighbours.lowest(rows.limit(3), digest, 3, 50).count() == 3
    pieces = [len(x) for x in neighbours.slices(iter([pd.DataFrame({"id": range(1201)}), pd.DataFrame({"id": []})]))]
    assert sum(pieces) == 1201 and max(pieces) <= neighbours.POINTS
