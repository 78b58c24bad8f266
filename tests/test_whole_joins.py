"""Joins that lose no pair and broadcast nothing whose size isn't known."""

import duckdb
import numpy as np
import pytest

from ashlar.operators import geo, vectors
from ashlar.plans import retrieval  # noqa: F401
from ashlar.plans.catalog import ORACLE_SQL, QUERIES


def lsh_pairs(got):
    out = [(r.a, r.b) for r in got.collect()]
    assert len(set(out)) == len(out) and all(a < b for a, b in out)
    return set(out)


@pytest.mark.parametrize(("block", "least"), [(16_000, 0.35), (60, 0.35), (60, -0.2)])
def test_lsh_join_leaves_no_pair_out(spark, block, least):
    v = np.random.default_rng(4).standard_normal((400, 16))
    v[7] = v[300] = v[9]
    v[20] = 3 * v[21]  # parallel, but not the same vector
    v[30:33] *= np.array([[1e-200], [1e200], [1e-300]])
    u = v / np.abs(v).max(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in y]) for i, y in enumerate(v)] + [(900, [0.0] * 16), (901, None), (902, [float("nan")] * 16), (903, [None] * 16)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    sims, own = u @ u.T, [i for i in range(400) if i not in (9, 300)]
    want = {(i, j) for i in own for j in own if i < j and sims[i, j] >= least}
    assert (20, 21) in want
    assert lsh_pairs(vectors.lsh_join(df, "id", "v", least, tables=2, bits=6, block=block)) == want
    assert {tuple(r) for r in vectors.copies(df, "id", "v").collect()} == {(7, 9), (7, 300)}


def test_lsh_join_leaves_out_cells_that_are_far_apart(spark, monkeypatch):
    rng = np.random.default_rng(5)
    middles = rng.standard_normal((8, 24))
    v = np.repeat(middles, 50, axis=0) + 0.05 * rng.standard_normal((400, 24))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in y]) for i, y in enumerate(v)], "id long, v array<double>")
    real, plans = vectors._cell_pairs, []
    monkeypatch.setattr(vectors, "_cell_pairs", lambda *a: plans.append(real(*a)) or plans[0])
    got = lsh_pairs(vectors.lsh_join(df, "id", "v", 0.97, tables=2, bits=12, block=50))
    assert got == {(i, j) for i in range(400) for j in range(i + 1, 400) if u[i] @ u[j] >= 0.97} and got
    cells = plans[0].select("cell").distinct().count()
    assert 1 < cells and plans[0].count() < cells * cells / 2


def test_lsh_query_has_copies(spark, tmp_path):
    rows = [(5, [1.0, 2.0]), (3, [1.0, 2.0]), (8, [1.0, 2.0]), (4, [2.0, 1.0]), (6, [-1.0, 0.0]), (7, [-1.0, -0.0]), (9, [0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {tuple(r) for r in QUERIES["e4_lsh_join"](spark, str(tmp_path)).collect()}
    assert got == {(3, 4, 0.8, False), (3, 5, 1.0, True), (3, 8, 1.0, True), (6, 7, 1.0, True)}
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert set(con.execute(ORACLE_SQL["e4_lsh_join"]).fetchall()) == got


RINGS = "array<array<struct<x double, y double>>>"


def square(x, y, side):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]


def test_polygons_are_not_broadcast(spark, monkeypatch):
    real, made = geo.cut, []
    monkeypatch.setattr(geo, "FEW_PLACES", 0, raising=False)
    monkeypatch.setattr(geo, "cut", lambda df, label: made.append(df) or real(df, label))
    polygons = spark.createDataFrame([(i, [square(float(i % 3), 0.0, 2.0)]) for i in range(30)], f"id long, rings {RINGS}")
    points = spark.range(900).selectExpr("id as k", "id % 5 + 0.5D as x", "0.5D as y")
    made.append(geo.in_polygons(points, "x", "y", polygons, "id", "rings", 0.5))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in made]
    assert sum(p.count("BroadcastExchange") for p in plans) == 1  # the places of many points, 1,000 at most
    assert made[-1].count() == 180 * 10 * (1 + 2 + 2 + 1)


@pytest.mark.parametrize("few", [0, 50_000])
def test_shapes_are_tested_once_and_places_of_many_points_are_dealt(spark, monkeypatch, few):
    monkeypatch.setattr(geo, "FEW_PLACES", few, raising=False)
    monkeypatch.setattr(geo, "LIST", 4, raising=False)
    monkeypatch.setattr(geo, "TURN", 7, raising=False)
    real, seen = geo.cover, []
    monkeypatch.setattr(geo, "cover", lambda df, *a: seen.append(df.count()) or real(df, *a))
    hole = [square(0.0, 0.0, 4.0), square(1.0, 1.0, 2.0)]
    shapes = [(i, [square(float(i % 3), 0.0, 2.0)]) for i in range(30)] + [(40, hole), (41, hole[::-1]), (42, hole[:1]), (42, hole[1:]), (None, hole), (43, None)]
    polygons = spark.createDataFrame(shapes, f"id long, rings {RINGS}")
    spots = [(k, k % 4 + 0.5, 0.5) for k in range(100)] + [(200, 2.0, 2.0), (200, 1.5, 1.5), (201, 0.5, 3.5), (201, 0.5, 3.5)]
    points = spark.createDataFrame([(k, {"k": k}, x, y) for k, x, y in spots], "k long, m map<string,long>, x double, y double")
    inside = lambda x, y, i: i % 3 <= x < i % 3 + 2 and y < 2 if i < 30 else not (1 <= x < 3 and 1 <= y < 3)
    want = sorted((k, x, y, i) for k, x, y in spots for i in (*range(30), 40, 41, 42) if inside(x, y, i))
    got = geo.in_polygons(points, "x", "y", polygons, "id", "rings", 0.7)
    assert sorted((r.k, r.x, r.y, r.id) for r in got.collect()) == want
    assert seen == [5]  # three squares, one with a hole, one without rings
