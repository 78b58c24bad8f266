"""Lifecycles of many states, user aggregates in bounded steps, closures that append, dimensions measured in bytes."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ashlar.operators import graph, joins, ordered, sketches, udfs


def test_lifecycle_keeps_keys_with_many_states(spark):
    rows = [("x", i, f"s{i}") for i in range(1500)] + [("y", 1, "s0"), ("y", 2, "s1"), ("y", 3, "s0"), ("z", 1, "s1")]
    out = {r.k: (r.path, r.ok) for r in ordered.lifecycle_audit(spark.createDataFrame(rows, "k string, n long, s string"), "k", "n", "s", ["s0", "s1"]).collect()}
    assert out == {"x": (["s0", "s1", "s2"], False), "y": (["s0", "s1"], True), "z": (["s1"], False)}


def test_combine_hands_on_when_it_holds_too_much(spark):
    df = spark.range(0, 3000, 1, 3).selectExpr("id % 50 as k", "cast(id as double) as x")
    run = lambda held, spread: {r.k: r.acc for r in ordered.combine_per_key(df, ["k"], lambda: [0.0, 0.0], lambda a, r: [a[0] + 1, a[1] + r[0]], lambda a, b: [a[0] + b[0], a[1] + b[1]], ["x"], held, spread).collect()}
    want = {k: [60.0, float(sum(range(k, 3000, 50)))] for k in range(50)}
    assert run(100_000, 64) == want and run(3, 1) == want


def test_batch_aggregate_with_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0), (None, 5.0), ("b", None)], "k string, x double").repartition(3)
    state = lambda pdf: pd.DataFrame({"n": pdf["x"].notna().astype(float), "most": pdf["x"].fillna(-np.inf)})
    got = {r.k: (r.n, r.most) for r in ordered.batch_aggregate(df, ["k"], state, {"n": "sum", "most": "max"}, 2).collect()}
    assert got == {"a": (2.0, 3.0), None: (2.0, 5.0), "b": (0.0, float("-inf"))}
    assert ordered.batch_aggregate(df.limit(0), ["k"], state, {"n": "sum", "most": "max"}).count() == 0


def test_closure_of_a_long_chain_with_a_cycle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(7)] + [(7, 5)], "src long, dst long")
    want = {(a, b) for a in range(8) for b in range(8) if b > a} | {(a, b) for a in (5, 6, 7) for b in (5, 6, 7)}
    got = [(r.src, r.dst) for r in graph.reachable(edges).collect()]
    assert set(got) == want and len(got) == len(want)
    added, removed = spark.createDataFrame([(9, 0)], "src long, dst long"), spark.createDataFrame([(7, 5)], "src long, dst long")
    again = {(r.src, r.dst) for r in graph.reachable_delta(graph.reachable(edges), edges, added, removed).collect()}
    assert again == {(a, b) for a in range(8) for b in range(8) if b > a} | {(9, b) for b in range(8)}


def test_dimension_measured_in_bytes(spark):
    fact, wide = spark.range(3).withColumnRenamed("id", "k"), spark.createDataFrame([(1, "x" * 5000)], "k long, t string")
    plan = lambda n: joins.join_dim(fact, wide, "k", most_bytes=n)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan(4000) and "broadcast" in plan(6000)
    assert joins.join_dim(fact, wide.limit(0), "k").count() == 3


def test_merging_states_calls_no_python_for_each_key(spark):
    df = spark.range(0, 4000, 1, 4).selectExpr("if(id % 9 = 0, null, cast(id % 2000 as string)) as k", "cast(id as double) as x")
    state = lambda pdf: pd.DataFrame({"n": pdf["x"].notna().astype(float), "least": pdf["x"]})
    whole = ordered.batch_aggregate(df, ["k"], state, {"n": "sum", "least": "min"})
    folded = ordered.combine_per_key(df, ["k"], lambda: [0.0, float("inf")], lambda a, r: [a[0] + 1, min(a[1], r[0])], lambda a, b: [a[0] + b[0], min(a[1], b[1])], ["x"], 100, 3)
    want = {r.k: (float(r.n), r.least) for r in df.groupBy("k").agg(F.count("*").alias("n"), F.min("x").alias("least")).collect()}
    assert {r.k: (r.n, r.least) for r in whole.collect()} == {r.k: tuple(r.acc) for r in folded.collect()} == want
    assert not any("FlatMapGroups" in x._jdf.queryExecution().analyzed().toString() for x in (whole, folded))


def test_heavy_hitters_among_more_values_than_counters(spark):
    df = spark.range(0, 9000, 1, 3).selectExpr("nullif(id % 2000, 7) as x").union(spark.range(40).selectExpr("id % 4 + 1500 as x"))
    want = [(r.x, r.n) for r in df.where("x is not null").groupBy("x").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "x").limit(4).collect()]
    assert [(r.item, r["count"]) for r in sketches.heavy_hitters(df, "x", 4, 64).collect()] == want
    assert sketches.heavy_hitters(df.limit(0), "x", 4, 64).count() == 0


def test_closure_of_chains_doubles_its_rounds(spark, monkeypatch):
    real, cuts = graph.cut, []
    monkeypatch.setattr(graph, "cut", lambda df, label: cuts.append(label) or real(df, label))
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(20, 15), (50, 3), (60, 61), (70, 70)], "src long, dst long")
    want = {(a, b) for a in range(21) for b in range(21) if b > a} | {(a, b) for a in range(15, 21) for b in range(15, 21)} | {(50, b) for b in range(3, 21)} | {(50, 3), (60, 61), (70, 70)}
    got = [(r.src, r.dst) for r in graph.reachable(edges).collect()]
    assert set(got) == want and len(got) == len(want) and len(cuts) <= 8
    assert graph.chains(edges, 2) is None


def test_pictures_of_one_size_are_measured_together(spark, monkeypatch):
    r = np.random.default_rng(2)
    flats = [None, [], [5, 5], *([int(x) for x in r.integers(0, 256, n)] for n in [3, 48, 48, 50, 7] * 6)]
    made, names, palette = [], list(udfs.COLOURS), np.array(list(udfs.COLOURS.values()), float)
    monkeypatch.setattr(udfs, "apply_struct", lambda df, cols, fn, schema: made.append(fn))
    udfs.image_features(None, "p")
    calls, real = [], np.stack
    monkeypatch.setattr(udfs.np, "stack", lambda x, **o: calls.append(len(x)) or real(x, **o))
    got = made[0](pd.Series(flats))
    assert list(got["colour"][:3]) == [None] * 3 and max(calls) >= 12  # at least one call for many pictures
    for flat, row in zip(flats[3:], got.iloc[3:].itertuples(index=False), strict=True):
        rgb = np.array(flat[: len(flat) // 3 * 3], float).reshape(-1, 3)
        near = [names[((p - palette) ** 2).sum(axis=1).argmin()] for p in rgb]
        want = max(names, key=lambda c: (near.count(c), -names.index(c)))
        assert row.colour == want and abs(row.brightness - (rgb.max(axis=1) / 255).mean()) < 1e-6
