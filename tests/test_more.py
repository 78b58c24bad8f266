"""Polygons, hot keys in ranges, rollups, fuzzy joins, table functions, logs and keyed state: nulls, empty input, ties, restarts."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ashlar.operators import geo, ordered, rollups, search, udfs
from ashlar.sources import log
from ashlar.streaming import events as ev
from ashlar.streaming import keyed


def odd(x, y, rings):
    n = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            n += (y1 > y) != (y2 > y) and x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1))
    return n % 2 == 1


def test_points_of_one_place_are_tested_once(spark, monkeypatch):
    real, seen = geo.hex_cells, []
    monkeypatch.setattr(geo, "hex_cells", lambda df, *a: seen.append(df.count()) or real(df, *a))
    polygons = spark.createDataFrame([(1, [[(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)]])], "id long, rings array<array<struct<x double, y double>>>")
    points = spark.range(900).selectExpr("id as k", "cast(id % 3 as double) as x", "if(id % 3 = 1, -0.0D, 1.0D) as y")
    got = geo.in_polygons(points, "x", "y", polygons, "id", "rings", 1.0)
    assert Counter(r.x for r in got.collect()) == Counter(x for x, y in ((0.0, 1.0), (1.0, -0.0), (2.0, 1.0)) for _ in range(300) if odd(x, y, [[(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)]])) and seen == [3]


def test_polygons_with_holes_nulls_and_degenerate_rings(spark):
    rnd = random.Random(1)
    shapes = [(i, [[(rnd.uniform(-9, 9), rnd.uniform(-9, 9)) for _ in range(rnd.choice([3, 4, 7]))] for _ in range(rnd.choice([1, 2]))]) for i in range(25)]
    shapes += [(90, [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]]), (91, []), (92, [[(1.0, 1.0)]]), (93, [[(1.0, 1.0), (2.0, 2.0)]]), (94, None), (95, [[(None, 1.0), (2.0, 2.0), (3.0, 0.0)]])]
    polygons = spark.createDataFrame([(i, r, 0) for i, r in shapes], "id long, rings array<array<struct<x double, y double>>>, q int")
    spots = [(k, rnd.uniform(-10, 10), rnd.uniform(-10, 10)) for k in range(400)] + [(900, 2.0, 2.0), (901, 0.5, 0.5), (902, 0.0, 0.0), (903, None, 1.0), (0, 2.0, 2.0), (904, 4.0, 4.0), (905, 1.0, 2.0)]
    points = spark.createDataFrame(spots, "k long, x double, y double")
    real = [(i, r) for i, r in shapes if r and i not in (92, 95)]
    want = Counter((k, x, y, i) for k, x, y in spots if x is not None for i, r in real if odd(x, y, r))
    for size in (0.7, 30.0):
        assert Counter(map(tuple, geo.in_polygons(points, "x", "y", polygons, "id", "rings", size).collect())) == want
    cells = {(r.id, r.q, r.r) for r in geo.polyfill(polygons, "id", "rings", 0.8).collect()}
    middle = lambda q, r: (0.8 * geo.WIDTH * (q + r / 2.0), 0.8 * 1.5 * r)
    assert cells == {(i, q, r) for i, ring in real for r in range(-12, 13) for q in range(-25, 26) if odd(*middle(q, r), ring)}
    assert geo.in_polygons(points.limit(0), "x", "y", polygons, "id", "rings", 1.0).count() == geo.polyfill(polygons.limit(0), "id", "rings", 1.0).count() == 0


@pytest.mark.parametrize("ranges", [2, 8, 64])
def test_hot_keys_in_ranges(spark, ranges):
    rnd = random.Random(2)
    rows = [(i, rnd.choice("aaaab"), rnd.randint(0, 60), rnd.choice([None, 1, 2])) for i in range(300)] + [(1000 + i, "c", 7, 5) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, k string, at long, v long")
    plain = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        plain[r[1]].append(r)
    counted = {r.id: r.n for r in ordered.trailing_count(df, "k", F.col("at"), 9, ranges).collect()}
    assert counted == {r[0]: sum(r[2] - 9 <= o[2] <= r[2] for o in plain[r[1]]) for r in rows}
    before = {r.id: r.previous for r in ordered.carried_previous(df, ["k"], ["at", "id"], F.col("v"), ranges).collect()}
    assert before == {r[0]: (plain[k][i - 1][3] if i else None) for k in plain for i, r in enumerate(plain[k])}
    want = []
    for k, x in plain.items():
        start = None
        for i, r in enumerate(x):
            if i == 0 or r[2] - x[i - 1][2] >= 2:
                start = len(want)
                want.append([k, r[2], r[2], 0])
            want[start][2], want[start][3] = r[2], want[start][3] + 1
    got = ordered.sessions_in_ranges(df, "k", F.col("at"), ["id"], 2, ranges).select("k", "start", "last", "n").collect()
    assert sorted(map(list, got)) == sorted(want)
    assert ordered.trailing_count(df.limit(0), "k", F.col("at"), 9, ranges).count() == 0


def test_no_range_holds_a_hot_key(spark):
    df = spark.range(4000).select("id", F.lit("hot").alias("k"), F.col("id").alias("at"))
    sizes = [r["count"] for r in ordered.in_ranges(df, ["k", "at"], 8).groupBy("_range").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 1500


def test_limits_of_rates(spark):
    counted = spark.createDataFrame([("a", 3), ("a", 9), ("b", 1), ("c", 5)], "k string, n long")
    limits = spark.createDataFrame([("a", 8), ("b", 1)], "k string, most long")
    assert sorted(map(tuple, ordered.rate_peaks(counted, "k", limits, "most").select("k", "peak", "most", "over").collect())) == [("a", 9, 8, True), ("b", 1, 1, False), ("c", 5, None, False)]


def test_distinct_states_merge_exactly(spark):
    rnd = random.Random(3)
    rows = [(d, rnd.choice("xy"), rnd.choice([None, -5, 0, 32767, 32768, 10**12, rnd.randint(0, 99_999)])) for d in range(6) for _ in range(80)]
    state = rollups.distinct_state(spark.createDataFrame(rows, "d int, k string, u long"), ["d", "k"], "u")
    got = {r.k: r.n for r in rollups.distinct_count(state.where("d between 1 and 3"), ["k"], "n").collect()}
    assert got == {k: len({u for d, x, u in rows if x == k and 1 <= d <= 3 and u is not None}) for k in "xy"}
    assert rollups.distinct_count(state.limit(0), [], "n").first().n == 0


def test_routing_never_changes_an_answer(spark):
    rnd = random.Random(5)
    base = spark.createDataFrame([(rnd.choice("ab"), rnd.choice([1, 2]), rnd.choice([None, 1, 4])) for _ in range(60)], "k string, d int, v long")
    dims = {"k": F.col("k"), "d": F.col("d")}
    fine = rollups.Rollup("fine", base.groupBy("k", "d").agg(F.count("*").alias("n"), F.count("v").alias("c"), F.sum("v").alias("s"), F.min("v").alias("lo")), {"k", "d"}, {("count", None): "n", ("count", "v"): "c", ("sum", "v"): "s", ("min", "v"): "lo"}, 4)
    small = rollups.Rollup("small", base.groupBy("k").agg(F.count("*").alias("n")), {"k"}, {("count", None): "n"}, 2)
    m = rollups.Measure
    asks = [
        (["k"], {"n": m("count")}, None, "small"),
        (["k"], {"n": m("count"), "a": m("avg", "v"), "lo": m("min", "v"), "c": m("count", "v")}, None, "fine"),
        (["k"], {"n": m("count")}, {"d": lambda c: c == 1}, "fine"),
        ([], {"n": m("count"), "s": m("sum", "v")}, {"d": lambda c: c == 77}, "fine"),
        (["k"], {"hi": m("max", "v")}, None, "base"),
        (["k"], {"u": m("distinct", "v")}, None, "base"),
    ]
    for by, measures, filters, served in asks:
        got, name = rollups.answer(base, dims, [fine, small], by, measures, filters)
        want, _ = rollups.answer(base, dims, [], by, measures, filters)
        assert name == served
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_fuzzy_terms_of_any_length(spark):
    rnd = random.Random(6)
    words = ["", "a", "ab", "same", "x" * 40, "x" * 41, "x" * 38 + "yyy", "prefix-of-more-than-sixteen-characters", "prefix-of-more-than-sixteen-charakterz"] + ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 7))) for _ in range(60)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    dictionary = spark.createDataFrame([(w,) for w in [*words, None, "a"]], "term string")
    asked = [*words[:25], "zzzzzzzzzzzz"]
    got = search.fuzzy_many(dictionary, spark.createDataFrame([(w,) for w in asked], "term string"))
    assert sorted(map(tuple, got.collect())) == sorted({(a, b) for a in asked for b in words if distance(a, b) <= 2})


def test_runs_in_order(spark):
    rows = [(k, i, v) for k, text in (("a", "xxyxx"), ("b", "z"), ("c", "pqr")) for i, v in enumerate(text)]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "k string, i int, v string")
    assert sorted(map(tuple, udfs.runs_of(df, "k", "i", "v", 2).collect())) == [("a", "x", 2, 0), ("a", "x", 2, 3)]
    assert udfs.runs_of(df, "k", "i", "v").count() == 7
    assert udfs.runs_of(df.limit(0), "k", "i", "v").count() == 0


def test_log_offsets_commits_and_pruning(spark, tmp_path):
    log.register(spark)
    url = f"file://{tmp_path}/log"
    reader = lambda **o: spark.read.format("ashlar_log").options(path=url, **o)
    for lo in (0, 100):
        spark.range(lo, lo + 100).selectExpr("cast(id % 7 as string) as key", "cast(id as string) as value", "timestamp_seconds(id) as ts").coalesce(2).write.format("ashlar_log").options(path=url, parts=2).mode("append").save()
    rows = reader().load().collect()
    assert sorted(int(r.value) for r in rows) == list(range(200))
    ends = {p: sorted(r.offset for r in rows if r.part == p) for p in (0, 1)}
    assert all(x == list(range(len(x))) for x in ends.values())
    p = max(ends, key=lambda k: len(ends[k]))
    folder = log.Folder(url)
    (last,) = [s for s in folder.segments() if s["part"] == p][-1:]
    (tmp_path / "log/segments" / last["file"]).unlink()  # opened only where its offsets are asked for
    some = reader(starting=f'{{"{p}": 5}}', ending=f'{{"{p}": {last["first"]}, "{1 - p}": 0}}').load()
    assert sorted(r.offset for r in some.collect()) == list(range(5, last["first"]))
    before = len(folder.commits())
    folder.commit([{"part": 0, "n": 1, "file": "none"}], "s-1")
    folder.commit([{"part": 0, "n": 1, "file": "none"}], "s-1")
    assert len(folder.commits()) == before + 1
    assert spark.read.format("ashlar_log").option("path", f"file://{tmp_path}/nothing").load().count() == 0


def test_log_stream_goes_on(spark, tmp_path):
    log.register(spark)
    url, out = f"file://{tmp_path}/log", f"file://{tmp_path}/out"
    for lo in (0, 50):
        spark.range(lo, lo + 50).selectExpr("cast(id as string) as key", "cast(id as string) as value", "timestamp_seconds(id) as ts").write.format("ashlar_log").options(path=url).mode("append").save()
        rows = ev.write_stream(spark.readStream.format("ashlar_log").option("path", url).load(), out)
        assert sorted(int(r.value) for r in rows.collect()) == list(range(lo + 50))


def test_expired_sessions_leave_state(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    schema = "k long, ts timestamp, kind string"
    out = f"file://{tmp_path}/out"
    for i, rows in enumerate([[(1, at(0), "a"), (1, at(1), "b"), (2, at(1), None)], [(1, at(2), "b"), (2, at(30), "c")], [(3, at(40), "d")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
        with keyed.rocksdb(spark):
            closed = ev.write_stream(keyed.sessions(ev.read_events(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema), "k", "ts", "kind", 5 * 3600), out)
    assert sorted((r.k, r.n, r.kinds, r.top_kind) for r in closed.collect()) == [(1, 3, 2, "b"), (2, 1, 1, ""), (2, 1, 1, "c")]
    kept = spark.read.format("statestore").option("stateVarName", "session").load(f"{out}/checkpoint")
    assert [r.key.k for r in kept.select("key").collect()] == [3]


def test_a_session_takes_few_calls_to_its_state():
    """One value and one timer a key: what prolongs a session reads and writes the value alone; a timer that fires early is set anew."""
    calls, value, timers = Counter(), [None], set()

    class Value:
        get = staticmethod(lambda: (calls.update(["get"]), value[0])[1])
        update = staticmethod(lambda v: (calls.update(["update"]), value.__setitem__(0, v)))
        clear = staticmethod(lambda: (calls.update(["clear"]), value.__setitem__(0, None)))

    class Handle:
        getValueState = staticmethod(lambda name, schema, ttl=None: Value)
        registerTimer = staticmethod(lambda at: (calls.update(["timer"]), timers.add(at)))

    class Clock:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    sessions = keyed.Sessions("k", 5000)
    sessions.init(Handle)
    batch = lambda *rows: [r.asDict() for r in sessions.handleInputRows((7,), iter({"at_": a, "kind_": k} for a, k in rows), Clock(0))]
    assert batch((0, "a"), (1000, "b")) == [] and timers == {6} and calls == {"get": 1, "update": 1, "timer": 1}
    assert batch((3000, "b")) == [] and timers == {6} and calls == {"get": 2, "update": 2, "timer": 1}
    assert list(sessions.handleExpiredTimer((7,), Clock(6), Clock(6))) == [] and timers == {6, 8}
    assert batch((8000, "c")) == [{"k": 7, "start": 0, "last": 3000, "n": 3, "kinds": 2, "top_kind": "b"}]
    (out,) = sessions.handleExpiredTimer((7,), Clock(20), Clock(8))
    assert (out.start, out.last, out.n, out.top_kind) == (8000, 8000, 1, "c") and value == [None]


def test_runs_are_given_out_together():
    """A row's result is a message of its own, so runs wait for 1,000 of them or the end of the partition."""
    from pyspark.sql import Row

    runs = udfs.Runs()
    results = [runs.eval(Row(k="a", v=v), "v", 1) for v in ["x", "x", None, None, *(str(i) for i in range(2000))]]
    given = [r for r in results if r]
    last = runs.terminate()
    assert [len(r) for r in given] == [1000, 1000] and [*given[0][:2], last[-1]] == [("a", "x", 2, 0), ("a", None, 2, 2), ("a", "1999", 1, 2003)]
    assert len(given[0]) + len(given[1]) + len(last) == 2002 and udfs.Runs().terminate() == []
