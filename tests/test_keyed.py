"""Tables by keys against a plain dictionary, and features of many views against one as-of join each."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ashlar.lineage import scratch
from ashlar.operators import joins
from ashlar.sources.keyed import KeyedTable

KIND = "user long, item long, v string, seq long, gone boolean"


def opened(df):
    return {int(m) for f in df.inputFiles() for m in re.findall(r"bucket=(\d+)", f)}


def test_keyed_table_against_a_dictionary(spark):
    r = random.Random(4)
    table = KeyedTable(spark, scratch(spark, "keyed"), ["user"], ["item"], "seq", "gone", buckets=8, spread=3)
    with pytest.raises(ValueError):
        table.read()
    want, batches = {}, []
    for b in range(3):
        rows = {}
        for _ in range(80):
            user, item = r.choice([1, 1, 1, 2, 3, None]), r.choice([None, *range(30)])
            rows[user, item] = (user, item, f"{b}-{r.random()}", r.randint(0, 5) * 10 + b, r.random() < 0.2)
        batches.append(list(rows.values()))
        for k, row in rows.items():
            if k not in want or row[3] >= want[k][3]:
                want[k] = row
        table.upsert(spark.createDataFrame(batches[-1], KIND))
        if b == 1:
            second = dict(want)
    plain = lambda rows: sorted((str(x[:2]), x[2]) for x in rows)
    held = lambda rows, who=None: plain(x for k, x in rows.items() if not x[4] and (who is None or k[0] in who))
    got = lambda df: plain((x.user, x.item, x.v) for x in df.collect())
    assert got(table.read()) == held(want)
    assert got(table.read(1)) == held(second)
    table.upsert(spark.createDataFrame(batches[2], KIND), 2)  # a batch that comes again
    assert got(table.read()) == held(want)
    asked = spark.createDataFrame([(1,), (1,), (None,), (99,)], "user int")
    assert got(table.lookup(asked)) == held(want, {1, None})
    one = table.slice((1,), F.col("item") >= 10)
    assert [x.item for x in one.collect()] == sorted(k[1] for k, x in want.items() if k[0] == 1 and not x[4] and k[1] is not None and k[1] >= 10)
    assert len(opened(one)) <= 3 < len(opened(table.read()))
    assert table.lookup(asked.limit(0)).count() == 0


def test_keyed_batch_leaves_other_buckets(spark):
    table = KeyedTable(spark, scratch(spark, "keyed"), ["user"], ["item"], "seq", buckets=16, spread=2)
    rows = spark.range(200).selectExpr("id as user", "id % 3 as item", "'a' as v", "1L as seq")
    table.upsert(rows)
    before = set(table.read().inputFiles())
    table.upsert(rows.where("user = 5").withColumn("v", F.lit("b")).withColumn("seq", F.lit(2).cast("long")))
    after = set(table.read().inputFiles())
    assert len(before - after) >= 1 and len(before & after) >= len(before) - len(before - after) > len(before) / 2
    assert {x.v for x in table.slice((5,)).collect()} == {"b"} and table.read().where("v = 'a'").count() == 199


def test_features_of_many_views(spark):
    r = random.Random(6)
    rows = lambda n, kind: spark.createDataFrame([(r.choice(["h", "h", "k", None]), r.choice([None, *range(400)]), float(i), i) for i in range(n)], f"k string, {kind} long, v double, made long").withColumn(kind, F.timestamp_seconds(kind))
    labels = rows(150, "t").select("k", "t", F.col("made").alias("id"))
    a, b = rows(120, "u"), rows(60, "w")
    views = {"a": (a, "u", ["v"], "made", 40), "b": (b, "w", ["v", "made"], "made", None)}
    usable = lambda df, at: df.where(F.col("k").isNotNull() & F.col(at).isNotNull())
    one = joins.asof_join(labels, usable(a, "u").withColumnRenamed("v", "x"), "k", "t", "u", ["x"], 40, "made")
    two = joins.asof_join(one, usable(b, "w").selectExpr("k", "w", "v as y", "made as z", "made"), "k", "t", "w", ["y", "z"], None, "made")
    want = sorted((x.id, x.x, x.y, x.z) for x in two.collect())
    for n in (None, 1, 7, 40):
        got = joins.historical_features(labels, "k", "t", views, n).collect()
        assert sorted((x.id, x.a__v, x.b__v, x.b__made) for x in got) == want
    assert any(w[1] is None and w[2] is not None for w in want) and any(w[1] is not None for w in want)
    assert joins.historical_features(labels.limit(0), "k", "t", views, 3).count() == 0
