"""What streams must keep over batches, late rows, redelivery and restarts."""

from pyspark.sql import functions as F

from ashlar.streaming import events as ev

SCHEMA = "id long, k long, ts timestamp, v long"


def land(spark, folder, name, rows):
    """One more file in the folder that a stream watches."""
    spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def at(spark, second):
    return spark.sql(f"select timestamp_seconds({1_700_000_000 + second})").first()[0]


def read(spark, folder):
    return ev.read_events(spark, f"{folder}/*", spark.createDataFrame([], SCHEMA).schema)


def test_restart_goes_on(spark, tmp_path):
    land(spark, tmp_path / "in", "a", [(1, 1, at(spark, 0), 5), (2, 2, at(spark, 1), 7)])
    out = f"file://{tmp_path}/out"
    assert ev.write_stream(read(spark, tmp_path / "in"), out).count() == 2
    land(spark, tmp_path / "in", "b", [(3, 1, at(spark, 2), 1)])
    assert sorted(r.id for r in ev.write_stream(read(spark, tmp_path / "in"), out).collect()) == [1, 2, 3]
    assert ev.write_stream(read(spark, tmp_path / "in"), out).count() == 3


def test_running_totals_over_batches(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    land(spark, tmp_path / "in", "a", [(1, 1, at(spark, 0), 5), (2, 1, at(spark, 1), 7)])
    ev.running_events(read(spark, tmp_path / "in"), "k", "id", F.col("v"), out)
    land(spark, tmp_path / "in", "b", [(3, 1, at(spark, 2), 1), (4, 2, at(spark, 3), 9)])
    rows = ev.running_events(read(spark, tmp_path / "in"), "k", "id", F.col("v"), out).collect()
    assert {r.id: r.running for r in rows} == {1: 5, 2: 12, 3: 13, 4: 9}


def test_counts_kept_as_state(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    for i, name in enumerate("ab"):
        land(spark, tmp_path / "in", name, [(i, 1, at(spark, i), 0), (i + 10, i, at(spark, i), 0)])
        counts = ev.upsert_sink(ev.count_per_key(read(spark, tmp_path / "in").select("k"), "k"), ["k"], out)
    assert {r.k: r.n for r in counts.collect()} == {0: 1, 1: 3}


def test_late_rows_are_dropped(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    windows = lambda: ev.upsert_sink(ev.tumble(read(spark, tmp_path / "in"), "ts", "10 seconds", [], F.sum("v").alias("v"), delay="20 seconds"), ["start"], out)
    land(spark, tmp_path / "in", "a", [(1, 1, at(spark, 0), 1), (2, 1, at(spark, 100), 1)])
    windows()
    land(spark, tmp_path / "in", "b", [(3, 1, at(spark, 1), 1), (4, 1, at(spark, 95), 1)])  # 99 s late: dropped; 5 s late: kept
    assert [r.v for r in windows().orderBy("start").collect()] == [1, 1, 1]


def test_malformed_json_is_dropped(spark):
    df = spark.createDataFrame([(1, '{"k": 3}'), (2, "no json"), (3, None)], "id long, raw string")
    rows = ev.enrich_events(df, "raw", "k long", F.when(F.col("k") > 2, "high").otherwise("low")).collect()
    assert [(r.id, r.k, r.tier) for r in rows] == [(1, 3, "high")]


def test_redelivered_batch_changes_nothing(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    for i, name in enumerate("ab"):
        land(spark, tmp_path / "in", name, [(i, 1, at(spark, i), 5)])
        ev.running_events(read(spark, tmp_path / "in"), "k", "id", F.col("v"), out)
    for f in ("1", ".1.crc"):  # as if the job had ended after its writes, before the batch was marked as done
        (tmp_path / "out/checkpoint/commits" / f).unlink(missing_ok=True)
    rows = ev.running_events(read(spark, tmp_path / "in"), "k", "id", F.col("v"), out).collect()
    assert {r.id: r.running for r in rows} == {0: 5, 1: 10} and len(rows) == 2
