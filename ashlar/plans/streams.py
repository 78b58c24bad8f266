"""Streaming queries: the events table read as a stream until caught up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.functions import money
from ashlar.plans.catalog import Tables, query
from ashlar.lineage import scratch
from ashlar.operators import ordered
from ashlar.streaming import buckets, keyed
from ashlar.streaming import events as ev


def stream(t: Tables) -> DataFrame:
    """events as a stream; ts as an instant, which watermarks need."""
    return ev.read_events(t.spark, f"{t.sf_dir}/event[s].parquet", t.events.schema).withColumn("ts", F.col("ts").cast("timestamp"))


def plain(df: DataFrame, *cols: str) -> DataFrame:
    """cols as time-zone-free timestamps, as the tables have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query("select event_type, count(*) as n, sum(value::decimal(18,2))::double as total from events group by 1")
def t1_running_agg(t: Tables) -> DataFrame:
    agg = stream(t).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(money("value")).cast("double").alias("total"))
    return ev.upsert_sink(agg, ["event_type"], ev.fresh_folder(t.spark, "t1"))


@query("select event_id, user_id, (sum(value::decimal(18,2)) over (partition by user_id order by event_id))::double as running from events")
def t2_running_events(t: Tables) -> DataFrame:
    rows = stream(t).select("event_id", "user_id", "value")
    out = ev.running_events(rows, "user_id", "event_id", money("value"), ev.fresh_folder(t.spark, "t2"))
    return out.select("event_id", "user_id", F.col("running").cast("double").alias("running"))


@query("select * from (select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by 1, 2) where start + interval 1 hour <= (select date_trunc('milliseconds', max(ts)) - interval 1 day from events)")
def t6_closed_windows(t: Tables) -> DataFrame:
    closed = ev.tumble(stream(t), "ts", "1 hour", ["event_type"], F.count("*").alias("n"), delay="1 day").drop("end")
    return plain(ev.write_stream(closed, ev.fresh_folder(t.spark, "t6")), "start")


@query("select distinct user_id, event_type from events")
def t9_dedup_stream(t: Tables) -> DataFrame:
    first = ev.dedup_stream(stream(t).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "400 days")
    return ev.write_stream(first.select("user_id", "event_type"), ev.fresh_folder(t.spark, "t9"))


@query("select user_id, count(*) as n from events group by 1")
def t11_count_per_key(t: Tables) -> DataFrame:
    return ev.upsert_sink(ev.count_per_key(stream(t), "user_id"), ["user_id"], ev.fresh_folder(t.spark, "t11"))


@query("select event_type, n from (select event_type, count(*) as n from events group by 1) where n > 0")
def t12_upserts_of_view(t: Tables) -> DataFrame:
    return ev.upsert_sink(stream(t).groupBy("event_type").agg(F.count("*").alias("n")), ["event_type"], ev.fresh_folder(t.spark, "t12"))


@query("select event_id, k, case when k >= 50 then 'high' else 'low' end as tier from (select event_id, (props->>'k')::bigint as k from events where props is not null)")
def t13_enrich_events(t: Tables) -> DataFrame:
    tier = F.when(F.col("k") >= 50, "high").otherwise("low")
    rows = ev.enrich_events(stream(t).select("event_id", "props"), "props", "k long", tier)
    return ev.write_stream(rows.select("event_id", "k", "tier"), ev.fresh_folder(t.spark, "t13"))


@query("select date_trunc('year', o_orderdate) as start, count(*) as n, quantile_cont(date_diff('day', o_orderdate, l_shipdate), 0.5) as p50, quantile_cont(date_diff('day', o_orderdate, l_shipdate), 0.95) as p95 from lineitem join orders on l_orderkey = o_orderkey group by 1")
def t14_latency_report(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    lag = F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    lags = rows.select(F.date_trunc("year", "o_orderdate").alias("start"), lag.alias("lag"))
    found = ordered.quantiles(lags, ["start"], "lag", {"p50": 0.5, "p95": 0.95}, between=True)
    return lags.groupBy("start").agg(F.count("*").alias("n")).join(found, "start", "left")


@query("select a.event_id as purchase, b.event_id as click from events a join events b on a.user_id = b.user_id and b.ts between a.ts - interval 1 hour and a.ts where a.event_type = 'purchase' and b.event_type = 'click'")
def j24_join_streams(t: Tables) -> DataFrame:
    a = stream(t).where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("ts").alias("a_ts"))
    b = stream(t).where("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), F.col("ts").alias("b_ts"))
    return ev.write_stream(ev.join_streams(a, b, "user_id", "a_ts", "b_ts", "1 hour").select("purchase", "click"), ev.fresh_folder(t.spark, "j24"))


def landed(t: Tables, df: DataFrame, batch: Column, batches: int) -> DataFrame:
    """df as a stream of so many files, each a micro-batch, in the order of batch; ts as an instant."""
    folder = scratch(t.spark, "stream-source")
    for i in range(batches):
        df.where(batch == i).coalesce(1).write.mode("append").parquet(folder)
    return ev.read_events(t.spark, folder, df.schema, files_per_batch=1)


SIX_DAYS = "least(greatest(floor((day(ts) - 1) / 6), 0), 4)"


@query("""with g as (select *, coalesce(ts - lag(ts) over w >= interval 6 hour, true) as fresh from events window w as (partition by user_id order by ts, event_type)),
s as (select *, sum(fresh::int) over (partition by user_id order by ts, event_type rows unbounded preceding) as sid from g),
c as (select user_id, sid, event_type, count(*) as k from s group by all),
r as (select user_id, sid, min(ts) as start, max(ts) as last, count(*) as n from s group by 1, 2),
top as (select user_id, sid, count(*) as kinds, (list(event_type order by k desc, event_type))[1] as top_kind from c group by 1, 2)
select user_id, start, last, n, kinds, top_kind from r join top using (user_id, sid) where last + interval 6 hour <= (select date_trunc('milliseconds', max(ts)) from events)""")
def t11_sessions(t: Tables) -> DataFrame:
    """Sessions by value state and timers, in five batches with a stop after each."""
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "ts", "event_type")
    folder, source = ev.fresh_folder(t.spark, "t11s"), scratch(t.spark, "stream-source")
    for i in range(5):
        rows.where(f"{SIX_DAYS} = {i}").coalesce(1).write.mode("append").parquet(source)
        with keyed.rocksdb(t.spark):
            closed = ev.write_stream(keyed.sessions(ev.read_events(t.spark, source, rows.schema), "user_id", "ts", "event_type", 6 * 3600), folder)
    return plain(closed, "start", "last")


@query("select user_id, count(*) as n from events group by 1")
def t11_count_with_ttl(t: Tables) -> DataFrame:
    """Counts in RocksDB that live for a day after a key's last row."""
    rows = landed(t, t.events.select("user_id", "event_id"), F.col("event_id") % 3, 3)
    with keyed.rocksdb(t.spark, empty_batches=False):
        return ev.upsert_sink(keyed.count_with_ttl(rows, "user_id", 86_400), ["user_id"], ev.fresh_folder(t.spark, "t11t"))


@query("select o_orderkey, o_totalprice + case when o_orderkey % 10 = 0 then 1 else 0 end as o_totalprice, c_name, case when c_custkey % 7 = 0 then 'moved' else c_mktsegment end as c_mktsegment from orders join customer on o_custkey = c_custkey where o_orderkey % 13 <> 0 and c_custkey % 11 <> 0")
def j23_join_changes(t: Tables) -> DataFrame:
    """Orders and customers as two streams of upserts and deletes in three files each, joined over their latest rows in buckets."""
    o = t.orders.select(F.col("o_custkey").alias("k"), "o_orderkey", "o_totalprice")
    later = F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice") + 1)
    changes = o.withColumn("seq", F.lit(0)).unionByName(o.where("o_orderkey % 10 = 0 or o_orderkey % 13 = 0").withColumns({"o_totalprice": later, "seq": F.lit(1)}))
    orders = landed(t, changes, F.greatest(F.col("o_orderkey") % 2, F.col("seq") * 2), 3)
    c = t.customer.select(F.col("c_custkey").alias("k"), "c_name", "c_mktsegment")
    gone, moved = F.col("k") % 11 == 0, F.when(F.col("k") % 11 != 0, F.lit("moved"))
    again = c.where("k % 7 = 0 or k % 11 = 0").withColumns({"c_name": F.when(~gone, F.col("c_name")), "c_mktsegment": moved, "seq": F.lit(1)}).withColumn("c_mktsegment", F.when(F.col("k") % 7 == 0, F.col("c_mktsegment")))
    customers = landed(t, c.withColumn("seq", F.lit(0)).unionByName(again), F.greatest(F.col("k") % 2, F.col("seq") * 2), 3)
    return buckets.join_changes(orders, customers, "k", "o_orderkey", "seq", ev.fresh_folder(t.spark, "j23"), 16).read("view")


LATE = f"{SIX_DAYS} + case when event_id % 33 = 0 and {SIX_DAYS} < 2 then 3 when event_id % 7 = 0 and {SIX_DAYS} < 4 and (day(ts) - 1) % 6 = 5 and hour(ts) >= 12 then 1 else 0 end"


@query(f"""with b as (select *, {LATE} as batch from events), m as (select batch, date_trunc('milliseconds', max(max(ts)) over (order by batch rows between unbounded preceding and 1 preceding)) - interval 1 day as mark from b group by batch),
r as (select b.*, coalesce(ts <= mark, false) as late from b join m using (batch)), e as (select date_trunc('milliseconds', max(ts)) - interval 1 day as mark from r)
select start, event_type, n, dropped from (select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from r where not late group by 1, 2), e, (select count(*) as dropped from r where late) where start + interval 1 hour <= e.mark""")
def t6_late_rows(t: Tables) -> DataFrame:
    """Closed windows, with the number of rows that came too late: some are three batches late, others half a day, which is in time."""
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "event_type")
    late = landed(t, rows, F.expr(LATE), 5)
    windows, dropped = keyed.windows_and_late(late, ev.fresh_folder(t.spark, "t6l"), "event_id", "ts", "1 hour", ["event_type"], "1 day", F.count("*").alias("n"))
    return plain(windows, "start").withColumn("dropped", F.lit(dropped).cast("long"))
