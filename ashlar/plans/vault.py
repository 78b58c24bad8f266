"""Vault loads, feature joins, rollups and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.functions import money, total
from ashlar.lineage import spread
from ashlar.operators import aggregates, joins, merge, vault
from ashlar.plans.catalog import Tables, query

MONTH = "date_trunc('month', o_orderdate)"


def first_year(t: Tables) -> DataFrame:
    return t.orders.where("o_orderdate < '1996-01-01'")


def satellite(t: Tables) -> DataFrame:
    """A customer's status in each month with an order."""
    return t.orders.groupBy("o_custkey", F.date_trunc("month", "o_orderdate").alias("loaded")).agg(F.min("o_orderstatus").alias("status"))


@query("select o_custkey, min(o_orderdate) as o_orderdate from orders where o_custkey not in (select o_custkey from orders where o_orderdate < '1996-01-01') group by o_custkey")
def v1_load_hub(t: Tables) -> DataFrame:
    return vault.load_keys(first_year(t), t.orders, ["o_custkey"], "o_orderdate")


@query("with l as (select o_custkey, l_partkey, l_shipdate from orders join lineitem on o_orderkey = l_orderkey) select o_custkey, l_partkey, min(l_shipdate) as l_shipdate from l where not exists (select 1 from l as m where m.o_custkey = l.o_custkey and m.l_partkey = l.l_partkey and m.l_shipdate < '1996-01-01') group by all")
def v2_load_link(t: Tables) -> DataFrame:
    lines = spread(t.lineitem, "l_orderkey").join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey", "l_shipdate")
    return vault.load_keys(lines.where("l_shipdate < '1996-01-01'"), lines, ["o_custkey", "l_partkey"], "l_shipdate")


@query(f"with s as (select o_custkey, {MONTH} as loaded, min(o_orderstatus) as status from orders group by all), now as (select o_custkey, max_by(status, loaded) as was from s where loaded < '1996-01-01' group by 1) select s.o_custkey, status, loaded from s left join now using (o_custkey) where loaded >= '1996-01-01' and (now.o_custkey is null or status is distinct from was)")
def v3_load_satellite(t: Tables) -> DataFrame:
    s = satellite(t)
    return vault.load_satellite(s.where("loaded < '1996-01-01'"), s.where("loaded >= '1996-01-01'"), "o_custkey", ["status"], "loaded")


PIT = f"with s as (select o_custkey, {MONTH} as loaded, min(o_orderstatus) as status from orders group by all), d as (select date_trunc('year', o_orderdate) as as_of from orders group by all), p as (select c_custkey as o_custkey, as_of, max(loaded) as status_at from (select c_custkey, as_of from customer, d) left join s on o_custkey = c_custkey and loaded <= as_of group by all)"


def pit(t: Tables) -> DataFrame:
    dates = t.orders.select(F.date_trunc("year", "o_orderdate").alias("as_of")).distinct()
    return vault.point_in_time(t.customer.select(F.col("c_custkey").alias("o_custkey")), {"status_at": satellite(t)}, dates, "o_custkey", "as_of", "loaded")


@query(f"{PIT} select * from p")
def v4_point_in_time(t: Tables) -> DataFrame:
    return pit(t)


@query(f"{PIT} select p.*, status from p left join s on s.o_custkey = p.o_custkey and loaded = status_at")
def j21_as_of_view(t: Tables) -> DataFrame:
    return vault.as_of_view(pit(t), {"status_at": (satellite(t), ["status"])}, "o_custkey", "loaded")


@query("select o_custkey, l_suppkey, count(*) as lines from orders join lineitem on o_orderkey = l_orderkey group by all")
def v5_bridge(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return vault.bridge(lines, t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", ["o_custkey", "l_suppkey"])


@query(f"with c as (select 'orders' as name, {MONTH} as loaded, count(*) as delivered from orders group by all union all select 'lines', date_trunc('month', l_shipdate), count(*) from lineitem group by all) select *, (sum(delivered) over (partition by name))::bigint as total from c")
def v7_load_audit(t: Tables) -> DataFrame:
    return vault.load_audit({"orders": t.orders.select(F.date_trunc("month", "o_orderdate").alias("loaded")), "lines": t.lineitem.select(F.date_trunc("month", "l_shipdate").alias("loaded"))}, "loaded")


@query("select o_orderkey, c_name, case when c_custkey is null then 'unknown o_custkey ' || o_custkey end as reason from orders left join (select * from customer where c_acctbal > 0) on o_custkey = c_custkey")
def j22_enrich_or_reject(t: Tables) -> DataFrame:
    dim = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    good, bad = joins.enrich_or_reject(t.orders.select("o_orderkey", "o_custkey"), dim, "o_custkey")
    return merge.union(good, bad).select("o_orderkey", "c_name", "reason")


@query("with l as (select user_id, max_by(value, struct_pack(a := ts, b := event_id)) as value, max(ts) as ts from events group by 1), n as (select max(ts) - interval 1 day as cut from events) select user_id, case when ts >= cut then value end as value, ts >= cut as fresh from l, n")
def j25_latest_features(t: Tables) -> DataFrame:
    return aggregates.latest_features(t.events, "user_id", "ts", "event_id", "value", t.events.agg(F.max("ts") - F.expr("interval 1 day")))


@query("select date_trunc('day', ts) as day, event_type, count(*) as count, sum(value::decimal(18,2))::double as value from events group by all")
def a12_rollup_table(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("count"), total(money("value")).alias("value"))


@query("select event_type, count(*) as count, sum(value::decimal(18,2))::double as total, min(value) as low, max(value) as high from events group by 1")
def a18_stats_merge(t: Tables) -> DataFrame:
    parts = aggregates.stats_part(t.events.withColumn("day", F.date_trunc("day", "ts")), ["event_type", "day"], money("value"), F.col("value"))
    return aggregates.stats_merge(parts, ["event_type"]).withColumnRenamed("n", "count").withColumn("total", F.col("total").cast("double"))


@query("select p_brand, count(*) as n from part where lower(p_name) like '%a%' group by 1")
def a23_facets(t: Tables) -> DataFrame:
    return t.part.where(F.lower("p_name").contains("a")).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("select c_custkey, count(o_orderkey) as orders, coalesce(sum(o_totalprice::decimal(18,2)), 0)::double as value from customer left join orders on o_custkey = c_custkey group by 1")
def a24_lifetime_value(t: Tables) -> DataFrame:
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), total(money("o_totalprice")).alias("value"))
    return t.customer.select("c_custkey").join(per, "c_custkey", "left").fillna(0, ["orders", "value"])


@query("select c_nationkey, count(*) as n, sum(o_totalprice::decimal(18,2))::double as total, max(o_totalprice) as largest, count(*) filter (o_totalprice > 200000) as big, count(distinct o_orderdate::date) as days, sum(o_totalprice::decimal(18,2)) > 5000000 as alert from orders join customer on o_custkey = c_custkey group by 1")
def a26_region_report(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return aggregates.region_report(rows, "c_nationkey", "o_totalprice", 200000, 5000000, F.to_date("o_orderdate"), money("o_totalprice"))


@query("select event_type, max(ts) as newest, max(ts) >= (select max(ts) from events) - interval 1 hour as fresh from events group by 1")
def q5_check_freshness(t: Tables) -> DataFrame:
    at = t.events.agg(F.max("ts").alias("at"))
    newest = t.events.groupBy("event_type").agg(F.max("ts").alias("newest"))
    return newest.join(at).select("event_type", "newest", (F.col("newest") >= F.col("at") - F.expr("interval 1 hour")).alias("fresh"))  # at is one row


@query("with a as (select o_orderkey as k, sum(o_totalprice::decimal(18,2)) as x from orders group by 1), b as (select l_orderkey as k, sum(l_extendedprice::decimal(18,2)) as y from lineitem group by 1) select k, coalesce(x, 0)::double as a, coalesce(y, 0)::double as b from a full join b using (k) where abs(coalesce(x, 0) - coalesce(y, 0)) > 1")
def q6_check_reconciles(t: Tables) -> DataFrame:
    a = t.orders.groupBy(F.col("o_orderkey").alias("k")).agg(F.sum(money("o_totalprice")).alias("x"))
    b = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(money("l_extendedprice")).alias("y"))
    x, y = F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))
    return a.join(b, "k", "full").where(F.abs(x - y) > 1).select("k", x.cast("double").alias("a"), y.cast("double").alias("b"))
