"""Projections, joins, aggregates, windows and set operations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ashlar.functions import amount, every, first_match, hash_diff, hash_key, haversine, hundredths, money, total
from ashlar.operators import aggregates, joins, search
from ashlar.plans.catalog import Tables, query

AMOUNT = "cast(l_extendedprice as decimal(18,2))"


@query(f"select l_orderkey, l_linenumber, cast({AMOUNT} * cast(l_quantity as decimal(18,2)) as double) as amount from lineitem")
def p1_line_amount(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", (money("l_extendedprice") * money("l_quantity")).cast("double").alias("amount"))


@query("select o_orderkey, o_totalprice from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1996-01-01'")
def p2_time_range(t: Tables) -> DataFrame:
    return t.orders.where("o_orderdate >= timestamp_ntz '1995-01-01' and o_orderdate < timestamp_ntz '1996-01-01'").select("o_orderkey", "o_totalprice")


@query("select p_partkey from part where p_size >= 10 and p_size < 20 and p_retailprice > 1000")
def p3_where_all(t: Tables) -> DataFrame:
    brand = None
    return t.part.where(every(F.col("p_size") >= 10, F.col("p_size") < 20, F.col("p_retailprice") > 1000, brand)).select("p_partkey")


@query("select c_custkey, lower(trim(c_name)) as name, upper(coalesce(c_mktsegment, 'NONE')) as segment from customer")
def p4_normalize(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.lower(F.trim("c_name")).alias("name"), F.upper(F.coalesce("c_mktsegment", F.lit("NONE"))).alias("segment"))


@query("select event_id, try_cast(case when event_id % 7 = 0 then 'bad' else cast(user_id as varchar) end as bigint) as user_id from events")
def p5_safe_cast(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.expr("try_cast(case when event_id % 7 = 0 then 'bad' else cast(user_id as string) end as bigint)").alias("user_id"))


@query("select o_orderkey, case when o_totalprice >= 300000 then 'gold' when o_totalprice >= 100000 then 'silver' else 'bronze' end as tier from orders")
def p6_classify(t: Tables) -> DataFrame:
    p = F.col("o_totalprice")
    return t.orders.select("o_orderkey", first_match([("gold", p >= 300000), ("silver", p >= 100000)], "bronze").alias("tier"))


@query("select o_orderkey, cast(floor(cast(o_totalprice as decimal(18,2)) * 100 * (100 - case c_mktsegment when 'BUILDING' then 10 when 'MACHINERY' then 5 else 0 end) / 100.0) as bigint) as cents from orders join customer on o_custkey = c_custkey")
def p7_tiered_pricing(t: Tables) -> DataFrame:
    off = F.when(F.col("c_mktsegment") == "BUILDING", 10).when(F.col("c_mktsegment") == "MACHINERY", 5).otherwise(0)
    cents = F.floor((money("o_totalprice") * 100).cast("long") * (100 - off) / 100)
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", cents.cast("long").alias("cents"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def p8_json_extract(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("select c_custkey, string_split(c_name, '#')[1] as head, cast(string_split(c_name, '#')[2] as bigint) as tail from customer")
def p9_parse_delimited(t: Tables) -> DataFrame:
    parts = F.split("c_name", "#")
    return t.customer.select("c_custkey", parts[0].alias("head"), F.try_element_at(parts, F.lit(2)).cast("bigint").alias("tail"))


@query("select event_id, epoch_us(ts) // 1000 as ms, date_trunc('second', ts) as at from events")
def p11_epoch(t: Tables) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", ms.alias("ms"), F.timestamp_seconds(F.floor(ms / 1000)).cast("timestamp_ntz").alias("at"))


@query("select date_trunc('day', ts) as day, extract(hour from ts) as hour, count(*) as n from events group by all")
def p12_date_buckets(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))


@query("select count(*) as n from lineitem where l_quantity > 25 or (l_quantity = 25 and l_discount > 0.05)")
def p13_struct_compare(t: Tables) -> DataFrame:
    return t.lineitem.where(F.struct("l_quantity", "l_discount") > F.struct(F.lit(25.0), F.lit(0.05))).agg(F.count("*").alias("n"))


@query("select c_custkey, md5(upper(trim(cast(c_custkey as varchar))) || '||' || upper(trim(c_name))) as hk, md5(trim(c_mktsegment) || '||' || trim(cast(c_nationkey as varchar))) as hd from customer")
def p14_hash_keys(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", hash_key("c_custkey", "c_name").alias("hk"), hash_diff("c_mktsegment", "c_nationkey").alias("hd"))


@query("select vec_id, unnest(embedding[1:3]) as x from embeddings")
def p16_unnest(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.explode(F.slice("embedding", 1, 3)).alias("x"))


@query("select cast(d as timestamp) as day, (select count(*) from events where date_trunc('day', ts) = d) as n from generate_series((select date_trunc('day', min(ts)) from events), (select date_trunc('day', max(ts)) from events), interval 1 day) g(d)")
def p18_series(t: Tables) -> DataFrame:
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    span = t.events.agg(F.min(day).alias("a"), F.max(day).alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    counts = t.events.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    return span.join(counts, "day", "left").fillna(0, ["n"])


@query("select o_orderkey + k * 10000000 as id, o_totalprice from orders, range(3) r(k)")
def p20_expand(t: Tables) -> DataFrame:
    return t.orders.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).select((F.col("o_orderkey") + F.col("k") * 10000000).alias("id"), "o_totalprice")


@query(f"select n_name, count(*) as lines, cast(sum({AMOUNT}) as double) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name")
def j1_inner_join(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("lines"), amount(F.sum(hundredths("l_extendedprice"))).alias("revenue"))


@query("select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey group by 1")
def j3_left_count(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey and o_orderdate >= timestamp '1997-01-01' group by 1")
def j4_left_range(t: Tables) -> DataFrame:
    on = (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    return t.customer.join(t.orders, on, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("select n_name, count(s_suppkey) as n from supplier right join nation on s_nationkey = n_nationkey group by 1")
def j5_right_outer(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "right").groupBy("n_name").agg(F.count("s_suppkey").alias("n"))


V1 = "select o_orderkey, o_totalprice from orders where o_orderkey % 17 <> 3"
V2 = "select o_orderkey, case when o_orderkey % 10 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice from orders where o_orderkey % 17 <> 5"


def versions(t: Tables) -> tuple[DataFrame, DataFrame]:
    o = t.orders.select("o_orderkey", "o_totalprice")
    return o.where("o_orderkey % 17 <> 3"), o.where("o_orderkey % 17 <> 5").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))


@query(f"with a as ({V1}), b as ({V2}) select o_orderkey, a.o_totalprice as left_value, b.o_totalprice as right_value, case when b.o_orderkey is null then 'left_only' when a.o_orderkey is null then 'right_only' when a.o_totalprice <> b.o_totalprice then 'mismatch' else 'ok' end as status from a full join b using (o_orderkey)")
def j6_reconcile(t: Tables) -> DataFrame:
    return joins.reconcile(*versions(t), ["o_orderkey"], "o_totalprice")


@query("select r_name, s.o_orderstatus, coalesce(n, 0) as n from region cross join (select distinct o_orderstatus from orders) s left join (select n_regionkey, o_orderstatus, count(*) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_totalprice > 400000 group by 1, 2) f on r_regionkey = n_regionkey and s.o_orderstatus = f.o_orderstatus")
def j7_grid_fill(t: Tables) -> DataFrame:
    grid = t.region.crossJoin(t.orders.select("o_orderstatus").distinct())  # a few dimension rows
    facts = t.orders.where("o_totalprice > 400000").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    counts = facts.groupBy(F.col("n_regionkey").alias("r_regionkey"), "o_orderstatus").agg(F.count("*").alias("n"))
    return grid.join(counts, ["r_regionkey", "o_orderstatus"], "left").select("r_name", "o_orderstatus", F.coalesce("n", F.lit(0)).alias("n"))


@query("select a.n_name, b.n_name as parent from nation a join nation b on a.n_regionkey = b.n_nationkey")
def j8_self_join(t: Tables) -> DataFrame:
    return t.nation.alias("a").join(t.nation.alias("b"), F.col("a.n_regionkey") == F.col("b.n_nationkey")).select("a.n_name", F.col("b.n_name").alias("parent"))


FOLLOWS = "select c_custkey as src, c_custkey // 97 * 97 + (c_custkey * 7 + j) % 97 as dst from customer, range(3) r(j) where c_custkey <> c_custkey // 97 * 97 + (c_custkey * 7 + j) % 97"


def follows(t: Tables) -> DataFrame:
    """src, dst: every customer follows up to three of the 97 that share its block of keys, so that the closure grows with the table."""
    rows = t.customer.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return rows.select(F.col("c_custkey").alias("src"), F.expr("c_custkey div 97 * 97 + (c_custkey * 7 + j) % 97").alias("dst")).where("src <> dst")


@query(f"with e as ({FOLLOWS}) select distinct a.src as a, a.dst as b from e a join e b on a.src = b.dst and a.dst = b.src where a.src < a.dst")
def j9_mutual_pairs(t: Tables) -> DataFrame:
    e = follows(t).distinct()
    return e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"]).where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))


LINKS = "select distinct 2 * o_custkey as src, 2 * l_suppkey + 1 as dst from orders join lineitem on o_orderkey = l_orderkey union all select distinct 2 * l_suppkey + 1, 2 * o_custkey from orders join lineitem on o_orderkey = l_orderkey where l_returnflag = 'R'"


def links(t: Tables) -> DataFrame:
    """src, dst over the whole tables: customers (2 x key) to the suppliers (2 x key + 1) of their lines, and back where a line was returned."""
    lines = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select((2 * F.col("o_custkey")).alias("c"), (2 * F.col("l_suppkey") + 1).alias("s"), "l_returnflag")
    back = lines.where("l_returnflag = 'R'").select(F.col("s").alias("src"), F.col("c").alias("dst")).distinct()
    return lines.select(F.col("c").alias("src"), F.col("s").alias("dst")).distinct().union(back)


TREE = "select o_orderkey as src, o_orderkey // 2 as dst from orders where o_orderkey > 0"


def tree(t: Tables) -> DataFrame:
    """src, dst: every order and its parent, the order of half its key."""
    return t.orders.where("o_orderkey > 0").select(F.col("o_orderkey").alias("src"), F.expr("o_orderkey div 2").alias("dst"))


@query("select a.o_orderkey, a.o_totalprice, b.o_orderkey as parent, b.o_totalprice as parent_price from orders a join orders b on a.o_orderkey // 2 = b.o_orderkey where a.o_orderkey > 0")
def j8_self_join_orders(t: Tables) -> DataFrame:
    child = t.orders.where("o_orderkey > 0").select("o_orderkey", "o_totalprice", F.expr("o_orderkey div 2").alias("parent"))
    return child.join(t.orders.select(F.col("o_orderkey").alias("parent"), F.col("o_totalprice").alias("parent_price")), "parent")


@query(f"with e as ({LINKS}) select distinct a.src as a, a.dst as b from e a join e b on a.src = b.dst and a.dst = b.src where a.src < a.dst")
def j9_mutual_links(t: Tables) -> DataFrame:
    e = links(t)
    return e.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"]).where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def j10_semi(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def j11_anti(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("select c_custkey from customer where c_custkey not in (select case when o_orderkey % 2 = 0 then o_custkey else o_custkey + 1 end from orders)")
def j12_not_in(t: Tables) -> DataFrame:
    used = t.orders.select(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + 1).alias("used"))
    return joins.not_in(t.customer.select("c_custkey"), used, "c_custkey", "used")


@query("select c_custkey from customer left join orders on o_custkey = c_custkey where o_orderkey is null")
def j13_anti_outer(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").where("o_orderkey is null").select("c_custkey")


@query("select c_custkey, o_orderkey, rn from customer join (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) on c_custkey = o_custkey where rn <= 3")
def j14_lateral_top_n(t: Tables) -> DataFrame:
    children = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return joins.top_n_per(t.customer.select("c_custkey"), children, "c_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("c_custkey", "o_orderkey", F.col("rn").cast("long").alias("rn"))


STAYS = "select o_custkey as k, o_orderkey as id, datediff('day', timestamp '1970-01-01', o_orderdate) as s, datediff('day', timestamp '1970-01-01', o_orderdate) + o_orderkey % 10 as e from orders"


def stays(t: Tables) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), day.alias("s"), (day + F.col("o_orderkey") % 10).alias("e"))


@query(f"with x as ({STAYS}) select a.k, a.id, b.id as other_id, greatest(a.s, b.s) as from_, least(a.e, b.e) as to_ from x a join x b on a.k = b.k and a.id < b.id and greatest(a.s, b.s) < least(a.e, b.e)")
def j15_overlap_join(t: Tables) -> DataFrame:
    return joins.overlap_join(stays(t), stays(t), "k", "s", "e", 30).where("id < other_id").select("k", "id", "other_id", "from_", "to_")


@query(f"with x as ({STAYS}) select a.k, a.id, b.id as range_id from x a join x b on a.k = b.k and a.id <> b.id and a.s >= b.s and a.s < b.e")
def j16_contains_join(t: Tables) -> DataFrame:
    points = stays(t).select("k", "id", F.col("s").alias("at"))
    return joins.contains_join(points, stays(t).withColumnRenamed("id", "range_id"), "k", "at", "s", "e", 30).where("id <> range_id").select("k", "id", "range_id")


ASOF = "with f as (select user_id, ts, value, event_id from events where event_type = 'view'), l as (select user_id, ts, event_id from events where event_type = 'purchase') select l.event_id, arg_max(case when l.ts - f.ts <= interval 1 day then f.value end, (f.ts, f.event_id)) as value from l left join f on l.user_id = f.user_id and f.ts <= l.ts group by 1"


@query(ASOF)
def j17_asof_join(t: Tables) -> DataFrame:
    return asof(t)


@query(ASOF)
def j17_asof_in_ranges(t: Tables) -> DataFrame:
    return asof(t, 6)


def asof(t: Tables, ranges: int | None = None) -> DataFrame:
    views = t.events.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), "value", F.col("event_id").alias("created"))
    labels = t.events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return joins.asof_join(labels, views, "user_id", "ts", "view_ts", ["value"], 86400, "created", ranges).select("event_id", "value")


@query("select l_returnflag, l_linestatus, count(*) as n, cast(sum(cast(l_quantity as decimal(18,2))) as double) as qty, cast(sum(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(18,2)))) as double) as revenue from lineitem group by 1, 2")
def a1_revenue_by(t: Tables) -> DataFrame:
    revenue = F.sum(hundredths("l_extendedprice") * (100 - hundredths("l_discount")))
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), amount(F.sum(hundredths("l_quantity"))).alias("qty"), amount(revenue, 10000).alias("revenue"))


@query("select count(*) as n, count(distinct o_custkey) as customers, min(o_orderdate) as first, max(o_orderdate) as last, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from orders")
def a2_totals(t: Tables) -> DataFrame:
    return t.orders.agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), total(money("o_totalprice")).alias("total"))


@query("select l_returnflag, count(distinct l_partkey) as parts, count(distinct (l_partkey, l_suppkey)) as pairs from lineitem group by 1")
def a3_count_distinct(t: Tables) -> DataFrame:
    pairs = t.lineitem.groupBy("l_returnflag", "l_partkey", "l_suppkey").agg(F.lit(1).alias("one"))  # coarser distinct counts come from finer groups
    known = F.col("l_partkey").isNotNull()
    parts = pairs.groupBy("l_returnflag", "l_partkey").agg(F.count_if(known & F.col("l_suppkey").isNotNull()).alias("pairs"))
    return parts.groupBy("l_returnflag").agg(F.count_if(known).alias("parts"), F.sum("pairs").alias("pairs"))


@query("select o_orderpriority, min(o_totalprice) as lo, max(o_totalprice) as hi, round(median(o_totalprice), 2) as mid from orders group by 1")
def a4_stats_median(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.round(F.median("o_totalprice"), 2).alias("mid"))


@query("select n, count(*) as customers from (select o_custkey, count(*) as n from orders group by 1 having count(*) >= 5) group by 1")
def a5_having_histogram(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 5").groupBy("n").agg(F.count("*").alias("customers"))


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)")
def a6_rollup(t: Tables) -> DataFrame:
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as F, count(*) filter (where o_orderstatus = 'O') as O, count(*) filter (where o_orderstatus = 'P') as P from orders group by 1")
def a8_pivot(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)


@query("select user_id, count(*) filter (where event_type = 'click') as clicks, count(*) filter (where event_type = 'error') as errors from events group by 1")
def a9_conditional(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("select user_id, cast(sum(case when event_type = 'error' then -cast(value as decimal(18,2)) else cast(value as decimal(18,2)) end) as double) as net from events group by 1")
def a10_net(t: Tables) -> DataFrame:
    v = money("value")
    return t.events.groupBy("user_id").agg(total(F.when(F.col("event_type") == "error", -v).otherwise(v)).alias("net"))


@query("select cast(ts as date) as day, event_type, count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as total from events group by 1, 2")
def a11_daily_by(t: Tables) -> DataFrame:
    return t.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), total(money("value")).alias("total"))


@query("select event_type, count(*) as n, max(value) as hi from events group by 1")
def a13_state_merge(t: Tables) -> DataFrame:
    states = t.events.groupBy(F.to_date("ts").alias("day"), "event_type", "user_id").agg(F.count("*").alias("n"), F.max("value").alias("hi"))
    return states.groupBy("event_type").agg(F.sum("n").alias("n"), F.max("hi").alias("hi"))


@query("select o_custkey as key, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from orders group by 1")
def a16_merge_sums(t: Tables) -> DataFrame:
    part = lambda odd: t.orders.where(F.col("o_orderkey") % 2 == odd).groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n"), F.sum(money("o_totalprice")).alias("total"))
    return aggregates.merge_sums(part(0), part(1), ["key"]).withColumn("total", F.col("total").cast("double"))


@query("select b.p as also, count(distinct a.c) as buyers from (select distinct o_custkey c, l_partkey p from orders join lineitem on o_orderkey = l_orderkey) a join (select distinct o_custkey c, l_partkey p from orders join lineitem on o_orderkey = l_orderkey) b on a.c = b.c and a.p = 7 and b.p <> 7 group by 1")
def a19_also_bought(t: Tables) -> DataFrame:
    bought = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return aggregates.also_bought(bought, "o_custkey", "l_partkey", 7)


@query("select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95 from events group by 1")
def a20_percentiles(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.expr("percentile_disc(0.5) within group (order by value)").alias("p50"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"))


@query("select event_type, count(*) filter (where value <= 100) as le100, count(*) filter (where value <= 250) as le250, count(*) as le_inf from events group by 1")
def a21_histogram(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count_if(F.col("value") <= 100).alias("le100"), F.count_if(F.col("value") <= 250).alias("le250"), F.count("*").alias("le_inf"))


@query("select date_trunc('hour', ts) as hour, cast(count(*) filter (where value <= 400) as double) / count(*) as attained, (1 - cast(count(*) filter (where value <= 400) as double) / count(*)) / 0.1 as burn from events group by 1")
def a22_slo(t: Tables) -> DataFrame:
    return aggregates.slo(t.events, F.date_trunc("hour", "ts").cast("timestamp_ntz"), F.col("value") <= 400, 0.9).withColumnRenamed("bucket", "hour")


@query("select k as account, cast(sum(v) as double) as balance from (select user_id as k, cast(value as decimal(18,2)) as v from events union all select (user_id + 1) % 150 as k, -cast(value as decimal(18,2)) as v from events) group by 1")
def a25_balances(t: Tables) -> DataFrame:
    transfers = t.events.withColumn("other", (F.col("user_id") + 1) % 150)
    return aggregates.balances(transfers, "event_id", "other", "user_id", money("value")).withColumn("balance", F.col("balance").cast("double"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def w1_top_k(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("select * from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) where rn <= 2")
def w2_top_k_per(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rn")).where("rn <= 2")


@query("select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as rank from orders order by o_totalprice desc, o_orderkey limit 20")
def w3_ranked_top(t: Tables) -> DataFrame:
    return search.ranked(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 20).select("o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("select event_id, cast(sum(cast(value as decimal(18,2))) over (partition by user_id order by ts, event_id rows unbounded preceding) as double) as running, lag(event_id) over (partition by user_id order by ts, event_id) as prev from events")
def w4_running_total(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", amount(F.sum(hundredths("value")).over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("running"), F.lag("event_id").over(w).alias("prev"))


@query("select user_id, max(ts) as ts, arg_max(value, (ts, event_id)) as value, arg_min(event_id, (ts, event_id)) as first_event from events group by 1")
def w8_last_value(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"))


@query("select event_id, count(*) over (partition by user_id order by epoch_us(ts) // 1000000 range between 3600 preceding and current row) as n from events")
def w13_trailing_rate(t: Tables) -> DataFrame:
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", aggregates.trailing_rate(t.events, "user_id", at, 3600).alias("n"))


@query("select c_nationkey as k from customer union select s_nationkey from supplier")
def d2_union_distinct(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("(select c_nationkey as k, 'both' as side from customer intersect select s_nationkey, 'both' from supplier) union all (select c_nationkey, 'a_only' from customer except select s_nationkey, 'a_only' from supplier)")
def d3_set_ops(t: Tables) -> DataFrame:
    a, b = t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).withColumn("side", F.lit("both")).union(a.subtract(b).withColumn("side", F.lit("a_only")))


@query("select l_returnflag, l_linestatus, count(*) as n, grouping(l_returnflag) * 2 + grouping(l_linestatus) as gid from lineitem group by cube (l_returnflag, l_linestatus)")
def y1_cube(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))


@query("with g as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hour then 0 else 1 end as s from events), x as (select user_id, ts, sum(s) over (partition by user_id order by ts, event_id) as sid from g) select user_id, min(ts) as start, count(*) as n from x group by user_id, sid")
def y2_sessions(t: Tables) -> DataFrame:
    rows = t.events.withColumn("at", F.col("ts").cast("timestamp"))
    return rows.groupBy("user_id", F.session_window("at", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("select c_custkey, round(2 * 6371.0 * asin(sqrt(pow(sin(radians(10 - (c_custkey % 90)) / 2), 2) + cos(radians(c_custkey % 90)) * cos(radians(10)) * pow(sin(radians(20 - (c_custkey % 180)) / 2), 2))), 3) as km from customer")
def h6_haversine(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", F.round(haversine(k % 90, k % 180, F.lit(10), F.lit(20)), 3).alias("km"))


@query("select floor((c_custkey % 900) / 10.0 / 5) as gy, floor((c_custkey * 7 % 1800) / 10.0 / 5) as gx, count(*) as n from customer group by 1, 2")
def h1_grid_stats(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.groupBy(F.floor((k % 900) / 10.0 / 5).cast("double").alias("gy"), F.floor((k * 7 % 1800) / 10.0 / 5).cast("double").alias("gx")).agg(F.count("*").alias("n"))


@query("select c_custkey, left(c_name, 1) || '***' as name, lpad(right(cast(c_custkey as varchar), 2), 6, '*') as masked, sha256(lower(trim(c_name))) as pseudo from customer where c_nationkey = 3")
def n1_secure_view(t: Tables) -> DataFrame:
    return t.customer.where("c_nationkey = 3").select("c_custkey", F.concat(F.substring("c_name", 1, 1), F.lit("***")).alias("name"), F.lpad(F.substring(F.col("c_custkey").cast("string"), -2, 2), 6, "*").alias("masked"), F.sha2(F.lower(F.trim("c_name")), 256).alias("pseudo"))
