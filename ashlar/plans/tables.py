"""Payloads, ordered rows, table comparison, merges into stored state, maintained tables, and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.functions import money, total
from ashlar.lineage import scratch
from ashlar.operators import incremental as inc
from ashlar.operators import joins, merge, ordered, payloads, quality
from ashlar.plans.catalog import Tables, query
from ashlar.plans.relational import V1, V2, versions


def md5_number(*cols: str) -> Column:
    """A row hash that other engines have too."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


# ---- payloads


@query("select o_orderkey, unnest([1, 2]) as part, unnest([o_orderstatus, o_orderpriority]) as word from orders")
def p10_explode_payload(t: Tables) -> DataFrame:
    one = lambda n, c: F.struct(F.lit(n).alias("part"), F.col(c).alias("word"))
    landed = t.orders.select("o_orderkey", F.to_json(F.array(one(1, "o_orderstatus"), one(2, "o_orderpriority"))).alias("payload"))
    return payloads.explode_payload(landed, "payload", "part int, word string")


@query("select event_id, (props->>'k')::bigint as k, null::bigint as absent from events")
def p15_map_get(t: Tables) -> DataFrame:
    rows = t.events.withColumn("m", F.from_json("props", "map<string,string>"))
    return rows.select("event_id", payloads.map_get("m", "k", "bigint").alias("k"), payloads.map_get("m", "none", "bigint").alias("absent"))


@query("with x as (select event_id, unnest(['value', 'user', 'k']) as name, unnest([value, user_id::double, (props->>'k')::double]) as score from events) select event_id, string_agg(name, ',' order by score desc, name) as ranked from x group by 1")
def p17_rank_pairs(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    pairs = payloads.rank_pairs(F.array(F.lit("value"), F.lit("user"), F.lit("k")), F.array(F.col("value"), F.col("user_id").cast("double"), k))
    return t.events.select("event_id", F.array_join(F.transform(pairs, lambda x: x["name"]), ",").alias("ranked"))


@query("select o_orderkey, o_orderkey * 7 as c7, o_orderkey * 150 as c150 from orders")
def p19_project(t: Tables) -> DataFrame:
    """Three of 200 columns."""
    path = scratch(t.spark, "wide")
    t.orders.select("o_orderkey", *((F.col("o_orderkey") * i).alias(f"c{i}") for i in range(1, 200))).write.parquet(path)
    return payloads.project(t.spark.read.parquet(path), ["o_orderkey", "c7", "c150"])


@query("select event_id, case when event_id % 11 = 0 then null else event_id % 5 end as schema_id, case when event_id % 11 = 0 then null else (props->>'k')::bigint end as k, case when event_id % 11 = 0 then 'unknown magic 01' end as reason from events")
def p21_unframe(t: Tables) -> DataFrame:
    magic = F.when(F.col("event_id") % 11 == 0, "01").otherwise("00")
    frame = F.expr("concat(unhex(m), unhex(lpad(hex(event_id % 5), 8, '0')), to_binary(props, 'utf-8'))")
    landed = t.events.withColumn("m", magic).select("event_id", frame.alias("frame"))
    good, bad = payloads.unframe(landed, "frame", "k long")
    return merge.union(good, bad.drop("frame")).select("event_id", "schema_id", "k", "reason")


# ---- joins


@query("select p_brand, count(*) as lines from lineitem left join part on l_partkey = p_partkey group by 1")
def j2_join_dim(t: Tables) -> DataFrame:
    dim = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return joins.join_dim(t.lineitem.select("l_partkey"), dim, "l_partkey").groupBy("p_brand").agg(F.count("*").alias("lines"))


@query("select c_custkey, o_orderkey, o_totalprice + case when o_orderkey % 10 = 0 then 1 else 0 end as price, c_acctbal + case when c_custkey % 7 = 0 then 5 else 0 end as acctbal from orders join customer on o_custkey = c_custkey where c_custkey % 13 <> 0")
def j23_maintain_join(t: Tables) -> DataFrame:
    """Three batches: orders change, customers change, customers go."""
    a = t.customer.select("c_custkey", F.col("c_acctbal").alias("acctbal"))
    b = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_totalprice").alias("price"))
    view = a.join(b, "c_custkey").select("c_custkey", "o_orderkey", "price", "acctbal")
    b2 = b.withColumn("price", F.col("price") + F.when(F.col("o_orderkey") % 10 == 0, 1).otherwise(0))
    view = joins.maintain_join(view, a, b2, b.where("o_orderkey % 10 = 0"), "c_custkey")
    a2 = a.withColumn("acctbal", F.col("acctbal") + F.when(F.col("c_custkey") % 7 == 0, 5).otherwise(0))
    view = joins.maintain_join(view, a2, b2, a.where("c_custkey % 7 = 0"), "c_custkey")
    return joins.maintain_join(view, a2.where("c_custkey % 13 <> 0"), b2, a.where("c_custkey % 13 = 0"), "c_custkey")


# ---- aggregates


@query("select o_orderstatus, count(*) as n from orders where o_orderkey % 9 <> 0 or o_orderstatus <> 'P' group by 1")
def a15_repair_rollup(t: Tables) -> DataFrame:
    rollup = t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    gone = (F.col("o_orderkey") % 9 == 0) & (F.col("o_orderstatus") == "P")
    return joins.repair_rollup(t.orders.where(~gone), rollup, t.orders.where(gone), ["o_orderstatus"], F.count("*").alias("n"))


def spread(t: Tables) -> DataFrame:
    acc = ordered.combine_per_key(t.events, ["event_type"], lambda: [0.0, 0.0, 0.0], lambda a, row: [a[0] + 1, a[1] + row[0], a[2] + row[0] * row[0]], lambda a, b: [x + y for x, y in zip(a, b, strict=True)], ["value"])
    n, s, q = (F.col("acc")[i] for i in range(3))
    return acc.select("event_type", n.cast("long").alias("n"), F.round(F.sqrt(q / n - (s / n) * (s / n)), 6).alias("spread"))


@query("select event_type, count(*) as n, round(stddev_pop(value), 6) as spread from events group by 1")
def a17_combine_per_key(t: Tables) -> DataFrame:
    return spread(t)


@query("select l_returnflag, quantile_disc(l_extendedprice, 0.5) as p50, quantile_disc(l_extendedprice, 0.99) as p99 from lineitem group by 1")
def a20_quantiles_in_ranges(t: Tables) -> DataFrame:
    return ordered.quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p99": 0.99}, ranges=8)


@query("select o_orderpriority, round(median(o_totalprice), 2) as mid from orders group by 1")
def a4_median_in_ranges(t: Tables) -> DataFrame:
    out = ordered.quantiles(t.orders, ["o_orderpriority"], "o_totalprice", {"mid": 0.5}, ranges=8, between=True)
    return out.withColumn("mid", F.round("mid", 2))


LE = "select event_type, count(*) filter (where value <= 50) as a, count(*) filter (where value <= 100) as b, count(*) filter (where value <= 250) as c, count(value) as n from events group by 1"


@query(f"select event_type, a as le50, b as le100, c as le250, n as le_inf, round(case when 0.5 * n <= a then 50 * 0.5 * n / a when 0.5 * n <= b then 50 + 50 * (0.5 * n - a) / (b - a) when 0.5 * n <= c then 100 + 150 * (0.5 * n - b) / (c - b) else 250 end, 6) as p50, round(b / n, 9) as within100 from ({LE})")
def a21_histogram_quantile(t: Tables) -> DataFrame:
    bounds = [50.0, 100.0, 250.0]
    h = ordered.histogram(t.events, ["event_type"], "value", bounds)
    counts = [F.col("counts")[i].alias(n) for i, n in enumerate(("le50", "le100", "le250", "le_inf"))]
    return h.select("event_type", *counts, F.round(ordered.histogram_quantile(F.col("counts"), bounds, 0.5), 6).alias("p50"), F.round(ordered.share_within(F.col("counts"), bounds, 100.0), 9).alias("within100"))


# ---- windows and order


@query("select event_id, cast(sum(cast(value as decimal(18,2))) over (partition by event_type order by ts, event_id rows unbounded preceding) as double) as running from events")
def w4_total_in_ranges(t: Tables) -> DataFrame:
    """Five hot keys: the running total is scanned in ranges of time."""
    out = ordered.carried_total(t.events.select("event_id", "event_type", "ts", "value"), ["event_type"], ["ts", "event_id"], money("value"), 8)
    return out.select("event_id", F.col("running").cast("double").alias("running"))


@query("select event_id, lag(value) over (partition by user_id order by ts, event_id) as previous from events")
def w5_previous(t: Tables) -> DataFrame:
    return ordered.previous(t.events, ["user_id"], ["ts", "event_id"], "value").select("event_id", "previous")


@query("select user_id, ts, event_id, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def w6_latest(t: Tables) -> DataFrame:
    return merge.latest(t.events.select("user_id", "ts", "event_id", "value"), ["user_id"], "ts", "event_id")


@query("select user_id, event_type, ts, event_id from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1")
def w7_first_seen(t: Tables) -> DataFrame:
    return merge.first_seen(t.events.select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts", "event_id")


@query("select user_id, event_id from (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by event_id) as p from events) where p = event_type")
def w9_unchanged_versions(t: Tables) -> DataFrame:
    return ordered.unchanged_versions(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id", F.md5("event_type")).select("user_id", "event_id")


@query("with f as (select user_id, event_type, min(event_id) as fst from events group by 1, 2), p as (select user_id, string_agg(event_type, '>' order by fst) as path, count(*) as n from f group by 1) select user_id, path, path = array_to_string(['signup', 'view', 'click', 'purchase', 'error'][:n], '>') as ok from p")
def w11_lifecycle_audit(t: Tables) -> DataFrame:
    out = ordered.lifecycle_audit(t.events, "user_id", "event_id", "event_type", ["signup", "view", "click", "purchase", "error"])
    return out.withColumn("path", F.array_join("path", ">"))


@query("select o_orderkey, nullif(o_orderpriority, '5-LOW') as priority, o_totalprice from orders order by 2 desc nulls last, 3 nulls last, 1 limit 50")
def w12_sort_by(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), "o_totalprice")
    return ordered.sort_by(rows, [("priority", True), ("o_totalprice", False), ("o_orderkey", False)]).limit(50)


# ---- tables compared


@query("select c_nationkey as nation, c_name as name, null as price from customer union all select s_nationkey, s_name, null from supplier union all select null, p_name, p_retailprice from part")
def d1_union(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"))
    s = t.supplier.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return merge.union(c, s, t.part.select(F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))).select("nation", "name", "price")


@query(f"with a as ({V1}), b as ({V2}) select o_orderkey, case when b.o_orderkey is null then 'missing' when a.o_orderkey is null then 'extra' else 'stale' end as drift from a full join b using (o_orderkey) where a.o_orderkey is null or b.o_orderkey is null or a.o_totalprice <> b.o_totalprice")
def d4_drift(t: Tables) -> DataFrame:
    return merge.drift(*versions(t), ["o_orderkey"], ["o_totalprice"])


@query(f"with a as (select o_orderkey % 5 as g, count(*) as n, sum(o_totalprice::decimal(18,2))::double as v from ({V1}) group by 1), b as (select o_orderkey % 5 as g, count(*) as n, sum(o_totalprice::decimal(18,2))::double as v from ({V2}) group by 1) select g, a.n as n_before, b.n as n_after, b.n - a.n as n_delta, round(a.v, 2) as v_before, round(b.v, 2) as v_after, round(b.v - a.v, 2) as v_delta from a join b using (g)")
def d5_compare_versions(t: Tables) -> DataFrame:
    a, b = (df.withColumn("g", F.col("o_orderkey") % 5) for df in versions(t))
    out = merge.compare_versions(a, b, ["g"], n=F.count("*"), v=total(money("o_totalprice")))
    return out.withColumns({c: F.round(c, 2) for c in ("v_before", "v_after", "v_delta")})


@query("select unnest(['o_orderkey', 'o_orderstatus', 'row']) as part, unnest([sum(('0x' || substr(md5(o_orderkey::varchar), 1, 8))::bigint), sum(('0x' || substr(md5(o_orderstatus), 1, 8))::bigint), sum(('0x' || substr(md5(o_orderkey::varchar || '|' || o_orderstatus), 1, 8))::bigint)])::bigint as digest from orders")
def d7_checksum(t: Tables) -> DataFrame:
    cols = ["o_orderkey", "o_orderstatus"]
    each = merge.column_checksums(t.orders, cols, md5_number).withColumnRenamed("column", "part")
    whole = merge.checksum(t.orders, cols, md5_number).select(F.lit("row").alias("part"), "digest")
    return each.unionByName(whole).withColumn("digest", F.col("digest").cast("long"))


@query("select unnest(['parquet', 'orc', 'json']) as name, true as agrees, count(*) as rows from orders")
def d8_agree(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    copies = {"parquet": o}
    for fmt in ("orc", "json"):
        path = scratch(t.spark, fmt)
        o.write.format(fmt).save(path)
        copies[fmt] = t.spark.read.schema(o.schema).format(fmt).load(path)
    return merge.agree(copies).select("name", "agrees", "rows")


# ---- merges


@query(f"with a as ({V1}), b as (select o_orderkey, o_totalprice, o_orderkey % 4 = 0 as gone from ({V2})) select o_orderkey, coalesce(b.o_totalprice, a.o_totalprice) as o_totalprice from a full join b using (o_orderkey) where not coalesce(gone, false)")
def m7_delete_on_merge(t: Tables) -> DataFrame:
    a, b = versions(t)
    return merge.upsert(a, b.withColumn("gone", F.col("o_orderkey") % 4 == 0), ["o_orderkey"], delete_flag="gone")


@query("select o_orderkey, o_totalprice + case when o_orderkey % 3 = 0 then 2 else 0 end + case when o_orderkey % 3 <> 0 and o_orderkey % 5 = 0 then 1 else 0 end as o_totalprice from orders where o_orderkey % 7 <> 0")
def m11_branch_and_merge(t: Tables) -> DataFrame:
    """The branch adds 2 to every third order and drops every seventh; main adds 1 to every fifth meanwhile."""
    base = t.orders.select("o_orderkey", "o_totalprice")
    plus = lambda df, n, x: df.withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % n == 0, x).otherwise(0))
    return merge.apply_diff(plus(base, 5, 1), base, plus(base, 3, 2).where("o_orderkey % 7 <> 0"), ["o_orderkey"])


@query("select event_type, count(*) as n from events where event_id % 3 <> 0 group by 1")
def m17_fold_changelog(t: Tables) -> DataFrame:
    """Every event is inserted; every third is taken back."""
    e = t.events.select("event_type", "event_id")
    log = e.withColumn("kind", F.lit("INSERT")).union(e.where("event_id % 3 = 0").withColumn("kind", F.lit("DELETE")))
    return merge.fold_changelog(log).groupBy("event_type").agg(F.sum("weight").alias("n"))


@query("select event_type, sum(case when event_type = 'error' then -value::decimal(18,2) else value::decimal(18,2) end)::double as total, 2 as version from events group by 1")
def m24_replay_and_swap(t: Tables) -> DataFrame:
    """Version 1 forgot that errors count against; version 2 is swapped in once it has caught up."""
    log = t.events.select("event_id", "event_type", "value")
    end = log.agg(F.max("event_id")).first()[0]
    v = money("value")
    old = log.groupBy("event_type").agg(total(v).alias("total")).withColumn("version", F.lit(1))
    rule = lambda df: df.groupBy("event_type").agg(total(F.when(F.col("event_type") == "error", -v).otherwise(v)).alias("total")).withColumn("version", F.lit(2))
    half = merge.swap_when_caught_up(old, merge.replay_version(log, "event_id", end // 2, rule), end // 2, end)
    return merge.swap_when_caught_up(half, merge.replay_version(log, "event_id", end, rule), end, end)


@query(f"select o_orderkey, md5(o_totalprice::decimal(18,2)::varchar) as derived, o_orderkey % 17 = 3 or o_orderkey % 10 = 0 as made_again from ({V2})")
def m25_sync_derived(t: Tables) -> DataFrame:
    before, after = versions(t)
    derive = lambda again: lambda df: df.select("o_orderkey", F.md5(money("o_totalprice").cast("string")).alias("derived"), F.lit(again).alias("made_again"))
    return merge.sync_derived(before, after, derive(False)(before), ["o_orderkey"], ["o_totalprice"], derive(True))


@query("select day, case when day < '2024-01-15' then n else 0 end as n, case when day < '2024-01-15' then 2 else 0 end as attempts from (select ts::date as day, count(*) as n from events group by 1)")
def m22_sharded_backfill(t: Tables) -> DataFrame:
    """A shard a day, run twice with a ledger: the rerun replaces what the first run wrote."""
    e = t.events.withColumn("day", F.to_date("ts"))
    stale = e.groupBy("day").agg(F.lit(0).cast("long").alias("n"))
    path, ledger = scratch(t.spark, "backfill"), scratch(t.spark, "ledger")
    stale.write.partitionBy("day").parquet(path)
    for _ in range(2):
        inc.run_shards(e, path, ledger, "day", F.col("day") < "2024-01-15", F.count("*").alias("n"))
    table = t.spark.read.schema("n long, day date").parquet(path)
    attempts = t.spark.read.schema("day date, run string").parquet(ledger).groupBy("day").agg(F.count("*").alias("attempts"))
    return table.join(attempts, "day", "left").select("day", "n", F.coalesce("attempts", F.lit(0)).alias("attempts"))


# ---- medallion


@query("select 'gold' as layer, o_orderstatus as name, count(*) as n, sum(o_totalprice::decimal(18,2))::double as total from orders where o_orderkey % 13 <> 0 group by 2 union all select 'quarantine', 'bad price', count(*), null from orders where o_orderkey % 13 = 0")
def v8_medallion(t: Tables) -> DataFrame:
    """Landed text with bad prices and resent rows to bronze, silver (validated, one row a key, merged in two batches) and gold."""
    landing = scratch(t.spark, "landing")
    o = t.orders.select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 13 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price"))
    for batch in (0, 1):  # the second batch sends all of the first again
        o.where((F.col("o_orderkey") % 2 == 0) | F.lit(batch == 1)).write.mode("append").option("header", "true").csv(landing)
    silver, quarantine, gold = inc.medallion(t.spark, landing, ["o_orderkey", "o_orderstatus", "price"], {"o_orderkey": "long", "o_orderstatus": "string", "price": "double"}, [("bad price", F.col("price").try_cast("double").isNull())], "o_orderkey", ["o_orderstatus"], F.count("*").alias("n"), total(money("price")).alias("total"))
    bad = quarantine.groupBy(F.col("reason").alias("name")).agg(F.count_distinct("o_orderkey").alias("n")).withColumns({"layer": F.lit("quarantine"), "total": F.lit(None).cast("double")})
    return gold.withColumnRenamed("o_orderstatus", "name").withColumn("layer", F.lit("gold")).unionByName(bad)


# ---- audits


@query("select l_orderkey, l_linenumber from lineitem where not (l_quantity > 1 and l_discount <= 0.09)")
def q9_assert_none(t: Tables) -> DataFrame:
    return quality.assert_none(t.lineitem, ~((F.col("l_quantity") > 1) & (F.col("l_discount") <= 0.09))).select("l_orderkey", "l_linenumber")


@query("select 'lines have orders' as invariant, count(*) as violations, count(*) = 0 as holds from lineitem where l_orderkey not in (select o_orderkey from orders) union all select 'orders are unique', count(*), count(*) = 0 from (select o_orderkey from orders group by 1 having count(*) > 1) union all select 'few returns', count(*), count(*) = 0 from (select l_orderkey from lineitem group by 1 having count(*) filter (l_returnflag = 'R') > 3)")
def q10_invariants(t: Tables) -> DataFrame:
    orphans = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    many = t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("n")).where("n > 3")
    return quality.invariants({"lines have orders": orphans, "orders are unique": quality.check_unique(t.orders, ["o_orderkey"]), "few returns": many})


@query("with x as (select event_id % 4 as part, event_id // 4 as off from events where event_id % 101 <> 0 union all select 1, event_id // 4 from events where event_id % 4 = 1 and event_id % 50 = 1), y as (select part, min(off) as low, max(off) as high, count(*) as n, count(distinct off) as ids from x group by 1) select *, high - low + 1 - ids as missing, n - ids as repeated, case when n > ids then 'duplicates' when high - low + 1 > ids then 'gaps' else 'continuous' end as verdict from y")
def q12_offset_verdicts(t: Tables) -> DataFrame:
    e = t.events.select((F.col("event_id") % 4).alias("part"), F.expr("event_id div 4").alias("off"), "event_id")
    rows = e.where("event_id % 101 <> 0").unionByName(e.where("part = 1 and event_id % 50 = 1"))
    return quality.offset_audit(rows, ["part"], "off")


@query("with c as (select user_id % 10 as query_id, event_id // 7 as epoch, event_id % 5 as rows from events) select query_id, epoch, count(*) as commits, (sum(rows) - max(rows))::bigint as extra_rows from c group by 1, 2 having count(*) > 1")
def q13_duplicate_commits(t: Tables) -> DataFrame:
    commits = t.events.select((F.col("user_id") % 10).alias("query_id"), F.expr("event_id div 7").alias("epoch"), (F.col("event_id") % 5).alias("rows"))
    return quality.duplicate_epochs(commits, "query_id", "epoch")


@query("with o as (select o_orderkey::varchar as id, o_totalprice::varchar as price, o_orderstatus as status from orders) select * from (select 'new' as reader, 'id' as field, 0 as missing, 0 as unreadable union all select 'new', 'price', 0, 0 union all select 'new', 'note', 0, 0 union all select 'old', 'id', 0, 0 union all select 'old', 'price', 0, 0 union all select 'old', 'status', (select count(*) from o), 0) , (select 'BACKWARD' as verdict)")
def q14_compat_audit(t: Tables) -> DataFrame:
    """The new schema drops the required status and adds an optional note."""
    old = t.orders.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").cast("string").alias("price"), F.col("o_orderstatus").alias("status"))
    new = old.select("id", "price", F.lit("n").alias("note"))
    return quality.compat_audit(old, new, {"id": ("bigint", True), "price": ("double", True), "status": ("string", True)}, {"id": ("bigint", True), "price": ("double", True), "note": ("string", False)})


# ---- hot keys in ranges: event types have a fifth of the rows each

MICROS = "epoch_us(ts)"


def micros(t: Tables) -> DataFrame:
    return t.events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


@query("select event_id, count(*) over (partition by event_type order by epoch_us(ts) range between 3600000000 preceding and current row) as n from events")
def w13_rate_in_ranges(t: Tables) -> DataFrame:
    return ordered.trailing_count(micros(t), "event_type", F.col("us"), 3_600_000_000, 8).select("event_id", "n")


@query("with n as (select event_type, count(*) over (partition by event_type order by epoch_us(ts) range between 3600000000 preceding and current row) as n from events), p as (select event_type, max(n) as peak from n group by 1), l as (select event_type, case when event_type = 'view' then 5 else 1000 end::bigint as most from events where event_type <> 'signup' group by 1) select event_type, peak, most, coalesce(peak > most, false) as over from p left join l using (event_type)")
def w13_over_limit(t: Tables) -> DataFrame:
    """Peaks of the trailing hour beside the limit of each type's plan; one type has none."""
    limits = t.events.where("event_type <> 'signup'").select("event_type").distinct().withColumn("most", F.when(F.col("event_type") == "view", 5).otherwise(1000).cast("long"))
    counted = ordered.trailing_count(micros(t), "event_type", F.col("us"), 3_600_000_000, 8)
    return ordered.rate_peaks(counted, "event_type", limits, "most")


@query("select event_id, lag(event_id) over (partition by event_type order by ts, event_id) as previous from events")
def w5_previous_in_ranges(t: Tables) -> DataFrame:
    return ordered.carried_previous(t.events, ["event_type"], ["ts", "event_id"], F.col("event_id"), 8).select("event_id", "previous")


@query("select event_id from (select event_id, user_id % 3 as d, lag(user_id % 3) over (partition by event_type order by ts, event_id) as p from events) where d = p")
def w9_unchanged_in_ranges(t: Tables) -> DataFrame:
    return ordered.unchanged_in_ranges(t.events, "event_type", ["ts", "event_id"], F.col("user_id") % 3, 8).select("event_id")


@query("select event_type, count(*) as n, count(*) filter (event_id - ps > 1) as gaps, count(*) filter (ts < pt) as disorders from (select *, lag(event_id) over w as ps, lag(ts) over w as pt from events window w as (partition by event_type order by event_id)) group by 1")
def w10_audit_in_ranges(t: Tables) -> DataFrame:
    return ordered.sequence_audit_in_ranges(t.events, "event_type", "event_id", "ts", 8)


@query("with g as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over w < 1200000000 then 0 else 1 end as f from events window w as (partition by event_type order by ts, event_id)), s as (select *, sum(f) over (partition by event_type order by ts, event_id rows unbounded preceding) as sid from g) select event_type, min(epoch_us(ts)) as start, max(epoch_us(ts)) as last, count(*) as n from s group by event_type, sid")
def y2_sessions_in_ranges(t: Tables) -> DataFrame:
    return ordered.sessions_in_ranges(micros(t), "event_type", F.col("us"), ["event_id"], 1_200_000_000, 8)
