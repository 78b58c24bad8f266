"""Incremental loads, marts, gates, routing, matching and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.functions import hundredths, money, total
from ashlar.lineage import cut
from ashlar.operators import incremental as inc
from ashlar.operators import aggregates, governance, merge, search
from ashlar.operators.joins import historical_features
from ashlar.operators.rollups import Measure, Rollup, answer, distinct_count, distinct_state
from ashlar.plans.catalog import Tables, query

PRICES = "select o_orderkey, o_orderdate, o_totalprice from orders"


def prices(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_orderdate", "o_totalprice")


@query("select event_type, coalesce(sum(value::decimal(18,2)) filter (event_id % 2 = 0), 0)::double as old, sum(value::decimal(18,2))::double as new from events group by 1 having count(*) filter (event_id % 2 = 1) > 0")
def m18_delta_aggregate(t: Tables) -> DataFrame:
    state = t.events.where("event_id % 2 = 0").groupBy("event_type").agg(F.sum(money("value")).alias("total"))
    out = inc.delta_aggregate(state, t.events.where("event_id % 2 = 1"), ["event_type"], money("value"))
    return out.select("event_type", F.col("old").cast("double"), F.col("new").cast("double"))


@query(f"select o_orderkey, o_orderdate, case when o_orderdate > (select max(o_orderdate) from orders where o_orderdate < '1996-01-01') then o_totalprice + 1 else o_totalprice end as o_totalprice from ({PRICES})")
def m20_incremental(t: Tables) -> DataFrame:
    p = prices(t)
    return inc.incremental(p.where("o_orderdate < '1996-01-01'"), p.withColumn("o_totalprice", F.col("o_totalprice") + 1), "o_orderdate", ["o_orderkey"])


@query(f"select o_orderkey, o_orderdate, case when o_orderdate >= '1996-01-01' and o_orderdate < '1997-01-01' then o_totalprice + 1 else o_totalprice end as o_totalprice from ({PRICES})")
def m21_incremental_range(t: Tables) -> DataFrame:
    inside = (F.col("o_orderdate") >= "1996-01-01") & (F.col("o_orderdate") < "1997-01-01")
    p = prices(t)
    return merge.replace_slice(p, p.where(inside).withColumn("o_totalprice", F.col("o_totalprice") + 1), inside)


@query("select date_trunc('day', ts)::date as day, case when ts::date < '2024-01-15' then count(*) else 0 end as n from events group by date_trunc('day', ts)::date, ts::date")
def m22_backfill(t: Tables) -> DataFrame:
    e = t.events.withColumn("day", F.to_date("ts"))
    stale = e.groupBy("day").agg(F.lit(0).cast("long").alias("n"))
    return inc.backfill(stale, e, "day", F.col("day") < "2024-01-15", F.count("*").alias("n"))


@query("with h as (select year(o_orderdate) as a, year(o_orderdate) + o_orderkey % 3 + 1 as b, o_totalprice::decimal(18,2) as v from orders), vs as (select a as version from h union select b from h) select version, count(v) as rows, coalesce(sum(v), 0)::double as total from vs left join h on a <= version and version < b group by 1")
def m10_version_metrics(t: Tables) -> DataFrame:
    h = t.orders.select(F.year("o_orderdate").cast("long").alias("a"), (F.year("o_orderdate") + F.col("o_orderkey") % 3 + 1).alias("b"), money("o_totalprice").alias("v"))
    return inc.version_metrics(h, "a", "b", F.col("v")).withColumn("total", F.col("total").cast("double"))


@query("select event_type, count(*) as n from events group by 1")
def m23_lambda_serving(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "event_type")
    return inc.lambda_serving(e.where("event_id <= 600"), e.where("event_id > 400").union(e.where("event_id % 3 = 0")), "event_id", 500, ["event_type"])


@query("select user_id, max(event_id) as event_id, max_by(value, event_id) as value from events group by 1")
def m29_union_read(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_id", "value")
    snapshot = merge.latest(e.where("event_id <= 500"), ["user_id"], "event_id")
    return inc.union_read(snapshot, e, ["user_id"], "event_id", 500)


@query("with f as (select date_trunc('day', ts)::date as batch, unnest(json_keys(props)) as field from events), g as (select batch, field, count(*) as n from f group by 1, 2) select *, min(batch) over (partition by field) as first_batch from g")
def m28_schema_drift(t: Tables) -> DataFrame:
    return inc.schema_drift(t.events.withColumn("day", F.to_date("ts")), "day", "props")


@query("select event_id, 'large' as route from events where value > 100 union all select event_id, 'error' from events where event_type = 'error' union all select event_id, 'rest' from events where not (value > 100) and event_type <> 'error'")
def s12_route(t: Tables) -> DataFrame:
    return inc.route(t.events, {"large": F.col("value") > 100, "error": F.col("event_type") == "error"}, "rest").select("event_id", "route")


@query("select 'lineitem.parquet' as file, count(*) as n, sum(l_extendedprice::decimal(18,2))::double as total from lineitem")
def s6_source_audit(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"), total(money("l_extendedprice")).alias("total"))


@query("select p_partkey, generate_subscripts(w, 1) - 1 as pos, unnest(w) as word from (select p_partkey, string_split(p_name, ' ') as w from part)")
def s16_child_table(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word"))


@query("select l.event_id, arg_max(v.value, (v.ts, v.event_id)) filter (v.event_type = 'view') as view_value, arg_max(v.value, (v.ts, v.event_id)) filter (v.event_type = 'click') as click_value from events l left join events v on l.user_id = v.user_id and v.ts <= l.ts where l.event_type = 'purchase' group by 1")
def j18_historical_features(t: Tables) -> DataFrame:
    """Both views beside the labels in one shuffle."""
    views = {kind: (t.events.where(F.col("event_type") == kind), "ts", ["value"], "event_id", None) for kind in ("view", "click")}
    out = historical_features(t.events.where("event_type = 'purchase'"), "user_id", "ts", views)
    return out.select("event_id", F.col("view__value").alias("view_value"), F.col("click__value").alias("click_value"))


@query("with f as (select user_id, max(ts) as newest from events where event_type = 'view' group by 1) select event_id, coalesce(newest > ts, false) as leaks from events left join f using (user_id) where event_type = 'purchase'")
def j19_leakage_report(t: Tables) -> DataFrame:
    views = t.events.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"))
    return aggregates.leakage_report(t.events.where("event_type = 'purchase'"), views, "user_id", "event_id", "ts", "view_ts")


@query("with x as (select p_brand, sum(l_extendedprice::decimal(18,2)) as r, sum(l_quantity::decimal(18,2) * p_retailprice::decimal(18,2)) as c from lineitem join part on l_partkey = p_partkey group by 1) select p_brand, r::double as revenue, c::double as cost, r::double - c::double as margin from x")
def j20_margin_by(t: Tables) -> DataFrame:
    x = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(total(money("l_extendedprice")).alias("revenue"), total(money("l_quantity") * money("p_retailprice")).alias("cost"))
    return x.withColumn("margin", F.col("revenue") - F.col("cost"))


@query("select event_type, count(*) as n from events group by 1")
def a14_rollup_routing(t: Tables) -> DataFrame:
    by_day = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    source, found = inc.choose_rollup(t.events, [(by_day, {"event_type", "day"})], {"event_type"})
    return source.groupBy("event_type").agg((F.sum("n") if found else F.count("*")).alias("n"))


def day() -> Column:
    return F.to_date("ts")


def event_rollups(t: Tables) -> list[Rollup]:
    """By type and day, by type, and the users of each type and day as bitmaps."""
    whole = t.events.withColumn("v", hundredths("value"))
    parts = [F.count("*").alias("n"), F.count("v").alias("n_v"), F.sum("v").alias("v"), F.max("value").alias("top")]
    holds = {("count", None): "n", ("count", "v"): "n_v", ("sum", "v"): "v", ("max", "value"): "top"}
    daily = cut(whole.groupBy("event_type", day().alias("day")).agg(*parts), "rollup")
    kinds = cut(daily.groupBy("event_type").agg(*(F.sum(c).alias(c) for c in ("n", "n_v", "v")), F.max("top").alias("top")), "rollup")
    users = cut(distinct_state(t.events.withColumn("day", day()), ["event_type", "day"], "user_id"), "rollup")
    return [Rollup("daily", daily, {"event_type", "day"}, holds, daily.count()), Rollup("kinds", kinds, {"event_type"}, holds, kinds.count()), Rollup("users", users, {"event_type", "day"}, {}, users.count(), "user_id")]


def routed(t: Tables, by: list[str], measures: dict[str, Measure], filters: dict | None = None) -> DataFrame:
    dims = {"event_type": F.col("event_type"), "day": day(), "user_id": F.col("user_id")}
    found, served = answer(t.events.withColumn("v", hundredths("value")), dims, event_rollups(t), by, measures, filters)
    return found.withColumn("served", F.lit(served))


@query("select event_type, count(*) as n, round(avg(value), 6) as mean, max(value) as top, 'kinds' as served from events group by 1")
def a14_route_smallest(t: Tables) -> DataFrame:
    """Two rollups cover it: the smaller one serves."""
    out = routed(t, ["event_type"], {"n": Measure("count"), "mean": Measure("avg", "v"), "top": Measure("max", "value")})
    return out.withColumn("mean", F.round(F.col("mean") / 100, 6))


@query("select ts::date as day, count(*) as n, sum((value * 100)::decimal(18,0))::bigint as v, 'daily' as served from events where event_type = 'view' and ts >= timestamp '2024-01-10' group by 1")
def a14_route_filtered(t: Tables) -> DataFrame:
    """Filters on stored keys."""
    return routed(t, ["day"], {"n": Measure("count"), "v": Measure("sum", "v")}, {"event_type": lambda c: c == "view", "day": lambda c: c >= F.lit("2024-01-10").cast("date")})


@query("select event_type, count(distinct user_id) as users, 'users' as served from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-13' group by 1")
def a14_route_distinct(t: Tables) -> DataFrame:
    """Distinct users over a range of days, from bitmaps."""
    return routed(t, ["event_type"], {"users": Measure("distinct", "user_id")}, {"day": lambda c: c.between(F.lit("2024-01-10").cast("date"), F.lit("2024-01-12").cast("date"))})


@query("select event_type, count(*) as n, 'base' as served from events where user_id < 20 group by 1")
def a14_route_base_filter(t: Tables) -> DataFrame:
    """No rollup has the filtered column."""
    return routed(t, ["event_type"], {"n": Measure("count")}, {"user_id": lambda c: c < 20})


@query("select event_type, count(*) as n, count(distinct user_id) as users, 'base' as served from events group by 1")
def a14_route_base_measure(t: Tables) -> DataFrame:
    """No rollup has both aggregates."""
    return routed(t, ["event_type"], {"n": Measure("count"), "users": Measure("distinct", "user_id")})


@query("select event_type, count(distinct user_id) as users from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20' group by 1 union all select 'all', count(distinct user_id) from events")
def a13_distinct_state(t: Tables) -> DataFrame:
    """Daily states merged over a range of days, and over all days and types."""
    state = cut(distinct_state(t.events.withColumn("day", day()), ["event_type", "day"], "user_id"), "distinct-state")
    some = state.where("day >= date '2024-01-05' and day < date '2024-01-20'")
    return distinct_count(some, ["event_type"], "users").unionByName(distinct_count(state, [], "users").withColumn("event_type", F.lit("all")))


@query("with k as (select json_keys(props) as k from events) select 'missing' as problem, 'z' as field, count(*) as n from k where not coalesce(list_contains(k, 'z'), false) union all select 'extra', f, count(*) from (select unnest(k) as f from k) where f <> 'z' group by 2")
def q4_check_shape(t: Tables) -> DataFrame:
    return inc.check_shape(t.events, "props", ["z"])


@query("with f as (select o_orderkey as id, 'price' as gate from orders where not o_totalprice > 1000 union all select o_orderkey, 'status' from orders where o_orderstatus not in ('F', 'O')) select gate, count(*) as failures, array_to_string(list_sort(list(id order by id)[:3]), ',') as sample from f group by 1")
def q7_gate_report(t: Tables) -> DataFrame:
    return inc.gate_report(t.orders, "o_orderkey", {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus").isin("F", "O")})


@query("select o_orderkey, case when bool_or(not o_totalprice > 1000) over (partition by o_orderdate::date) then 'quarantined' else 'promoted' end as _status from orders")
def q8_promote_batches(t: Tables) -> DataFrame:
    return inc.promote_batches(t.orders.withColumn("day", F.to_date("o_orderdate")), "day", {"price": F.col("o_totalprice") > 1000}).select("o_orderkey", "_status")


@query("select user_id, min(event_id) as low, max(event_id) as high, count(*) as n, count(distinct event_id) as ids from events group by 1")
def q12_offset_audit(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.min("event_id").alias("low"), F.max("event_id").alias("high"), F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("select l_orderkey, l_suppkey, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def q13_duplicate_epochs(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n")).where("n > 1")


@query("select p_partkey, p_name ~ '.*(cold|widget).*' as any_term, p_name ~ '.*cold.*' and p_name ~ '.*widget.*' as all_terms, contains(p_name, 'cold widget') as phrase, regexp_replace(p_name, '(widget)', '[\\1]', 'g') as snippet from part where contains(p_name, 'cold') or contains(p_name, 'widget')")
def x3_match_modes(t: Tables) -> DataFrame:
    modes = {n: search.match("p_name", ["cold", "widget"], m) for n, m in (("any_term", "any"), ("all_terms", "all"), ("phrase", "phrase"))}
    hits = t.part.where(modes["any_term"])
    return hits.select("p_partkey", *(c.alias(n) for n, c in modes.items()), F.regexp_replace("p_name", "(widget)", "[$1]").alias("snippet"))


@query("with d as (select distinct p_partkey, unnest(string_split(p_name, ' ')) as term from part) select p_partkey, term from d where levenshtein(term, 'wigdet') <= 2")
def x4_fuzzy_match(t: Tables) -> DataFrame:
    index = t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("term"))
    return search.fuzzy(index, "wigdet", 2, "p_partkey")


@query("with d as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as term from documents), a as (select distinct p[2] || p[1] || p[3:] as asked from (select unnest(string_split(lower(p_name), ' ')) as p from part)) select asked, term from a, d where levenshtein(asked, term) <= 2")
def x4_fuzzy_many(t: Tables) -> DataFrame:
    """Words of part names, their first two letters exchanged, against all words of all documents."""
    dictionary = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term"))
    word = t.part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("p"))
    asked = word.select(F.concat(F.substring("p", 2, 1), F.substring("p", 1, 1), F.expr("substring(p, 3)")).alias("term"))
    return search.fuzzy_many(dictionary, asked)


@query("select p_brand, count(*) as lines, sum(l_extendedprice::decimal(18,2))::double as revenue from lineitem join part on l_partkey = p_partkey where contains(p_name, 'widget') group by 1")
def x8_search_analytics(t: Tables) -> DataFrame:
    on = F.col("l_partkey") == F.col("p_partkey")
    return search.search_analytics(t.lineitem, t.part, on, search.match("p_name", ["widget"]), ["p_brand"], F.count("*").alias("lines"), total(money("l_extendedprice")).alias("revenue"))


@query("select count(distinct c_name) as raw, count(distinct md5(c_name)) as masked, count(*) filter (md5(c_name) = c_name) as leaks from customer")
def n4_mask_audit(t: Tables) -> DataFrame:
    return t.customer.select("c_name", F.md5("c_name").alias("m")).agg(F.count_distinct("c_name").alias("raw"), F.count_distinct("m").alias("masked"), F.count_if(F.col("m") == F.col("c_name")).alias("leaks"))


@query()
def k8_sketch_table(t: Tables) -> DataFrame:
    """Distinct users per event type, from sketches kept per day."""
    by_day = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.hll_sketch_agg("user_id", 12).alias("s"))
    return by_day.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("users"))


@query("""with m as (select repeat('*', 6) || right(c_name, 2) as name, null::varchar as segment from customer),
f as (select 'raw value' as probe, (select count(*) from customer where c_name = 'Customer#000000007') as raw, (select count(*) from m where name = 'Customer#000000007') as masked
union all select 'suffix', (select count(*) from customer where c_name like '%07'), (select count(*) from m where name like '%07')
union all select 'segment', (select count(*) from customer where c_mktsegment = 'BUILDING'), (select count(*) from m where segment = 'BUILDING')
union all select 'distinct c_name', (select count(distinct c_name) from customer), (select count(distinct name) from m)
union all select 'distinct c_mktsegment', (select count(distinct c_mktsegment) from customer), (select count(distinct segment) from m))
select *, case when raw = 0 then 'nothing' when masked = 0 then 'closed' when masked >= raw then 'open' else 'partly' end as verdict from f""")
def n4_mask_probes(t: Tables) -> DataFrame:
    """A mask that keeps two characters leaves the suffix open; a blank closes the segment."""
    masked = governance.mask(t.customer, governance.Policy(masks={"c_name": governance.keep_last(2, 8), "c_mktsegment": governance.blank}))
    probes = {"raw value": F.col("c_name") == "Customer#000000007", "suffix": F.col("c_name").like("%07"), "segment": F.col("c_mktsegment") == "BUILDING"}
    return governance.mask_audit(t.customer, masked, probes, ["c_name", "c_mktsegment"])
