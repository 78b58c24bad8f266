"""Merge, change data, quality, graph, search, sketch and stream-twin queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.functions import money, total
from ashlar.lineage import cut
from ashlar.operators import aggregates, graph, merge, quality, search, sketches
from ashlar.plans.catalog import Tables, query
from ashlar.plans.relational import FOLLOWS, LINKS, TREE, V1, V2, follows, links, tree, versions


@query(f"with a as ({V1}), b as ({V2}) select o_orderkey, case when b.o_orderkey is not null then b.o_totalprice else a.o_totalprice end as o_totalprice from a full join b using (o_orderkey)")
def m1_upsert(t: Tables) -> DataFrame:
    return merge.upsert(*versions(t), ["o_orderkey"])


@query("with a as (select o_orderkey as k, 5 as v, o_totalprice as p from orders), b as (select o_orderkey as k, o_orderkey % 10 as v, o_totalprice + 1 as p from orders) select a.k, case when b.v > a.v then b.v else a.v end as v, case when b.v > a.v then b.p else a.p end as p from a join b using (k)")
def m2_conditional_merge(t: Tables) -> DataFrame:
    a = t.orders.select(F.col("o_orderkey").alias("k"), F.lit(5).cast("long").alias("v"), F.col("o_totalprice").alias("p"))
    b = t.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 10).alias("v"), (F.col("o_totalprice") + 1).alias("p"))
    return merge.upsert(a, b, ["k"], when_newer=["v"])


@query(f"with a as ({V1}), b as ({V2}) select * from a union all select * from b where o_orderkey not in (select o_orderkey from a)")
def m3_insert_new(t: Tables) -> DataFrame:
    return merge.insert_new(*versions(t), ["o_orderkey"])


@query("select user_id, event_id, value from events where event_id <= 300 or user_id % 4 <> 0 qualify row_number() over (partition by user_id order by event_id desc) = 1")
def m4_precombine(t: Tables) -> DataFrame:
    """A stored state of the first events, and a batch with several rows a user: the highest id of each wins."""
    e = t.events.select("user_id", "event_id", "value")
    state = merge.latest(e.where("event_id <= 300"), ["user_id"], "event_id")
    return merge.upsert(state, e.where("event_id > 300 and user_id % 4 <> 0"), ["user_id"], precombine="event_id")


@query("select o_orderkey, case when o_orderstatus = 'F' then 0.0 else o_totalprice end as o_totalprice from orders where not (o_totalprice < 1000)")
def m5_delete_update(t: Tables) -> DataFrame:
    return t.orders.where("not (o_totalprice < 1000)").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(F.col("o_totalprice")).alias("o_totalprice"))


@query("select o_orderkey, case when o_orderstatus = 'P' then o_totalprice * 2 else o_totalprice end as o_totalprice, o_orderstatus from orders")
def m6_replace_slice(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    return merge.replace_slice(o, o.where("o_orderstatus = 'P'").withColumn("o_totalprice", F.col("o_totalprice") * 2), F.col("o_orderstatus") == "P")


@query(f"with a as ({V1}), b as ({V2}) select o_orderkey, case when b.o_orderkey is null then 'delete' when a.o_orderkey is null then 'insert' when a.o_totalprice = b.o_totalprice then 'same' else 'update' end as change from a full join b using (o_orderkey)")
def d6_table_diff(t: Tables) -> DataFrame:
    return merge.table_diff(*versions(t), ["o_orderkey"], ["o_totalprice"]).select("o_orderkey", "change")


@query(f"with a as ({V1}), b as ({V2}) select o_orderkey, 'delete' as _change_type, o_totalprice from a where o_orderkey not in (select o_orderkey from b) union all select o_orderkey, 'insert', o_totalprice from b where o_orderkey not in (select o_orderkey from a) union all select o_orderkey, 'update_preimage', a.o_totalprice from a join b using (o_orderkey) where a.o_totalprice <> b.o_totalprice union all select o_orderkey, 'update_postimage', b.o_totalprice from a join b using (o_orderkey) where a.o_totalprice <> b.o_totalprice")
def m8_change_feed(t: Tables) -> DataFrame:
    return merge.change_feed(*versions(t), ["o_orderkey"], ["o_totalprice"])


@query("select user_id, value from (select user_id, value, event_type, row_number() over (partition by user_id order by event_id desc) as rn from events where event_id <= 5000) where rn = 1 and event_type <> 'error'")
def m9_as_of(t: Tables) -> DataFrame:
    history = t.events.select("user_id", "value", "event_id", (F.col("event_type") == "error").alias("gone"))
    return merge.as_of(history, ["user_id"], "event_id", 5000, "gone")


@query("select user_id, value from (select user_id, value, event_type, row_number() over (partition by user_id order by event_id desc) as rn from events) where rn = 1 and event_type <> 'error'")
def m12_apply_cdc(t: Tables) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "d").when(F.col("event_type") == "signup", "c").otherwise("u")
    changes = t.events.select("user_id", "value", "event_id", op.alias("op"))
    empty = changes.select("user_id", "value").limit(0)
    state = merge.apply_cdc(empty, changes.where("event_id % 2 = 0 or event_type <> 'error'").where("event_id < 600"), "user_id", "event_id")
    return merge.apply_cdc(state, changes, "user_id", "event_id")  # rows of the state are updated, deleted and left


@query("select event_type, count(*) as n from events where event_type <> 'view' or event_id % 2 = 0 group by 1")
def m13_recompute_touched(t: Tables) -> DataFrame:
    before = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    after = t.events.where("event_type <> 'view' or event_id % 2 = 0")
    return merge.recompute_touched(before, after, t.events.where("event_type = 'view'").select("event_type"), ["event_type"], F.count("*").alias("n"))


@query("select user_id, last as value from (select user_id, arg_max(case when event_type = 'error' then -1 else event_id end, event_id) as last from events group by 1) where last >= 0")
def m14_compact(t: Tables) -> DataFrame:
    log = t.events.select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") != "error", F.col("event_id")).alias("value"))
    return merge.compact(log, "user_id", "seq", "value").select("user_id", "value")


@query("select * from (select user_id, event_id, row_number() over (partition by user_id order by event_id desc) as depth from events) where depth <= 3")
def m15_key_history(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    return t.events.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id"))).cast("long").alias("depth")).where("depth <= 3")


@query("select user_id, event_type, sum(case when event_id % 2 = 0 then 1 else -1 end) as weight from events group by 1, 2 having sum(case when event_id % 2 = 0 then 1 else -1 end) <> 0")
def m16_consolidate(t: Tables) -> DataFrame:
    return merge.consolidate(t.events.select("user_id", "event_type", F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).cast("long").alias("weight")))


@query("select event_id, value from events where (ts > timestamp '2024-01-15' or (ts = timestamp '2024-01-15' and event_id > 0)) and ts <= timestamp '2024-01-20'")
def m19_load_since(t: Tables) -> DataFrame:
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    return merge.load_since(t.events, "ts", "event_id", (at("2024-01-15"), 0), at("2024-01-20")).select("event_id", "value")


@query("select cast(o_orderkey as varchar) as id, cast(o_totalprice as double) as price, 'EUR' as currency, cast(null as varchar) as note from orders")
def m27_align_schema(t: Tables) -> DataFrame:
    return merge.align_schema(t.orders, {"id": "string", "price": "double", "currency": "string", "note": "string"}, {"o_orderkey": "id", "o_totalprice": "price"}, {"currency": "EUR"})


@query("select o_orderkey, case when o_totalprice < 1000 then 'cheap' when o_orderkey % 13 = 0 then 'unlucky' end as reason from orders where o_totalprice < 1000 or o_orderkey % 13 = 0")
def q1_validate(t: Tables) -> DataFrame:
    return quality.validate(t.orders, [("cheap", F.col("o_totalprice") < 1000), ("unlucky", F.col("o_orderkey") % 13 == 0)])[1].select("o_orderkey", "reason")


@query("select 'status' as \"check\", count(*) filter (where o_orderstatus not in ('F', 'O')) as failures, count(*) filter (where o_orderstatus not in ('F', 'O')) = 0 as passed from orders union all select 'price', count(*) filter (where not o_totalprice > 0), count(*) filter (where not o_totalprice > 0) = 0 from orders")
def q2_check_columns(t: Tables) -> DataFrame:
    return quality.check_columns(t.orders, {"status": F.col("o_orderstatus").isin("F", "O"), "price": F.col("o_totalprice") > 0})


@query("select l_orderkey, l_partkey, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def q3_check_unique(t: Tables) -> DataFrame:
    return quality.check_unique(t.lineitem, ["l_orderkey", "l_partkey"])


@query("with s as (select event_type, event_id, event_id - lag(event_id) over (partition by event_type order by event_id) as d from events) select event_type, count(*) as n, min(event_id) as first_seq, max(event_id) as last_seq, count(*) filter (where d > 1) as gaps, coalesce(sum(case when d > 1 then d - 1 end), 0) as missing from s group by 1")
def w10_sequence_audit(t: Tables) -> DataFrame:
    return quality.sequence_audit(t.events, "event_type", "event_id")


@query("select (select count(*) from events) as sent, (select count(*) from events where event_id % 10 <> 0) + (select count(*) from events where event_id % 33 = 1) as received, count(distinct event_id) as distinct_received, (select count(*) from events where event_id % 10 = 0 and event_id % 33 <> 1) as missing, (select count(*) from events where event_id % 10 <> 0) + (select count(*) from events where event_id % 33 = 1) - count(distinct event_id) as duplicates from events where event_id % 10 <> 0 or event_id % 33 = 1")
def q11_delivery_audit(t: Tables) -> DataFrame:
    e = t.events.select("event_id")
    return quality.delivery_audit(e, e.where("event_id % 10 <> 0").union(e.where("event_id % 33 = 1")), "event_id")


@query(f"with recursive e as ({FOLLOWS}), r as (select 5 as node, 0 as hops union select dst, hops + 1 from r join e on src = node where hops < 3) select node, min(hops) as hops from r where node <> 5 group by 1")
def g1_k_hop(t: Tables) -> DataFrame:
    return graph.k_hop(follows(t), 5, 3).where("node <> 5")


@query(f"with recursive e as ({FOLLOWS}), r as (select distinct src, dst from e union select r.src, e.dst from r join e on e.src = r.dst) select src, dst from r")
def g3_reachable(t: Tables) -> DataFrame:
    return graph.reachable(follows(t))


@query(f"with recursive e as ({LINKS}), r as (select cast(10 as bigint) as node, 0 as hops union select dst, hops + 1 from r join e on src = node where hops < 3) select node, min(hops) as hops from r where node <> 10 group by 1")
def g1_k_hop_links(t: Tables) -> DataFrame:
    return graph.k_hop(cut(links(t), "links"), 10, 3).where("node <> 10")


@query(f"with recursive e as ({TREE}), r as (select src, dst from e union select r.src, e.dst from r join e on e.src = r.dst) select src, dst from r")
def g3_reachable_tree(t: Tables) -> DataFrame:
    return graph.reachable(tree(t))


@query("select o_custkey as src, l_suppkey as dst, count(*) as weight from orders join lineitem on o_orderkey = l_orderkey group by 1, 2")
def g6_edges(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.count("*").alias("weight"))


@query("select id, len, term, count(*) as tf from (select doc_id as id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) as len, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents) group by all")
def x1_postings(t: Tables) -> DataFrame:
    return search.postings(t.documents, "doc_id", "text").withColumn("len", F.col("len").cast("long"))


@query("with p as (select id, len, term, count(*) as tf from (select doc_id as id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) as len, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents) where term in ('licensed', 'license') group by all), d as (select term, count(*) as df from p group by 1), s as (select count(*) as n, avg(len(regexp_extract_all(lower(text), '[a-z0-9]+'))) as a from documents) select id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) as score from p join d using (term), s group by 1 order by 2 desc, 1 limit 10")
def x2_bm25(t: Tables) -> DataFrame:
    return search.bm25_docs(t.documents, "doc_id", {"text": 1.0}, ["licensed", "license"], 10)


@query("with q as (select cast(embedding as double[]) as v from embeddings where vec_id = 0) select vec_id, round(raw, 6) as score from (select vec_id, list_dot_product(cast(embedding as double[]), v) / sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[])) * list_dot_product(v, v)) as raw from embeddings, q where label = 3 order by 2 desc, 1 limit 10)")
def e2_filtered_knn(t: Tables) -> DataFrame:
    first = t.embeddings.where("vec_id = 0").first()
    first = first["embedding"] if first else [0.0]
    return search.knn(t.embeddings, "vec_id", "embedding", first, 10, F.col("label") == 3).withColumn("score", F.round("score", 6))


KNN = "with e as (select vec_id, label, cast(embedding as double[]) as v from embeddings), s as (select q.vec_id as query_id, b.vec_id, list_dot_product(b.v, q.v) / sqrt(list_dot_product(b.v, b.v) * list_dot_product(q.v, q.v)) as raw from e q, e b where q.vec_id % 20 = 0 and {}) select query_id, vec_id, round(raw, 6) as score from s qualify row_number() over (partition by query_id order by raw desc, vec_id) <= 10"


@query(KNN.format("true"))
def e1_knn(t: Tables) -> DataFrame:
    return search.knn_many(t.embeddings, t.embeddings.where("vec_id % 20 = 0"), "vec_id", "embedding", 10).withColumn("score", F.round("score", 6))


@query(KNN.format("b.label = 3"))
def e2_filtered_knn_many(t: Tables) -> DataFrame:
    return search.knn_many(t.embeddings, t.embeddings.where("vec_id % 20 = 0"), "vec_id", "embedding", 10, F.col("label") == 3).withColumn("score", F.round("score", 6))


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, max(value) as hi from events group by 1, 2")
def t4_tumble(t: Tables) -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return t.events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("hi")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "hi")


@query("select date_trunc('day', ts) as start, user_id, min(value) as lo, max(value) as hi, cast(sum(cast(value as decimal(18,2))) as double) as total from events group by 1, 2")
def z1_downsample(t: Tables) -> DataFrame:
    return aggregates.downsample(t.events, ["user_id"], "ts", "day", F.min("value").alias("lo"), F.max("value").alias("hi"), total(money("value")).alias("total"))


@query()
def k1_hll(t: Tables) -> DataFrame:
    parts = t.lineitem.groupBy("l_returnflag").agg(F.hll_sketch_agg("l_partkey", F.lit(12)).alias("s"))
    return parts.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("parts"))


@query()
def k3_kll(t: Tables) -> DataFrame:
    s = t.events.groupBy("event_type").agg(F.expr("kll_sketch_agg_double(value, 200)").alias("s"))
    return s.select("event_type", F.expr("kll_sketch_get_quantile_double(s, 0.5D)").alias("p50"), F.expr("kll_sketch_get_quantile_double(s, 0.99D)").alias("p99"))


@query()
def k5_theta(t: Tables) -> DataFrame:
    s = t.events.agg(F.expr("theta_sketch_agg(user_id) filter (where event_type = 'view')").alias("a"), F.expr("theta_sketch_agg(user_id) filter (where event_type = 'purchase')").alias("b"))
    return s.select(*(F.expr(f"theta_sketch_estimate(theta_{op}(a, b))").alias(op) for op in ("union", "intersection", "difference")))


@query()
def k6_heavy_hitters(t: Tables) -> DataFrame:
    return sketches.heavy_hitters(t.lineitem, "l_suppkey", 10)
