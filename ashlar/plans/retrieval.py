"""Sketches, time series, graphs, vectors, text search, roles, user functions, and streams of many batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.functions import money, total
from ashlar.lineage import cut, scratch
from ashlar.operators import governance as gov
from ashlar.operators import graph, merge, neighbours, ordered, search, series, sketches, udfs, vectors
from ashlar.plans.catalog import Tables, query
from ashlar.plans.relational import LINKS, TREE, links, tree
from ashlar.plans.streams import plain
from ashlar.streaming import buckets
from ashlar.streaming import events as ev

# ---- sketches: SQL has the exact figures, and the sketch must be within its bound of them


@query("select l_returnflag, true as within from lineitem group by 1")
def k1_hll_within(t: Tables) -> DataFrame:
    out = t.lineitem.groupBy("l_returnflag").agg(F.hll_sketch_estimate(sketches.hll("l_partkey", 12)).alias("e"), F.count_distinct("l_partkey").alias("n"))
    return out.select("l_returnflag", (F.abs(F.col("e") - F.col("n")) <= 0.05 * F.col("n")).alias("within"))


@query("select l_returnflag, count(distinct l_partkey) as parts, true as within from lineitem group by 1")
def k2_hll_merge(t: Tables) -> DataFrame:
    parts = t.lineitem.groupBy("l_returnflag", F.year("l_shipdate").alias("y")).agg(sketches.hll("l_partkey", 12).alias("sketch"))
    exact = t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"))
    both = sketches.hll_merge(parts, ["l_returnflag"]).join(exact, "l_returnflag")
    return both.select("l_returnflag", "parts", (F.abs(F.col("estimate") - F.col("parts")) <= 0.05 * F.col("parts")).alias("within"))


QS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@query("select event_type, true as p50, true as p95, true as p99 from events group by 1")
def k3_kll_within(t: Tables) -> DataFrame:
    s = t.events.groupBy("event_type").agg(sketches.kll("value").alias("sketch"))
    return sketches.within_rank(t.events, ["event_type"], "value", sketches.kll_merge(s, ["event_type"], QS), QS, 0.0133)


@query("select event_type, true as p50, true as p95, true as p99 from events group by 1")
def k4_kll_merge(t: Tables) -> DataFrame:
    s = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(sketches.kll("value").alias("sketch"))
    return sketches.within_rank(t.events, ["event_type"], "value", sketches.kll_merge(s, ["event_type"], QS), QS, 0.0133)


@query("select unnest(['union', 'intersection', 'difference']) as op, true as within")
def k5_theta_within(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_custkey").alias("c"), "o_orderstatus")
    found = sketches.theta_ops(rows, "c", "o_orderstatus = 'F'", "o_orderstatus = 'O'")
    a, b = (rows.where(F.col("o_orderstatus") == s).select("c").distinct() for s in ("F", "O"))
    exact = {"union": a.union(b).distinct(), "intersection": a.intersect(b), "difference": a.subtract(b)}
    union = exact["union"].agg(F.count("*").alias("u"))
    out = None
    for op, rows_ in exact.items():
        one = found.select(F.col(op).alias("e")).crossJoin(rows_.agg(F.count("*").alias("n"))).crossJoin(union)  # one row each
        one = one.select(F.lit(op).alias("op"), (F.abs(F.col("e") - F.col("n")) <= 0.05 * F.col("u")).alias("within"))
        out = one if out is None else out.unionByName(one)
    return out


@query("select l_suppkey as item, true as frequent from lineitem group by 1 order by count(*) desc, 1 limit 5")
def k6_heavy_hitters_within(t: Tables) -> DataFrame:
    """The five most frequent suppliers, among the sketch's items with those counts or more."""
    exact = t.lineitem.groupBy(F.col("l_suppkey").alias("item")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(5)
    found = sketches.heavy_hitters(t.lineitem, "l_suppkey", 1000)
    return exact.join(found, "item", "left").select("item", F.coalesce(F.col("count") >= F.col("n"), F.lit(False)).alias("frequent"))


@query("select l_suppkey, true as over from lineitem group by 1")
def k7_count_min(t: Tables) -> DataFrame:
    """Never below the true count, and above it by no more than 1 % of all rows, up to a chance of 1 % a value."""
    table = cut(sketches.count_min(t.lineitem, "l_suppkey", 0.01, 0.99), "count-min")
    exact = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    found = sketches.count_min_estimate(table, exact, "l_suppkey", 0.01, 0.99)
    return exact.join(found, "l_suppkey").select("l_suppkey", (F.col("estimate") >= F.col("n")).alias("over"))


@query("select count(distinct l_suppkey) as suppliers, true as never_below, true as within from lineitem")
def k7_count_min_bounds(t: Tables) -> DataFrame:
    """Both bounds: no estimate below the count, and at least 99 % of them above it by no more than 1 % of all rows."""
    table = cut(sketches.count_min(t.lineitem, "l_suppkey", 0.01, 0.99), "count-min")
    exact = cut(t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n")), "counts")
    found = sketches.count_min_estimate(table, exact, "l_suppkey", 0.01, 0.99).join(exact, "l_suppkey").crossJoin(exact.agg(F.sum("n").alias("rows")))  # one row
    over = F.col("estimate") - F.col("n")
    return found.agg(F.count("*").alias("suppliers"), F.bool_and(over >= 0).alias("never_below"), (F.count_if(over <= 0.01 * F.col("rows")) >= 0.99 * F.count("*")).alias("within"))


@query("select event_type, count(distinct user_id) as users, true as within from events where ts < timestamp '2024-01-20' group by 1")
def k8_sketch_range(t: Tables) -> DataFrame:
    """Users of a range of days, from sketches kept by day."""
    by_day = cut(t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(sketches.hll("user_id").alias("sketch")), "sketch-table")
    found = sketches.hll_merge(by_day.where("day < '2024-01-20'"), ["event_type"])
    exact = t.events.where("ts < timestamp_ntz '2024-01-20'").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    return exact.join(found, "event_type").select("event_type", "users", (F.abs(F.col("estimate") - F.col("users")) <= 0.05 * F.col("users")).alias("within"))


@query("select unnest([8, 10, 12, 14]) as lg_k, count(distinct l_partkey) as exact, true as within from lineitem")
def k9_accuracy(t: Tables) -> DataFrame:
    """Errors by size of sketch, within four standard errors."""
    out = sketches.accuracy_report(t.lineitem, "l_partkey", [8, 10, 12, 14])
    return out.select("lg_k", "exact", (F.col("error") <= 4 * 1.04 / F.sqrt(F.pow(F.lit(2.0), F.col("lg_k")))).alias("within"))


# ---- time series


@query("select date_trunc('day', ts) as bucket, event_type, count(*) as n, sum((value + case when event_id % 50 = 0 then 10 else 0 end)::decimal(18,2))::double as total from events group by 1, 2")
def z2_refresh_rollup(t: Tables) -> DataFrame:
    """Every fiftieth reading is corrected after the rollup was stored."""
    aggs = (F.count("*").alias("n"), total(money("value")).alias("total"))
    stored = cut(t.events.groupBy(series.bucket("ts", "day").alias("bucket"), "event_type").agg(*aggs), "rollup")
    now = t.events.withColumn("value", F.col("value") + F.when(F.col("event_id") % 50 == 0, 10).otherwise(0))
    return series.refresh_rollup(stored, now, now.where("event_id % 50 = 0"), "ts", "day", ["event_type"], *aggs)


@query("select ts, event_id, value from events where user_id = 3 and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-25' order by ts")
def z3_series_slice(t: Tables) -> DataFrame:
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    return series.series_slice(t.events, "user_id", 3, "ts", at("2024-01-05"), at("2024-01-25")).select("ts", "event_id", "value")


@query("with c as (select user_id, ts::date as day, count(*) as n from events group by 1, 2), s as (select unnest(generate_series((select min(day) from c)::timestamp, (select max(day) from c)::timestamp, interval 1 day))::date as day) select k.user_id, s.day, coalesce(n, 0) as n from (select distinct user_id from c) k cross join s left join c on c.user_id = k.user_id and c.day = s.day")
def z4_fill_calendar(t: Tables) -> DataFrame:
    counts = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return series.fill_calendar(counts, ["user_id"], "day", ["n"])


# ---- graphs


@query(f"with recursive e as ({LINKS}), r as (select cast(10 as bigint) as node, 0 as hops union select dst, hops + 1 from r join e on src = node where hops < 3) select min(hops) as hops from r where node = (select max(node) from r)")
def g2_shortest_path(t: Tables) -> DataFrame:
    e = cut(links(t), "links")
    goal = graph.k_hop(e, 10, 3).agg(F.max("node")).first()[0]
    return graph.shortest_path(e, 10, goal, 3).select("hops")


PATH = f"with recursive e as ({LINKS}), r as (select cast(10 as bigint) as node, 0 as hops union select dst, hops + 1 from r join e on src = node where hops < 3), d as (select node, min(hops) as hops from r group by 1), b as (select e.dst as node, min(e.src) as src from e join d x on x.node = e.src join d y on y.node = e.dst and y.hops = x.hops + 1 group by 1), p as (select node, hops from d where node = (select max(node) from d) union all select b.src, p.hops - 1 from p join b on b.node = p.node where p.hops > 0)"


@query(f"{PATH} select hops::int as place, node from p")
def g2_path(t: Tables) -> DataFrame:
    """The nodes of the path itself, the least predecessor at each."""
    e = cut(links(t), "links")
    goal = graph.k_hop(e, 10, 3).agg(F.max("node")).first()[0]
    return graph.shortest_path(e, 10, goal, 3).select(F.posexplode("nodes").alias("place", "node"))


@query(f"with recursive e as (select * from ({TREE}) where src % 100 <> 7 union all select o_orderkey, o_orderkey // 3 from orders where o_orderkey % 100 = 9), r as (select src, dst from e union select r.src, e.dst from r join e on e.src = r.dst) select src, dst from r")
def g4_reachable_delta(t: Tables) -> DataFrame:
    """The tree's closure after every hundredth order lost its parent and another hundredth gained one."""
    e = cut(tree(t), "tree")
    added = t.orders.where("o_orderkey % 100 = 9").select(F.col("o_orderkey").alias("src"), F.expr("o_orderkey div 3").alias("dst"))
    return graph.reachable_delta(graph.reachable(e), e, added, e.where("src % 100 = 7"))


SPEND = f"with recursive e as ({LINKS}), r as (select cast(10 as bigint) as node, 0 as hops union select dst, hops + 1 from r join e on src = node where hops < 2), f as (select distinct node from r where node <> 10)"


@query(f"{SPEND} select o_orderstatus, sum(o_totalprice::decimal(18,2))::double as total from orders join f on 2 * o_custkey = node group by 1")
def g5_network_spend(t: Tables) -> DataFrame:
    spent = t.orders.select((2 * F.col("o_custkey")).alias("node"), money("o_totalprice").alias("amount"), "o_orderstatus")
    return graph.network_spend(cut(links(t), "links"), 10, 2, spent, "o_orderstatus").withColumn("total", F.col("total").cast("double"))


@query(f"{SPEND}, b as (select distinct 2 * o_custkey as node, l_partkey as item from orders join lineitem on o_orderkey = l_orderkey) select item, count(*) as buyers from b join f using (node) where item not in (select item from b where node = 10) group by 1")
def g5_network_picks(t: Tables) -> DataFrame:
    bought = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select((2 * F.col("o_custkey")).alias("node"), F.col("l_partkey").alias("item"))
    return graph.network_picks(cut(links(t), "links"), 10, 2, bought)


RUNS = "select 'j' || (o_orderkey % 12) as job, 'd' || (o_orderkey % 12) as src, 'd' || (o_orderkey % 12 + 1 + o_orderkey % 3) as dst from orders"


def runs(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 12
    name = lambda c: F.concat(F.lit("d"), c.cast("string"))
    job = F.concat(F.lit("j"), k.cast("string"), F.lit("-"), (F.col("o_orderkey") % 3).cast("string"))
    inputs = t.orders.select(job.alias("job"), F.lit("input").alias("side"), name(k).alias("dataset"))
    return inputs.union(t.orders.select(job, F.lit("output"), name(k + 1 + F.col("o_orderkey") % 3)))


@query(f"select distinct src, dst from ({RUNS})")
def n6_lineage_edges(t: Tables) -> DataFrame:
    return graph.lineage_edges(runs(t))


@query(f"with recursive e as (select distinct src, dst from ({RUNS})), r as (select src as dataset from e where dst = 'd14' union select e.src from r join e on e.dst = r.dataset) select dataset from r")
def n6_upstream(t: Tables) -> DataFrame:
    return graph.upstream(graph.lineage_edges(runs(t)), "d14")


# ---- vectors


L2 = "with e as (select vec_id, cast(embedding as double[]) as v from embeddings), s as (select q.vec_id as query_id, b.vec_id, -list_distance(b.v, q.v) as raw from e q, e b where q.vec_id % 20 = 0) select query_id, vec_id, round(raw, 4) + 0.0 as score from s qualify row_number() over (partition by query_id order by raw desc, vec_id) <= 10"


@query(L2)
def e1_knn_l2(t: Tables) -> DataFrame:
    out = search.knn_many(t.embeddings, t.embeddings.where("vec_id % 20 = 0"), "vec_id", "embedding", 10, metric="l2")
    return out.withColumn("score", F.round("score", 4) + F.lit(0.0))


@query("with e as (select vec_id, list_concat(cast(embedding as double[]), [20.0::double * label]) as v from embeddings), s as (select q.vec_id as query_id, b.vec_id, -list_distance(b.v, q.v) as raw from e q, e b where q.vec_id % 20 = 0) select query_id, vec_id, round(raw, 4) + 0.0 as score from s qualify row_number() over (partition by query_id order by raw desc, vec_id) <= 10")
def e1_knn_clustered(t: Tables) -> DataFrame:
    """Vectors that lie in clusters, one a label; the tests hold the share of pairs compared below a third."""
    return clustered(t)[0].withColumn("score", F.round("score", 4) + F.lit(0.0))


def clustered(t: Tables) -> tuple[DataFrame, dict[str, int]]:
    v = F.concat(F.col("embedding").cast("array<double>"), F.array(20.0 * F.col("label")))
    base = t.embeddings.select("vec_id", v.alias("embedding"))
    return neighbours.knn_in_cells(base, base.where("vec_id % 20 = 0"), "vec_id", "embedding", 10, block=50, metric="l2")


DIMS = [16, 32, 48]


@query(f"with e as (select vec_id, cast(embedding as double[]) as v from embeddings), d as (select unnest([{', '.join(map(str, DIMS))}, 100000]) as dims), p as (select dims, vec_id, v[1:dims] as v from d, e), s as (select q.dims, q.vec_id as query_id, b.vec_id, list_dot_product(b.v, q.v) / sqrt(list_dot_product(b.v, b.v) * list_dot_product(q.v, q.v)) as raw from p q join p b using (dims) where q.vec_id % 20 = 0), f as (select dims, query_id, vec_id from s qualify row_number() over (partition by dims, query_id order by raw desc, vec_id) <= 10) select a.dims, round(count(*) / (10.0 * (select count(*) from e where vec_id % 20 = 0)), 6) as recall from f a join f b on b.dims = 100000 and a.query_id = b.query_id and a.vec_id = b.vec_id where a.dims < 100000 group by 1")
def e5_recall_by_dims(t: Tables) -> DataFrame:
    """Recall of searches that see the leading dimensions only."""
    asked = lambda df: search.knn_many(df, df.where("vec_id % 20 = 0"), "vec_id", "embedding", 10)
    exact = asked(t.embeddings)
    of = lambda dims: search.recall_at_k(asked(t.embeddings.withColumn("embedding", F.slice("embedding", 1, dims))), exact, "query_id", "vec_id", 10)
    parts = [of(dims).select(F.lit(dims).alias("dims"), F.round("recall", 6).alias("recall")) for dims in DIMS]
    return parts[0].union(parts[1]).union(parts[2])


def ivf(t: Tables, probes: int) -> DataFrame:
    index, centres = vectors.ivf_build(t.embeddings, "vec_id", "embedding", 16)
    return vectors.ivf_search(index, centres, t.embeddings.where("vec_id % 20 = 0"), "vec_id", "embedding", 10, probes)


@query()
def e3_ivf(t: Tables) -> DataFrame:
    """Approximate: the tests compare its recall by probes with the exact search."""
    return ivf(t, 8)


@query("with e as (select vec_id, cast(embedding as double[]) as v from embeddings), u as (select vec_id, v from e where len([x for x in v if x is null or not isfinite(x)]) = 0 and len([x for x in v if x <> 0]) > 0), c as (select v, min(vec_id) as a from u group by v), s as (select x.a, y.a as b, list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v) * list_dot_product(y.v, y.v)) as raw from c x join c y on x.a < y.a) select a, b, round(raw, 6) as score, false as copy from s where raw >= 0.35 union all select a, vec_id, 1.0::double, true from u join c using (v) where vec_id <> a")
def e4_lsh_join(t: Tables) -> DataFrame:
    """All pairs of different vectors, each vector by its smallest id; rows with copy: b has the vector of a."""
    pairs = vectors.lsh_join(t.embeddings, "vec_id", "embedding", 0.35, tables=24, bits=6)
    copies = vectors.copies(t.embeddings, "vec_id", "embedding").select(F.col("class").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"), F.lit(True).alias("copy"))
    return pairs.select("a", "b", F.round("score", 6).alias("score"), F.lit(False).alias("copy")).unionByName(copies)


@query("select 1.0 as recall")
def e5_recall(t: Tables) -> DataFrame:
    """Of a search that probes every list, so it must find all."""
    exact = search.knn_many(t.embeddings, t.embeddings.where("vec_id % 20 = 0"), "vec_id", "embedding", 10)
    found = ivf(t, 16).withColumnRenamed("id", "vec_id")
    return search.recall_at_k(found, exact, "query_id", "vec_id", 10).select(F.round("recall", 6).alias("recall"))


@query("with e as (select vec_id, label, cast(embedding as double[]) as v from embeddings), s as (select q.vec_id as query_id, b.vec_id, list_dot_product(b.v, q.v) / sqrt(list_dot_product(b.v, b.v) * list_dot_product(q.v, q.v)) as raw from e q, e b where q.vec_id % 20 = 0 and q.vec_id <> b.vec_id and b.label <> 1) select query_id, vec_id, round(raw, 6) as score from s qualify row_number() over (partition by query_id order by raw desc, vec_id) <= 5")
def e6_recommend(t: Tables) -> DataFrame:
    return vectors.recommend(t.embeddings, t.embeddings.where("vec_id % 20 = 0"), "vec_id", "embedding", 5, F.col("label") != 1).withColumn("score", F.round("score", 6))


CHUNKS = "with w as (select item_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') as w from benchmark), c as (select item_id, w, unnest(range(0, greatest(len(w) - 10 - 1, 0) + 1, 40)) as s from w) select item_id, s // 40 as chunk_no, array_to_string(w[s + 1 : s + 50], ' ') as chunk from c"


@query(CHUNKS)
def e7_chunk(t: Tables) -> DataFrame:
    return search.chunk(t.benchmark, "item_id", "text", 50, 10)


@query("with x as (select label, generate_subscripts(embedding, 1) as i, unnest(embedding::double[]) as x from embeddings), m as (select label, i, avg(x) as m from x group by 1, 2), n as (select label, sqrt(sum(m * m)) as n from m group by 1) select label, i - 1 as i, round(m / n, 6) + 0.0 as x from m join n using (label)")
def e8_mean_vector(t: Tables) -> DataFrame:
    out = vectors.mean_vector(t.embeddings, "label", "embedding")
    return out.select("label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round("x", 6) + F.lit(0.0))


@query("with w as (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as t from benchmark), p as (select item_id, ('0x' || substr(md5(t), 1, 8))::bigint % 64 as i, case when substr(md5(t), 9, 1) < '8' then 1 else -1 end as s from w), x as (select item_id, i, sum(s) as x from p group by 1, 2), n as (select item_id, sqrt(sum(x * x)) as n from x group by 1) select item_id, i, round(x / n, 6) + 0.0 as x from x join n using (item_id) where x <> 0")
def e9_hash_embed(t: Tables) -> DataFrame:
    out = vectors.hash_embed(t.benchmark, "item_id", "text", 64)
    return out.select("item_id", F.posexplode("vector").alias("i", "x")).where("x <> 0").withColumn("x", F.round("x", 6) + F.lit(0.0))


def letters():
    """Stands in for a model: shares of letters."""
    alphabet = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    return lambda texts: np.stack([(np.frombuffer(x.encode(), np.uint8)[:, None] == alphabet).sum(axis=0) if x else np.zeros(26) for x in texts])


@query("select item_id, len(regexp_extract_all(text, 'e')) as e, len(regexp_extract_all(text, '[a-z]')) as letters from benchmark")
def e10_embed(t: Tables) -> DataFrame:
    out = vectors.embed(t.benchmark, "item_id", "text", letters)
    return out.select("item_id", F.col("vector")[4].cast("long").alias("e"), F.aggregate("vector", F.lit(0.0), lambda s, x: s + x).cast("long").alias("letters"))


# ---- text search

BM25 = "{p}_t as (select {id} as id, regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+') as t from {table}), {p}_p as (select id, len(t) as len, unnest(t) as term from {p}_t), {p}_f as (select id, len, term, count(*) as tf from {p}_p where term in ({terms}) group by all), {p}_d as (select term, count(*) as df from {p}_f group by 1), {p}_s as (select count(*) as n, avg(len(t)) as a from {p}_t), {p} as (select id, {boost} * sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))) as score from {p}_f join {p}_d using (term), {p}_s group by 1)"


@query("with " + BM25.format(p="x", id="p_partkey", c="p_name", table="part", terms="'cold', 'widget', 'promo'", boost=2) + ", " + BM25.format(p="y", id="p_partkey", c="p_type", table="part", terms="'cold', 'widget', 'promo'", boost=1) + " select id, round(coalesce(x.score, 0) + coalesce(y.score, 0), 6) as score from x full join y using (id) order by 2 desc, 1 limit 20")
def x5_field_boost(t: Tables) -> DataFrame:
    return search.bm25_docs(t.part, "p_partkey", {"p_name": 2.0, "p_type": 1.0}, ["cold", "widget", "promo"], 20)


@query("select item_id, regexp_replace(regexp_extract(text, '(?is)(.{0,30}\\b(?:the)\\b.{0,30})', 1), '\\b(the)\\b', '[\\1]', 'gi') as snippet from benchmark where regexp_matches(text, '\\bthe\\b', 'i')")
def x6_snippet(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", search.snippet(F.col("text"), ["the"]).alias("snippet")).where("snippet is not null")


RANKS = "a as (select vec_id as id, row_number() over (order by embedding[1] desc, vec_id) as rank from embeddings), b as (select vec_id as id, row_number() over (order by embedding[2] desc, vec_id) as rank from embeddings)"


@query(f"with {RANKS} select id, round(sum(1.0 / (60 + rank)), 9) as score from (select * from a where rank <= 50 union all select * from b where rank <= 50) group by 1 order by 2 desc, 1 limit 10")
def x7_rrf(t: Tables) -> DataFrame:
    lists = [search.ranked(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding")[i].alias("x")), [F.desc("x"), F.col("id")], 50).select("id", "rank") for i in (0, 1)]
    return search.rrf(lists, 10)


@query("select q.item_id::varchar as query_id, 'doc ' || q.item_id as path, 1.0 as score from benchmark q where q.item_id % 3 <> 0")
def x9_retrieve(t: Tables) -> DataFrame:
    """Files of benchmark passages: added, a third of them removed, some edited back and forth; each is its own nearest."""
    b = t.benchmark.select(F.concat(F.lit("doc "), F.col("item_id").cast("string")).alias("path"), "item_id", "text")
    changes = b.select("path", F.lit(1).alias("seq"), "text").union(b.where("item_id % 3 = 0").select("path", F.lit(2), F.lit(None).cast("string")))
    changes = changes.union(b.where("item_id % 3 = 1").select("path", F.lit(2), F.lit("edited away"))).union(b.where("item_id % 3 = 1").select("path", F.lit(3), F.col("text")))
    found = search.retrieve(changes, "path", "seq", "text", b.where("item_id % 3 <> 0").select(F.col("item_id").alias("query_id"), "text"), 1)
    return found.select("query_id", "path", F.round("score", 4).alias("score"))


# ---- roles


CLERK = gov.Policy({"c_name": lambda c: F.concat(F.substring(c, 1, 1), F.lit("***")), "c_acctbal": gov.blank}, ("c_mktsegment",), "c_nationkey")


@query("select c_custkey, c_acctbal from customer where c_nationkey = 7")
def n2_row_filter(t: Tables) -> DataFrame:
    return gov.row_filter(t.customer, CLERK, {"c_nationkey": 7}).select("c_custkey", "c_acctbal")


@query("select 'clerk' as role, count(*) as n, count(distinct left(c_name, 1) || '***') as names, 0.0 as total from customer where c_nationkey = 7 union all select 'auditor', count(*), count(distinct c_name), sum(c_acctbal::decimal(18,2))::double from customer")
def n3_role_views(t: Tables) -> DataFrame:
    views = {"clerk": gov.secure_view(t.customer, CLERK, {"c_nationkey": 7}), "auditor": gov.secure_view(t.customer, gov.Policy(), {})}
    sums = [v.agg(F.count("*").alias("n"), F.count_distinct("c_name").alias("names"), F.coalesce(F.sum(F.col("c_acctbal").cast("decimal(18,2)")), F.lit(0)).cast("double").alias("total")).withColumn("role", F.lit(r)) for r, v in views.items()]
    return sums[0].unionByName(sums[1])


@query("select c_custkey, sha256(lower(trim(c_name))) as c_name from customer")
def n5_pseudonymize(t: Tables) -> DataFrame:
    return gov.pseudonymize(t.customer.select("c_custkey", "c_name"), ["c_name"])


# ---- user functions


@query("select o_orderkey, floor(o_totalprice / 1000)::bigint as thousands, o_totalprice > 100000 as large from orders")
def f1_apply_struct(t: Tables) -> DataFrame:
    fn = lambda price: pd.DataFrame({"thousands": (price // 1000).astype("int64"), "large": price > 100000})
    return udfs.apply_struct(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"], fn, "thousands long, large boolean").drop("o_totalprice")


@query("select l_orderkey, l_linenumber, l_quantity * 2 as twice from lineitem")
def f2_apply_batch(t: Tables) -> DataFrame:
    fn = lambda pdf: pdf.assign(twice=pdf["l_quantity"] * 2).drop(columns="l_quantity")
    return udfs.apply_batch(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), fn, "l_orderkey long, l_linenumber int, twice double")


@query("select user_id, event_type, count(*) as n, round(exp(avg(ln(1 + abs(value)))) - 1, 6) as geometric, max(abs(value)) as highest from events group by 1, 2")
def f3_udaf(t: Tables) -> DataFrame:
    """Geometric means and highest values: states of whole batches, merged by key."""

    def state(pdf: pd.DataFrame) -> pd.DataFrame:
        size = pdf["value"].abs()
        return pd.DataFrame({"n": size.notna().astype(float), "logs": np.log1p(size), "highest": size})

    out = ordered.batch_aggregate(t.events.select("user_id", "event_type", "value"), ["user_id", "event_type"], state, {"n": "sum", "logs": "sum", "highest": "max"})
    return out.select("user_id", "event_type", F.col("n").cast("long").alias("n"), F.round(F.exp(F.col("logs") / F.col("n")) - 1, 6).alias("geometric"), "highest")


@query("select p_partkey, unnest(string_split(p_name, ' ')) as word from part")
def f4_udtf(t: Tables) -> DataFrame:
    return udfs.apply_rows(t.part.select("p_partkey", "p_name"), lambda row: ((row.p_partkey, w) for w in row.p_name.split(" ")), "p_partkey long, word string")


RUNS = "with r as (select *, row_number() over w as i, row_number() over w - row_number() over (partition by {0}, event_type order by {1}) as g from events window w as (partition by {0} order by {1})) select {0}, event_type as value, count(*) as n, min(i) - 1 as at from r group by {0}, event_type, g having count(*) >= {2}"


@query(RUNS.format("user_id", "event_id", 3))
def f4_runs_sql(t: Tables) -> DataFrame:
    """The table function from SQL."""
    udfs.register_runs(t.spark)
    return t.spark.sql("select * from runs_of(table({e}) partition by user_id order by (event_id), 'event_type', 3)", e=t.events.select("user_id", "event_id", "event_type"))


@query(RUNS.format("user_id", "event_id", 1))
def f4_runs(t: Tables) -> DataFrame:
    """The table function from a DataFrame."""
    return udfs.runs_of(t.events, "user_id", "event_id", "event_type")


@query("select o_orderkey, case o_orderstatus when 'F' then 'red' when 'O' then 'green' else 'blue' end as colour, case o_orderstatus when 'F' then 0.862745 when 'O' then 0.705882 else 0.823529 end as brightness, n_name as likes from orders join nation on n_nationkey = case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end")
def f5_image_features(t: Tables) -> DataFrame:
    """Pictures of one colour by status, joined on the colour that is found."""
    pixel = F.when(F.col("o_orderstatus") == "F", F.array(*map(F.lit, (220, 40, 40)))).when(F.col("o_orderstatus") == "O", F.array(*map(F.lit, (40, 180, 60)))).otherwise(F.array(*map(F.lit, (50, 80, 210))))
    pictures = t.orders.select("o_orderkey", F.flatten(F.array_repeat(pixel, 16)).alias("pixels"))
    likes = t.nation.where("n_nationkey < 3").select(F.element_at(F.array(F.lit("red"), F.lit("green"), F.lit("blue")), F.col("n_nationkey") + 1).alias("colour"), F.col("n_name").alias("likes"))
    return udfs.image_features(pictures, "pixels").join(likes, "colour").select("o_orderkey", "colour", "brightness", "likes")


# ---- streams of several batches


def many(t: Tables, batches: int = 4) -> DataFrame:
    """events as a stream of several files, a batch each, so that windows are met in every batch."""
    folder = scratch(t.spark, "stream-source")
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(batches):
        rows.where(F.col("event_id") % batches == i).coalesce(1).write.mode("append").parquet(folder)
    return ev.read_events(t.spark, folder, rows.schema, files_per_batch=1)


@query("select date_trunc('hour', ts) as start, count(*) as n, max(value) as hi from events group by 1")
def t3_tumble(t: Tables) -> DataFrame:
    agg = ev.tumble(many(t), "ts", "1 hour", [], F.count("*").alias("n"), F.max("value").alias("hi")).drop("end")
    return plain(ev.upsert_sink(agg, ["start"], ev.fresh_folder(t.spark, "t3")), "start")


@query("with s as (select unnest([time_bucket(interval 6 hour, ts), time_bucket(interval 6 hour, ts) - interval 6 hour]) as start, event_type from events) select start, count(*) as n, round(count(*) filter (where event_type = 'error') / count(*), 6) as errors from s group by 1")
def t5_slide(t: Tables) -> DataFrame:
    errors = F.round(F.count_if(F.col("event_type") == "error") / F.count("*"), 6).alias("errors")
    agg = ev.tumble(many(t), "ts", "12 hours", [], F.count("*").alias("n"), errors, slide="6 hours").drop("end")
    return plain(ev.upsert_sink(agg, ["start"], ev.fresh_folder(t.spark, "t5")), "start")


def corrected(t: Tables) -> DataFrame:
    """Orders in three files: all, then late ones, then every tenth with another price; as a stream."""
    folder = scratch(t.spark, "stream-source")
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    rows = [o.where("o_orderkey % 9 <> 0"), o.where("o_orderkey % 9 = 0"), o.where("o_orderkey % 10 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)]
    for i, df in enumerate(rows):
        df.withColumn("seq", F.lit(i)).coalesce(1).write.mode("append").parquet(folder)
    return ev.read_events(t.spark, folder, t.spark.read.parquet(folder).schema, files_per_batch=1)


PAID = "(o_totalprice::decimal(18,2) + case when o_orderkey % 10 = 0 then 1 else 0 end)"


def by_month(made: dict[str, DataFrame]) -> DataFrame:
    return made["base"].groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n"), total(money("o_totalprice")).alias("total"))


@query(f"select date_trunc('month', o_orderdate) as month, count(*) as n, sum({PAID})::double as total from orders group by 1")
def t7_corrected_windows(t: Tables) -> DataFrame:
    folder = ev.fresh_folder(t.spark, "t7")
    ev.maintained_views(corrected(t), folder, "o_orderkey", "seq", {"months": by_month})
    return ev.read_view(t.spark, folder, "months")


@query(f"with c as (select o_custkey, sum({PAID}) as spent from orders group by 1) select floor(spent / 500000)::bigint as class, count(*) as customers from c group by 1")
def t8_cascade(t: Tables) -> DataFrame:
    """Customers' totals, and classes of them made from that view, in every batch."""
    customers = lambda made: made["base"].groupBy("o_custkey").agg(F.sum(money("o_totalprice")).alias("spent"))
    classes = lambda made: made["customers"].groupBy(F.floor(F.col("spent") / 500000).cast("long").alias("class")).agg(F.count("*").alias("customers"))
    folder = ev.fresh_folder(t.spark, "t8")
    ev.maintained_views(corrected(t), folder, "o_orderkey", "seq", {"customers": customers, "classes": classes})
    return ev.read_view(t.spark, folder, "classes")


@query("select event_type, count(*) as n from events group by 1")
def t10_apply_once(t: Tables) -> DataFrame:
    """Every event is delivered twice, in other batches."""
    folder = scratch(t.spark, "stream-source")
    for i in range(3):
        t.events.where(F.pmod("event_id", F.lit(3)).isin(i, (i + 1) % 3)).select("event_id", "event_type").coalesce(1).write.mode("append").parquet(folder)
    stream = ev.read_events(t.spark, folder, t.spark.read.parquet(folder).schema, files_per_batch=1)
    return ev.apply_once(stream, "event_id", ["event_type"], ev.fresh_folder(t.spark, "t10"))


@query("select event_type, count(*) as n, count(distinct event_id) as ids from events group by 1")
def t15_resume(t: Tables) -> DataFrame:
    """Stopped after each file and started again from its checkpoint, five times."""
    source, folder = scratch(t.spark, "stream-source"), ev.fresh_folder(t.spark, "t15")
    for i in range(5):
        t.events.where(F.col("event_id") % 5 == i).coalesce(1).write.mode("append").parquet(source)
        rows = ev.write_stream(ev.read_events(t.spark, source, t.events.schema), folder)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("select true as agree, count(*) as orders from orders")
def t16_consistent_views(t: Tables) -> DataFrame:
    """Two views read at one batch count the same orders, in every batch."""
    folder = ev.fresh_folder(t.spark, "t16")
    count = lambda key: lambda made: made["base"].groupBy(key).agg(F.count("*").alias("n"))
    ev.maintained_views(corrected(t), folder, "o_orderkey", "seq", {"customers": count("o_custkey"), "days": count("o_orderdate")})
    last = ev.last_batch(t.spark, folder)
    sums = [ev.read_view(t.spark, folder, v, b).agg(F.sum("n").alias("n")).withColumns({"view": F.lit(v), "batch": F.lit(b)}) for b in range(last + 1) for v in ("customers", "days")]
    every = sums[0]
    for s in sums[1:]:
        every = every.unionByName(s)
    return every.groupBy("batch").agg(F.min("n").alias("a"), F.max("n").alias("b")).agg(F.bool_and(F.col("a") == F.col("b")).alias("agree"), F.max("b").alias("orders"))


# ---- state in buckets


@query(f"select date_trunc('month', o_orderdate) as month, count(*) as n, sum({PAID})::double as total from orders group by 1")
def t7_windows_in_buckets(t: Tables) -> DataFrame:
    """Late and corrected orders change the months that they touch."""
    months = buckets.View("base", {"month": F.date_trunc("month", "o_orderdate").cast("timestamp_ntz")}, {"total": money("o_totalprice")})
    store = buckets.maintain(corrected(t), ev.fresh_folder(t.spark, "t7b"), ["o_orderkey"], "seq", {"months": months}, 16)
    return store.read("months").withColumn("total", F.col("total").cast("double"))


@query(f"with c as (select o_custkey, sum({PAID}) as spent from orders group by 1) select floor(spent / 500000)::bigint as class, count(*) as n from c group by 1")
def t8_cascade_in_buckets(t: Tables) -> DataFrame:
    """Customers' totals by changed orders, classes by changed customers."""
    customers = buckets.View("base", {"o_custkey": F.col("o_custkey")}, {"spent": money("o_totalprice")})
    classes = buckets.View("customers", {"class": F.floor(F.col("spent") / 500000).cast("long")})
    return buckets.maintain(corrected(t), ev.fresh_folder(t.spark, "t8b"), ["o_orderkey"], "seq", {"customers": customers, "classes": classes}, 16).read("classes")


@query("select event_type, count(*) as n from events group by 1")
def t10_once_in_buckets(t: Tables) -> DataFrame:
    """Every event is delivered twice, in other batches; the second time it changes nothing."""
    folder = scratch(t.spark, "stream-source")
    for i in range(3):
        t.events.where(F.pmod("event_id", F.lit(3)).isin(i, (i + 1) % 3)).select("event_id", "event_type").coalesce(1).write.mode("append").parquet(folder)
    stream = ev.read_events(t.spark, folder, t.spark.read.parquet(folder).schema, files_per_batch=1)
    return buckets.maintain(stream, ev.fresh_folder(t.spark, "t10b"), ["event_id"], None, {"kinds": buckets.View("base", {"event_type": F.col("event_type")})}, 16).read("kinds")


@query("select batch, view, n from (select unnest([0, 1, 2]) as batch), (select unnest(['customers', 'days']) as view), lateral (select count(*) as n from orders where batch > 0 or o_orderkey % 9 <> 0)")
def t16_views_in_buckets(t: Tables) -> DataFrame:
    """Two views hold the same orders in every batch, read as of it."""
    views = {"customers": buckets.View("base", {"o_custkey": F.col("o_custkey")}), "days": buckets.View("base", {"o_orderdate": F.col("o_orderdate")})}
    store = buckets.maintain(corrected(t), ev.fresh_folder(t.spark, "t16b"), ["o_orderkey"], "seq", views, 16)
    return merge.union(*(store.read(v, b).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(b).alias("batch"), F.lit(v).alias("view"), "n") for b in store.batches() for v in views))


@query("select event_id, user_id, (sum(value::decimal(18,2)) over (partition by user_id order by event_id % 4, event_id))::double as running from events")
def t2_running_in_buckets(t: Tables) -> DataFrame:
    rows = buckets.running_totals(many(t), "user_id", "event_id", money("value"), ev.fresh_folder(t.spark, "t2b"), 16)
    return rows.select("event_id", "user_id", F.col("running").cast("double").alias("running"))
