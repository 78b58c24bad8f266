"""Cells and polygons over points that follow from customer keys, and marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.functions import money
from ashlar.operators import geo
from ashlar.operators.vault import star_mart
from ashlar.plans.catalog import Tables, query

POINTS = "select c_custkey, (c_custkey * 7 % 1800) / 10.0::double as x, (c_custkey % 900) / 10.0::double as y from customer"
CELLS = f"with p as ({POINTS}), a as (select *, (x * 0.5773502691896258::double - y / 3.0::double) / 5.0::double as fq, y * 2.0::double / 3.0::double / 5.0::double as fr from p), b as (select *, -fq - fr as fs from a), c as (select *, floor(fq + 0.5::double) as iq, floor(fr + 0.5::double) as ir, floor(fs + 0.5::double) as is_ from b), cells as (select c_custkey, (case when abs(iq - fq) > abs(ir - fr) and abs(iq - fq) > abs(is_ - fs) then -ir - is_ else iq end)::bigint as q, (case when not (abs(iq - fq) > abs(ir - fr) and abs(iq - fq) > abs(is_ - fs)) and abs(ir - fr) > abs(is_ - fs) then -iq - is_ else ir end)::bigint as r from c), n as (select q, r, count(*) as n from cells group by 1, 2)"
RING = [(20.0, 10.0), (150.0, 20.0), (90.0, 80.0)]


def points(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(k, ((k * 7 % 1800) / F.lit(10.0)).alias("x"), ((k % 900) / F.lit(10.0)).alias("y"))


def cells(t: Tables) -> DataFrame:
    return geo.hex_cells(points(t), F.col("x"), F.col("y"), 5.0).groupBy("q", "r").agg(F.count("*").alias("n"))


@query(f"{CELLS} select * from n")
def h2_cell_stats(t: Tables) -> DataFrame:
    return cells(t)


@query(f"{CELLS} select q // 3 as pq, r // 3 as pr, sum(n)::bigint as n from (select floor(q / 3.0)::bigint * 3 as q, floor(r / 3.0)::bigint * 3 as r, n from n) group by 1, 2")
def h3_cell_rollup(t: Tables) -> DataFrame:
    return cells(t).groupBy(F.floor(F.col("q") / 3.0).alias("pq"), F.floor(F.col("r") / 3.0).alias("pr")).agg(F.sum("n").alias("n"))


@query(f"{CELLS}, d as (select unnest([0, 1, -1, 0, 0, 1, -1]) as i, unnest([0, 0, 0, 1, -1, -1, 1]) as j) select q + i as q, r + j as r, sum(n)::double / 7 as n from n, d group by 1, 2")
def h4_smooth(t: Tables) -> DataFrame:
    return geo.smooth(cells(t), 1, "n")


@query(f"select c_custkey, ((y >= 10 and y < 20 and x < 20 + (y - 10) * 13.0::double)::int + ((y >= 20 and y < 80) and x < 150 + (y - 20) * -1.0::double)::int + ((y >= 10 and y < 80) and x < 90 + (y - 80) * 1.0::double)::int) % 2 = 1 as inside from ({POINTS})")
def h5_in_polygon(t: Tables) -> DataFrame:
    return points(t).select("c_custkey", geo.in_polygon(F.col("x"), F.col("y"), RING).alias("inside"))


#: Stars with five points around a place that follows from the supplier's key; every third has a hole.
CORNERS = [(0.0, 1.0), (0.25, 0.25), (1.0, 0.2), (0.4, -0.2), (0.6, -1.0), (0.0, -0.45), (-0.6, -1.0), (-0.4, -0.2), (-1.0, 0.2), (-0.25, 0.25)]
HOLE = [(-0.1, -0.1), (0.15, -0.1), (0.0, 0.2)]
PLACE = "(s_suppkey * 37 % 1800) / 10.0::double as x0, (s_suppkey * 53 % 900) / 10.0::double as y0, 1 + s_suppkey % 17::double as size"
SIDES = f"""corners as (select * from (values {", ".join(f"({g}, {i}, {n}, {x}::double, {y}::double)" for g, ring in enumerate((CORNERS, HOLE)) for n in [len(ring)] for i, (x, y) in enumerate(ring))}) as v(g, i, n, dx, dy)),
rings as (select s_suppkey, g, i, n, x0 + dx * size as x, y0 + dy * size as y from (select s_suppkey, {PLACE} from supplier), corners where g = 0 or s_suppkey % 3 = 0),
sides as (select a.s_suppkey, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from rings a join rings b on a.s_suppkey = b.s_suppkey and a.g = b.g and b.i = (a.i + 1) % a.n)"""


def stars(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    x0, y0, size = (k * 37 % 1800) / F.lit(10.0), (k * 53 % 900) / F.lit(10.0), (1 + k % 17).cast("double")
    ring = lambda corners: F.array(*(F.struct((x0 + F.lit(x) * size).alias("x"), (y0 + F.lit(y) * size).alias("y")) for x, y in corners))
    return t.supplier.select(k, F.when(k % 3 == 0, F.array(ring(CORNERS), ring(HOLE))).otherwise(F.array(ring(CORNERS))).alias("rings"))


@query(f"with {SIDES}, p as ({POINTS}) select c_custkey, s_suppkey from p, sides where (y1 > y) <> (y2 > y) and x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1)) group by 1, 2 having count(*) % 2 = 1")
def h5_in_polygons(t: Tables) -> DataFrame:
    """Customers in the stars around suppliers; the SQL tests every pair."""
    return geo.in_polygons(points(t), "x", "y", stars(t), "s_suppkey", "rings", 2.0).select("c_custkey", "s_suppkey")


@query(f"with {SIDES}, rows_ as (select unnest(generate_series(-60, 60))::bigint as r), cells as (select q, r, 1.5::double * 1.7320508075688772::double * (q + r / 2.0::double) as x, 1.5::double * 1.5::double * r as y from (select unnest(generate_series(-80, 140))::bigint as q), rows_) select s_suppkey, q, r from cells, sides where (y1 > y) <> (y2 > y) and x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1)) group by 1, 2, 3 having count(*) % 2 = 1")
def h5_polyfill(t: Tables) -> DataFrame:
    """Cells whose centres lie in the stars; the SQL tests every cell with every star."""
    return geo.polyfill(stars(t), "s_suppkey", "rings", 1.5)


@query("select o_orderkey, l_linenumber, c_mktsegment, p_brand, n_name, (l_extendedprice::decimal(18,2) * (1 - l_discount::decimal(18,2)))::double as net from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join part on l_partkey = p_partkey")
def v6_star_mart(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumn("net", (money("l_extendedprice") * (1 - money("l_discount"))).cast("double"))
    dims = [(t.orders, "l_orderkey", "o_orderkey"), (t.customer, "o_custkey", "c_custkey"), (t.nation, "c_nationkey", "n_nationkey"), (t.part, "l_partkey", "p_partkey")]
    return star_mart(lines, dims, ["o_orderkey", "l_linenumber", "c_mktsegment", "p_brand", "n_name", "net"])
