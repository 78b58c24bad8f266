"""Every registered query that SQL can express, against DuckDB on the same tables."""

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from ashlar.operators.search import knn_many
from ashlar.plans import changing, geo, incremental, relational, retrieval, sources, streams, tables, vault  # noqa: F401
from ashlar.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, (float, Decimal)):
        return "nan" if math.isnan(x) else f"{float(x):.9g}"
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    return repr(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    want = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_graphs_take_whole_tables(spark, db):
    """Every order is in the closure and the self join, and all linked customers and suppliers can be in pairs and hops."""
    orders = db.execute("select count(*) from orders where o_orderkey > 0").fetchone()[0]
    for name, key in (("g3_reachable_tree", "src"), ("j8_self_join_orders", "o_orderkey")):
        assert QUERIES[name](spark, SF).select(key).distinct().count() == orders > 97
    returned = db.execute("select count(*) from (select distinct o_custkey, l_suppkey from orders join lineitem on o_orderkey = l_orderkey where l_returnflag = 'R')").fetchone()[0]
    assert QUERIES["j9_mutual_links"](spark, SF).count() == returned > 291
    assert QUERIES["g1_k_hop_links"](spark, SF).where("node >= 2 * 97").count() > 0


def test_knn_answers_every_query(spark, db):
    """All rows with vec_id % 20 = 0 are queries, in one block or many; ties, few candidates, null and zero vectors."""
    queries = db.execute("select count(*) from embeddings where vec_id % 20 = 0").fetchone()[0]
    assert QUERIES["e2_filtered_knn_many"](spark, SF).select("query_id").distinct().count() == queries > 1
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = knn_many(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10, e["label"] == 3, block=7).withColumn("score", F.round("score", 6))
    want = db.execute(ORACLE_SQL["e2_filtered_knn_many"])
    assert rows(got.columns, got.collect()) == rows([c[0] for c in want.description], want.fetchall())
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [3.0, 0.0]), (4, None), (5, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in knn_many(few, few.where("vec_id in (3, 4)"), "vec_id", "embedding", 2, block=2).orderBy("vec_id").collect()] == [(3, 1, 1.0), (3, 2, 1.0)]
    assert knn_many(few, few, "vec_id", "embedding", 2, few["vec_id"] > 9).count() == 0
