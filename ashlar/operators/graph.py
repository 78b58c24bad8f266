"""Graph queries as semi-naive loops over edge tables; lineage is cut each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.lineage import cut


def k_hop(edges: DataFrame, start: object, k: int) -> DataFrame:
    """node, hops: what is reached from start in at most k hops, start excluded. edges: src, dst."""
    kind = edges.schema["src"].dataType
    spark = edges.sparkSession
    seen = spark.range(1).select(F.lit(start).cast(kind).alias("node"), F.lit(0).alias("hops"))
    front = seen
    for hop in range(1, k + 1):
        new = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = cut(new.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)), "hop")
        seen = seen.union(front)
    return seen.where("hops > 0")


def chains(edges: DataFrame, most_rounds: int = 12) -> DataFrame | None:
    """src, dst: the transitive closure of distinct edges of which no node has two; None where a chain is longer than 2 ** most_rounds.

    A node has one row with what it reaches so far, in order, and the last of it.
    A round appends what that last one reaches, so rows double, and one that is
    whole isn't written again; no pair is made twice. A row that comes back to a
    node has gone round a cycle, and has all of it.
    """
    going = cut(edges.select(F.col("src").alias("node"), F.array("dst").alias("path"), F.col("dst").alias("top")), "chains")
    whole = going.limit(0)
    path, again = F.col("_path"), F.size(F.array_distinct("_path")) < F.size("_path")
    for _ in range(most_rounds + 1):
        if going.isEmpty():
            return whole.select(F.col("node").alias("src"), F.explode("path").alias("dst"))
        onward = going.union(whole).select(F.col("node").alias("top"), F.col("path").alias("_on"), F.col("top").alias("_top"))
        met = going.join(onward, "top", "left").withColumn("_path", F.concat("path", F.coalesce("_on", F.array().cast(going.schema["path"].dataType))))
        now = cut(met.select("node", F.when(again, F.array_distinct(path)).otherwise(path).alias("path"), F.when(~again, F.col("_top")).alias("top")), "chains")
        going, whole = now.where("top is not null"), whole.union(now.where("top is null"))
    return None


def reachable(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """src, dst: the transitive closure; cycles allowed. Only new pairs are joined again; where no node has two edges, chains() does without any pairs on the way."""
    edges = cut(edges.select("src", "dst").distinct(), "edges")
    if edges.groupBy("src").count().where("count > 1").isEmpty():
        found = chains(edges)
        if found is not None:
            return found
    step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    closure = front = edges
    for _ in range(most_rounds):
        new = front.join(step, "dst").select("src", F.col("next").alias("dst")).distinct()
        front = cut(new.join(closure, ["src", "dst"], "left_anti"), "closure")
        if front.isEmpty():
            return closure
        closure = closure.union(front)  # each front is written once
    raise RuntimeError("the closure did not settle")


def shortest_path(edges: DataFrame, start: object, goal: object, most: int) -> DataFrame:
    """nodes (array), hops: one shortest path, the least predecessor at each node; no row if there is none."""
    kind = edges.schema["src"].dataType
    front = edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node"), F.array(F.lit(start).cast(kind)).alias("nodes"))
    seen = front.select("node")
    for _ in range(most + 1):
        hit = front.where(F.col("node") == F.lit(goal))
        if not hit.isEmpty():
            return hit.select("nodes", (F.size("nodes") - 1).alias("hops"))
        new = edges.join(front.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min_by("nodes", "src").alias("nodes"))
        front = cut(new.join(seen, "node", "left_anti").select("node", F.concat("nodes", F.array("node")).alias("nodes")), "path")
        seen = seen.union(front.select("node"))
    return front.select("nodes", (F.size("nodes") - 1).alias("hops")).limit(0)


def reachable_delta(closure: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame, most_rounds: int = 100) -> DataFrame:
    """The closure after edges (src, dst) are added and removed: only sources that reached a changed edge's start are made anew."""
    starts = added.select("src").union(removed.select("src")).distinct()
    touched = cut(closure.join(starts.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src").union(starts).distinct(), "touched")
    now = cut(edges.select("src", "dst").join(removed.select("src", "dst"), ["src", "dst"], "left_anti").union(added.select("src", "dst")).distinct(), "edges")
    step = now.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    again = front = cut(now.join(touched, "src", "left_semi"), "closure")
    for _ in range(most_rounds):
        new = front.join(step, "dst").select("src", F.col("next").alias("dst")).distinct()
        front = cut(new.join(again, ["src", "dst"], "left_anti"), "closure")
        if front.isEmpty():
            return closure.join(touched, "src", "left_anti").unionByName(again)
        again = again.union(front)
    raise RuntimeError("the closure did not settle")


def network_picks(edges: DataFrame, start: object, hops: int, bought: DataFrame) -> DataFrame:
    """item, buyers: what the network within so many hops bought and the start did not. bought: node, item."""
    friends = k_hop(edges, start, hops).where(F.col("node") != F.lit(start)).select("node").distinct()
    theirs = bought.join(friends, "node", "left_semi").distinct()
    own = bought.where(F.col("node") == F.lit(start)).select("item").distinct()
    return theirs.join(own, "item", "left_anti").groupBy("item").agg(F.count("*").alias("buyers"))


def network_spend(edges: DataFrame, start: object, hops: int, spent: DataFrame, *keys: str) -> DataFrame:
    """keys, total: what the network within so many hops spent. spent: node, amount and keys."""
    friends = k_hop(edges, start, hops).where(F.col("node") != F.lit(start)).select("node").distinct()
    return spent.join(friends, "node", "left_semi").groupBy(*keys).agg(F.sum("amount").alias("total"))


def lineage_edges(runs: DataFrame) -> DataFrame:
    """src, dst: each input data set of a job to each of its outputs. runs: job, side (input or output), dataset."""
    sides = [runs.where(F.col("side") == s).select("job", F.col("dataset").alias(n)).distinct() for s, n in (("input", "src"), ("output", "dst"))]
    return sides[0].join(sides[1], "job").select("src", "dst").distinct()


def upstream(edges: DataFrame, dataset: str) -> DataFrame:
    """dataset: all that a data set is made from, at any distance."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seen = front = cut(back.where(F.col("src") == F.lit(dataset)).select(F.col("dst").alias("dataset")).distinct(), "upstream")
    while not front.isEmpty():
        new = back.join(front.withColumnRenamed("dataset", "src"), "src").select(F.col("dst").alias("dataset")).distinct()
        front = cut(new.join(seen, "dataset", "left_anti"), "upstream")
        seen = seen.union(front)
    return seen
