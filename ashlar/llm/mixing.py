"""Mixing sources to target weights by pivotal dependent rounding.

Each document has a fractional number of copies, its source's target over its
source's size. Whole copies are taken; the fractions are rounded by pairing
documents of a source: mass (in words) moves at random from one to the other
until one of the two is wholly in or out, which leaves the source's words as
they were and each document's chance as it was. Documents meet in bounded
groups; each group's one residual goes on to the next level of a reduction
tree, so a hot source is spread over as many tasks as it fills. DataFrame
functions only. Random numbers are hashes of the paired ids and the seed.

Defined cases: null text has size 0 and is taken 0 times; the null source comes
last; of repeated rows (same id, source and size) as many as their share has in
whole are taken, and one more or not by the rounding, so no item of it weighs
more than a document; an empty table gives an empty table. A source whose documents are few ends within one
document of its target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ashlar.lineage import cut
from ashlar.llm.text import uniform, words

#: Documents that meet in one group of the tree.
FAN_IN = 32


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), most: float = 3.0, share: float = 1.0) -> DataFrame:
    """source, source_size, target: share of all sizes dealt by weight, no source above most times its size.

    sizes: source, source_size, one row a source. Sources are ranked by code
    point, null last, and weigh weights[rank], repeating. The excess of capped
    sources is dealt again to the others by weight: with sources in order of
    cap per weight, the capped ones are a prefix.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    ranked = ranked.withColumn("capped", F.col("cap") / F.col("w") <= F.col("level"))
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), "level"))).over(Window.partitionBy())["level"]
    return ranked.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.least(level * F.col("w"), F.col("cap"))).alias("target"))


def _pair(group: Column, seed: int, level: Column) -> Column:
    """Round a group of (id, size, mass) in order: struct(left: the residual or null, done: [(id, up)])."""

    def meet(state: Column, doc: Column) -> Column:
        held = state["left"]
        to_doc, to_held = F.least(doc["size"] - doc["mass"], held["mass"]), F.least(held["size"] - held["mass"], doc["mass"])
        gives = uniform(held["id"], doc["id"], level, F.lit(seed)) * (to_doc + to_held) < to_held  # held gives to doc, with chance to_held / both
        # what became integral is set to 0 or its size exactly
        held_mass = F.when(gives, F.when(to_doc == held["mass"], 0.0).otherwise(held["mass"] - to_doc)).otherwise(F.when(to_held == held["size"] - held["mass"], held["size"]).otherwise(held["mass"] + to_held))
        doc_mass = F.when(gives, F.when(to_doc == doc["size"] - doc["mass"], doc["size"]).otherwise(doc["mass"] + to_doc)).otherwise(F.when(to_held == doc["mass"], 0.0).otherwise(doc["mass"] - to_held))
        two = F.array(F.struct(held["id"].alias("id"), held["size"].alias("size"), held_mass.alias("mass")), F.struct(doc["id"].alias("id"), doc["size"].alias("size"), doc_mass.alias("mass")))
        return F.struct(two.alias("two"), state["done"].alias("done"))

    def settle(state: Column) -> Column:
        open_ = F.filter(state["two"], lambda x: (x["mass"] > 0) & (x["mass"] < x["size"]))
        shut = F.filter(state["two"], lambda x: (x["mass"] <= 0) | (x["mass"] >= x["size"]))
        return F.struct(F.get(open_, F.lit(0)).alias("left"), F.concat(state["done"], F.transform(shut, lambda x: F.struct(x["id"].alias("id"), (x["mass"] > 0).alias("up")))).alias("done"))

    def step(state: Column, doc: Column) -> Column:
        return F.when(state["left"].isNull(), F.struct(doc.alias("left"), state["done"].alias("done"))).otherwise(settle(meet(state, doc)))

    none = F.struct(F.lit(None).cast("struct<id:bigint,size:double,mass:double>").alias("left"), F.lit([]).cast("array<struct<id:bigint,up:boolean>>").alias("done"))
    return F.aggregate(group, none, step)


def mix(docs: DataFrame, id_col: str = "doc_id", weights: Sequence[float] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 0) -> DataFrame:
    """One row for each row of docs: id_col, source, size, source_size, target, copies.

    docs: id_col, text, source. size is the text's number of words.
    """
    items = docs.select(F.col(id_col).alias("id"), "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    # a unit is what repeated rows share; key names it within the tree
    units = cut(items.groupBy("id", "source", "size").agg(F.count("*").alias("rows")), "mix-units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(sizes.select("source", "source_size"), weights, most)
    targets = cut(targets.join(sizes.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-targets")
    same = units["source"].eqNullSafe(targets["source"])
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    dealt = units.join(targets, same).drop(targets["source"]).withColumn("rate", rate)
    dealt = dealt.withColumns({"whole": F.floor("rate"), "key": F.xxhash64("id", "source", "size"), "buckets": F.ceil(F.col("n") / FAN_IN)})
    # of a unit's rows, so many have one copy more; what is left of their share is one fraction of a document
    share = (F.col("rate") - F.col("whole")) * F.col("rows")
    dealt = dealt.withColumns({"more": F.floor(share), "weight": F.col("size").cast("double")})
    dealt = cut(dealt.withColumn("part", (share - F.col("more")) * F.col("weight")), "mix-dealt")

    tree = dealt.where("part > 0 and part < weight").select("source", F.pmod("key", F.col("buckets")).alias("b"), "buckets", F.struct(F.col("key").alias("id"), F.col("weight").alias("size"), F.col("part").alias("mass")).alias("doc"))
    decided, level = [], 0
    more = targets.agg(F.max(F.ceil(F.col("n") / FAN_IN))).first()[0]
    while more is not None:
        # small documents first: the residual settles many of them, and what is left at the root is one document
        group = tree.groupBy("source", "b").agg(F.first("buckets").alias("buckets"), F.sort_array(F.collect_list(F.struct(F.col("doc")["size"].alias("size"), F.col("doc")["id"].alias("id"), F.col("doc")["mass"].alias("mass")))).alias("docs"))
        ordered = F.transform("docs", lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"), x["mass"].alias("mass")))
        group = cut(group.select("source", "b", "buckets", _pair(ordered, seed, F.lit(level)).alias("r")), f"mix-level{level}")
        decided.append(group.select(F.explode("r.done").alias("d")).select("d.*"))
        tree = group.where("r.left is not null").select("source", F.floor(F.col("b") / FAN_IN).alias("b"), F.ceil(F.col("buckets") / FAN_IN).alias("buckets"), F.col("r.left").alias("doc"))
        level += 1
        if more <= 1:
            break
        more = -(-more // FAN_IN)
    # the root's residual of each source goes to the nearer side
    decided.append(tree.select(F.col("doc.id").alias("id"), (F.col("doc.mass") * 2 >= F.col("doc.size")).alias("up")))
    ups = decided[0]
    for d in decided[1:]:
        ups = ups.unionByName(d)
    ups = ups.where("up").select(F.col("id").alias("key")).distinct().withColumn("up", F.lit(1))
    more = F.col("more") + F.coalesce(F.col("up"), (F.col("part") >= F.col("weight")).cast("int"))
    out = dealt.join(ups, "key", "left").withColumn("more", more).withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    copies = (F.col("whole") + (F.col("n") <= F.col("more")).cast("int")).cast("int")
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(0).alias("copies"))


def take_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs, all columns, with each row repeated as often as the mix takes it. Rows of one id, source and size have the copies of all of them, dealt evenly."""
    col = lambda c: F.col("`" + c.replace("`", "``") + "`")
    once = mixed.groupBy(F.col(id_col).alias("id"), F.col("source").alias("source"), F.col("size").alias("size")).agg(F.sum("copies").alias("all"), F.count("*").alias("rows")).where(F.col("all") > 0)
    rows = docs.select(F.struct(*map(col, docs.columns)).alias("row"), col(id_col).alias("d_id"), col("source").alias("d_source"), F.size(words(col("text"))).cast("long").alias("d_size"))
    rows = rows.join(once, F.col("d_id").eqNullSafe(F.col("id")) & F.col("d_source").eqNullSafe(F.col("source")) & (F.col("d_size") == F.col("size")))
    nth = F.when(F.col("rows") > 1, F.row_number().over(Window.partitionBy("d_id", "d_source", "d_size").orderBy("d_id"))).otherwise(1)  # by the join's own keys
    rows = rows.withColumn("copies", (F.floor(F.col("all") / F.col("rows")) + (nth <= F.col("all") % F.col("rows")).cast("int")).cast("int"))
    rows = rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("n"))
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
