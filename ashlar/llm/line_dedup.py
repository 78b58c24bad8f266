"""Line dedup by a log-template tree.

A line's path in the tree of fixed depth is its token count and its leading
tokens; tokens with a digit are variable fields. The line with its fields
generalised is its template. Templates of one leaf are alike if ``share``
percent of all their positions or more are equal, wherever they differ. A line
is boilerplate if its template or templates alike are found in ``min_docs``
documents or more: it is dropped in all documents but the first (smallest id)
of these. Being alike isn't passed on from template to template. DataFrame
functions only; texts are shuffled once, to be rewritten.

All pairs that are alike are found: with at most m unequal positions one of
m + 1 runs of positions is equal, so that templates meet by the hashes of these
runs, and their positions are then compared. Each is compared with the first of
its buckets; what this leaves open, with all before it there, up to a match.

Lines with fewer than ``min_tokens`` constant tokens say too little to be
generalised. Their fate depends on how often they recur: one that has a letter
and is found token for token, digits too, in ``short_docs`` documents or more is
dropped in all but the first; others stay.

Defined cases: null text stays null, empty text stays empty; a line that
repeats within one document only stays; rows that repeat an id are one document;
rows without an id keep all their lines and count for nothing;
an empty table gives an empty table; other columns are kept, whatever their
names, but for those named like a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.lineage import cut
from ashlar.llm.text import SPACE, WORD

FIELD = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"
MASK = "<*>"
SHARE = 70
SHORT_DOCS = 10


def line_templates(docs: DataFrame, id_col: str, depth: int, min_tokens: int) -> DataFrame:
    """id, at (the line's place), leaf, exact (template key) and t (hashed tokens; null for short lines, whose key is that of the line as it is)."""
    lines = docs.where(F.col("text").isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    # most lines have no digit
    line = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", FIELD, MASK)).otherwise(F.col("line"))
    tokens = lines.where(F.col("line").rlike(WORD)).select("id", "at", "line", F.array_remove(F.split(line, SPACE), "").alias("t"))
    tokens = tokens.withColumn("n", F.size("t")).withColumn("short", F.size(F.array_remove("t", MASK)) < min_tokens)
    tokens = tokens.where(~F.col("short") | F.col("line").rlike(r"\p{L}"))
    key = F.when(F.col("short"), F.xxhash64(F.lit("short"), F.array_remove(F.split("line", SPACE), ""))).otherwise(F.xxhash64("n", F.xxhash64("t")))
    return tokens.select("id", "at", F.xxhash64(F.col("n"), F.slice("t", 1, depth)).alias("leaf"), key.alias("exact"), F.when(~F.col("short"), F.transform("t", lambda x: F.hash(x))).alias("t"))


def run_keys(depth: int, share: int) -> Column:
    """Keys of the leaf and one run of positions each: templates of one leaf that are alike have one in common at least."""
    n = F.size("t")
    runs = F.floor(n * (100 - share) / 100).cast("int") + 1
    rest = F.greatest(n - depth, F.lit(0))
    edge = lambda i: (F.floor(rest.cast("long") * i / runs)).cast("int")
    return F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.xxhash64(F.col("leaf"), i, F.slice("t", edge(i) + depth + 1, edge(i + 1) - edge(i))))


def alike(a: str, b: str, share: int) -> Column:
    """Whether share percent of the positions are equal; the token counts are."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return (F.size(a) == F.size(b)) & (100 * equal >= share * F.size(a))


def not_first(templates: DataFrame, met: DataFrame, share: int) -> DataFrame:
    """exact: the templates with one alike in an earlier document. templates: exact, first, t; met: exact, first, key."""
    bucket = met.groupBy("key").agg(F.min(F.struct("first", "exact")).alias("lead"), F.max("first").alias("last"), F.count("*").alias("size")).where("lead.first < last")
    bucket = cut(bucket.select("key", F.col("lead.exact").alias("lead"), F.col("lead.first").alias("begin"), "size"), "template-buckets")
    later = met.join(bucket, "key").where("first > begin")
    side = lambda exact, t: templates.select(F.col("exact").alias(exact), F.col("t").alias(t))
    stars = later.select("exact", "lead").distinct().join(side("lead", "b"), "lead").join(templates.select("exact", "t"), "exact")
    found = cut(stars.where(alike("t", "b", share)).select("exact").distinct(), "like-first")

    # these are like none of their buckets' first; one match among the others before them is enough
    open_ = later.where("size > 2").select("key", "exact", F.col("first").alias("own")).join(found, "exact", "left_anti")
    open_ = cut(open_.join(templates.select("exact", "t"), "exact"), "open-templates")
    others = met.join(open_.select("key").distinct(), "key", "left_semi").join(templates.select("exact", F.col("t").alias("b")), "exact").select("key", "first", "b")
    more = open_.join(others, (open_["key"] == others["key"]) & (F.col("first") < F.col("own")) & alike("t", "b", share), "left_semi")
    return found.union(more.select("exact")).distinct()


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", depth: int = 3, min_tokens: int = 5, min_docs: int = 2, share: int = SHARE, short_docs: int = SHORT_DOCS) -> DataFrame:
    """id and the sorted places (from 0) of the lines to drop."""
    lines = cut(line_templates(docs, id_col, depth, min_tokens), "lines")

    def recurring(rows: DataFrame, least: int) -> DataFrame:
        """exact and first: the keys of rows (exact, id) found in so many documents, and the first of these."""
        return rows.distinct().groupBy("exact").agg(F.min("id").alias("first"), F.count("id").alias("docs")).where(F.col("docs") >= least).select("exact", "first")

    short = recurring(lines.where("t is null").select("exact", "id"), short_docs)
    long = lines.where("t is not null").select("id", "at", "leaf", "exact")
    ends = cut(long.groupBy("exact").agg(F.min("id").alias("first"), F.max("id").alias("final"), F.first("leaf").alias("leaf")), "exact-templates")
    leaves = ends.groupBy("leaf").agg(F.min("first").alias("a"), F.max("final").alias("b"), F.count("*").alias("templates")).where("a < b and templates > 1").select("leaf")
    shared = ends.join(leaves, "leaf", "left_semi").select("exact", "first", "leaf")
    tokens = lines.where("t is not null").join(leaves, "leaf", "left_semi").groupBy("exact").agg(F.first("t").alias("t"))
    templates = cut(shared.join(tokens, "exact"), "templates")
    met = cut(templates.select("exact", "first", F.explode(run_keys(depth, share)).alias("key")), "template-runs")
    if min_docs > 2:
        other = met.select(F.col("exact").alias("other"), "key")
        pairs = met.select("exact", "key").join(other, "key").where("exact <> other").select("exact", "other").distinct()
        pairs = pairs.join(templates.select("exact", "t"), "exact").join(templates.select(F.col("exact").alias("other"), F.col("t").alias("b")), "other").where(alike("t", "b", share))
        among = long.select(F.col("exact").alias("other"), "id").join(pairs.select("exact", "other"), "other").select("exact", "id")
        firsts = recurring(long.select("exact", "id").union(among), min_docs).select("exact", "first", F.lit(False).alias("all"))
    else:
        like = not_first(templates, met, share).withColumn("all", F.lit(True))
        firsts = ends.join(like, "exact", "left").where("first < final or all").select("exact", "first", F.coalesce("all", F.lit(False)).alias("all"))
    firsts = firsts.union(short.select("exact", "first", F.lit(False).alias("all")))
    drop = lines.select("id", "at", "exact").join(firsts, "exact").where("all or id <> first").select("id", "at")
    return drop.groupBy("id").agg(F.sort_array(F.collect_set("at")).alias("drop"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", depth: int = 3, min_tokens: int = 5, min_docs: int = 2, share: int = SHARE, short_docs: int = SHORT_DOCS) -> DataFrame:
    """docs with recurring lines dropped from text, plus __lines and __dropped (numbers of lines)."""
    kept = [c for c in docs.columns if c not in ("__lines", "__dropped")]
    col = lambda c: F.col("`" + c.replace("`", "``") + "`")
    texts = docs.select(col(id_col).alias("id"), col("text").alias("text"))
    drop = recurring_lines(texts, "id", depth, min_tokens, min_docs, share, short_docs)
    rows = docs.select(F.struct(*(col(c) for c in kept)).alias("row"), col(id_col).alias("id"))
    rows = rows.join(drop, "id", "left").withColumn("lines", F.split(F.col("row")["text"], "\n"))  # after the join: texts are shuffled once
    keep = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop")
    text = F.when(F.col("drop").isNull(), F.col("row")["text"]).otherwise(F.array_join(F.transform(keep, lambda i: F.col("lines")[i]), "\n"))
    counts = F.when(F.col("lines").isNotNull(), F.size("lines")).otherwise(0).cast("long"), F.coalesce(F.size("drop"), F.lit(0)).cast("long")
    return rows.select(*((text if c == "text" else F.col("row").getField(c)).alias(c) for c in kept), counts[0].alias("__lines"), counts[1].alias("__dropped"))
