"""Text and vector retrieval."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ashlar.lineage import cut
from ashlar.operators.neighbours import knn_in_cells


def postings(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, term, tf, len: lower-cased ASCII word tokens."""
    terms = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), terms.alias("t"))
    return rows.select("id", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, terms: list[str], k: int, n_docs: int, mean_len: float, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, score: the k best by BM25; ties go to the smaller id. index: from postings()."""
    hits = index.where(F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / mean_len))
    scored = hits.join(df, "term").groupBy("id").agg(F.round(F.sum(idf * tf), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def bm25_docs(docs: DataFrame, id_col: str, fields: dict[str, float], terms: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, score: the k best by BM25, summed over text fields with their boosts; ties go to the smaller id. terms: of a-z and 0-9.

    Every field is read once and reduced to its length and the counts of
    the asked terms; these small rows are kept, and the collection's figures are
    sums over them. Nothing is exploded.
    """
    columns = []
    for name in fields:
        body = F.lower(F.coalesce(F.col(name), F.lit("")))
        times = [F.when(F.contains(body, F.lit(t)), F.regexp_count(body, F.lit(f"(?<![a-z0-9]){t}(?![a-z0-9])"))).otherwise(0) for t in terms]
        columns.append(F.array(F.regexp_count(body, F.lit("[a-z0-9]+")), *times).alias(f"_{name}"))
    small = cut(docs.select(F.col(id_col).alias("id"), *columns), "bm25")
    sums = small.agg(F.count("*"), *(f for name in fields for f in (F.avg(F.col(f"_{name}")[0]), *(F.count_if(F.col(f"_{name}")[i + 1] > 0) for i in range(len(terms)))))).first()
    n, rest = sums[0], iter(sums[1:])
    score = F.lit(0.0)
    hit = F.lit(False)
    for name, boost in fields.items():
        mean = next(rest) or 1.0
        length = F.col(f"_{name}")[0]
        for i in range(len(terms)):
            df, tf = next(rest), F.col(f"_{name}")[i + 1]
            idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
            score = score + F.lit(boost * idf * (k1 + 1)) * tf / (tf + k1 * (1 - b + b * length / mean))
            hit = hit | (tf > 0)
    return small.where(hit).select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def snippet(text: Column, terms: list[str], around: int = 30) -> Column:
    """The passage around the first term that is met, with the terms marked; null without a hit."""
    any_of = "|".join(terms)
    passage = F.regexp_extract(text, rf"(?is)(.{{0,{around}}}\b(?:{any_of})\b.{{0,{around}}})", 1)
    return F.when(passage != "", F.regexp_replace(passage, rf"(?i)\b({any_of})\b", "[$1]"))


def retrieve(changes: DataFrame, path: str, seq: str, text: str, queries: DataFrame, k: int, dim: int = 256) -> DataFrame:
    """query_id, path, score: the k nearest documents of each query, by hashed embeddings, in the index after all file changes.

    changes: added, edited (a later text) and removed (null text) files;
    documents without a word are no part of the index. queries: query_id, text.
    """
    from ashlar.operators.vectors import hash_embed

    now = changes.groupBy(path).agg(F.max_by(text, seq).alias("text")).where(F.col("text").rlike("[A-Za-z0-9]"))
    docs = hash_embed(now.select(F.col(path).alias("path"), "text"), "path", "text", dim)
    asked = hash_embed(queries.select(F.col("query_id").cast("string").alias("path"), "text"), "path", "text", dim)
    return knn_many(docs, asked, "path", "vector", k)


def rrf(lists: list[DataFrame], k: int, c: int = 60) -> DataFrame:
    """id, score: reciprocal-rank fusion of lists of (id, rank)."""
    every = lists[0]
    for x in lists[1:]:
        every = every.unionByName(x)
    return every.groupBy("id").agg(F.round(F.sum(1.0 / (c + F.col("rank"))), 9).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def chunk(df: DataFrame, id_col: str, text: str, most: int, overlap: int) -> DataFrame:
    """id, chunk_no, chunk: runs of at most most words that overlap."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    rows = df.select(F.col(id_col), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - overlap - 1, F.lit(0)), F.lit(most - overlap))
    return rows.select(id_col, "w", F.posexplode(starts).alias("chunk_no", "s")).select(id_col, "chunk_no", F.array_join(F.slice("w", F.col("s") + 1, F.lit(most)), " ").alias("chunk"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def knn(base: DataFrame, id_col: str, vector: str, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """The k nearest to one vector by cosine, filtered before ranking; ties go to the smaller id. Null and zero vectors have no score and are left out."""
    rows = base if where is None else base.where(where)
    score = cosine(F.col(vector), F.array(*(F.lit(float(x)) for x in query)))
    return rows.select(id_col, score.alias("score")).where("score is not null").orderBy(F.desc("score"), id_col).limit(k)


def knn_many(base: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int, where: Column | None = None, block: int = 4000, metric: str = "cosine") -> DataFrame:
    """query_id, id_col, score: the k nearest of each query among base, filtered before ranking, by unrounded scores in double precision; ties go to the smaller id.

    metric: cosine, or l2, whose score is the distance's negative. Vectors that
    are null, zero or not finite are left out. Only cells of base that may hold one
    of a query's k nearest are searched: see neighbours.knn_in_cells().
    """
    return knn_in_cells(base if where is None else base.where(where), queries, id_col, vector, k, block, metric)[0]


def recall_at_k(found: DataFrame, truth: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """recall: the mean share of each query's k true items that were found."""
    hits = truth.join(found.select(query, item).distinct(), [query, item], "left_semi").groupBy(query).agg((F.count("*") / k).alias("r"))
    return truth.select(query).distinct().join(hits, query, "left").agg(F.avg(F.coalesce("r", F.lit(0.0))).alias("recall"))


def ranked(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The k first rows with their rank: only the k rows are ranked."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def match(text: str | Column, terms: list[str], mode: str = "any") -> Column:
    """Whether a text has any of the terms, all of them, or all in a row (phrase)."""
    col = F.col(text) if isinstance(text, str) else text
    if mode == "phrase":
        return col.contains(" ".join(terms))
    out = col.contains(terms[0])
    for t in terms[1:]:
        out = (out | col.contains(t)) if mode == "any" else (out & col.contains(t))
    return out


def fuzzy(index: DataFrame, asked: str, most: int = 2, id_col: str = "id", term: str = "term") -> DataFrame:
    """Entries of an index (id_col, term) whose term is within an edit distance; each distinct term is compared once."""
    near = index.select(term).distinct().where(F.levenshtein(term, F.lit(asked)) <= most)
    return index.select(id_col, term).distinct().join(near, term, "left_semi").select(id_col, term)


def deletions(term: Column, most: int) -> Column:
    """The distinct strings that are left of a term with up to most characters deleted."""
    shorter = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    level = every = F.array(term)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(F.filter(level, lambda t: F.length(t) > 0), shorter)))
        every = F.concat(every, level)
    return F.array_distinct(every)


def fuzzy_many(dictionary: DataFrame, asked: DataFrame, most: int = 2, term: str = "term", lead: int = 16) -> DataFrame:
    """asked, term: the distinct pairs of an asked term and a term of the dictionary within an edit distance.

    Two such terms have a string in common that either is left with after most
    deletions, and so have their first lead characters; candidates meet by an
    equi join on these strings, the distance is taken of candidates only. A term
    has about lead squared / 2 strings, whatever its length. Null terms meet none.
    """
    keys = lambda df, name: df.where(F.col(term).isNotNull()).select(F.col(term).alias(name)).distinct().select(name, F.explode(deletions(F.substring(F.col(name), 1, lead), most)).alias("_k"))
    met = keys(asked, "asked").join(keys(dictionary, "term"), "_k").select("asked", "term").distinct()
    return met.where(F.levenshtein("asked", "term") <= most)


def search_analytics(facts: DataFrame, items: DataFrame, on: Column, matches: Column, keys: list[str], *aggs: Column) -> DataFrame:
    """Aggregates of the facts whose item a search matched."""
    return facts.join(items.where(matches), on).groupBy(*keys).agg(*aggs)
