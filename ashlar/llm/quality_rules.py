"""Quality rules: base limits, then robust multivariate outliers.

Each (language, source) group gets a minimum-covariance-determinant estimate of
the centre and scatter of its transformed document statistics. A document is
rejected when its Mahalanobis distance from its group's estimate is beyond the
cutoff. DataFrame functions only: texts are read once, in place; what is
shuffled are sums over groups.

Defined cases: null or empty text has no words and fails the base limits; null
languages and sources are groups of their own; a group with fewer than
``min_group`` documents is judged by its language, or by all documents where
the language is small too; repeated rows are judged alike; an empty table gives
an empty table; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.lineage import cut
from ashlar.llm.text import WORD, words

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
#: Least spread of each statistic: added to the scatter's diagonal, so that a statistic which is constant in a group doesn't reject all that differs.
FLOORS = (0.7, 0.8, 0.10, 0.12, 0.15, 0.10)
P = len(FLOORS)
#: Chi-square quantiles for six statistics, with the factors that make the scatter of a central share consistent.
SHARE, SHARE_FACTOR = 0.75, 1.361
REWEIGHT, REWEIGHT_FACTOR = 14.45, 1.049
CUTOFF = 27.86
#: Bits of a long that hold a window's place; texts with more windows take a slower path.
PLACE_BITS = 20


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base statistics, and __upper (upper-case letters) and __lines (lines with a word).

    Write the result (cut) before filtering on it or using a statistic twice:
    where Spark copies these expressions into a filter it evaluates them again.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    step = docs.withColumn("__words", words(F.col(text))).withColumn("__lines", F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD)))
    n = F.size("__words")
    step = step.withColumn("__h", F.when(n >= 4, F.slice(F.transform("__words", lambda x, i: F.xxhash64(x, F.get("__words", i + 1), F.get("__words", i + 2))), F.lit(1), F.greatest(n - 2, F.lit(0)))))
    # equal windows stand side by side after sorting; hash and place share one long, the rest of the hash is compared after
    low, m = F.lit(2**PLACE_BITS - 1), F.size("__h")
    packed = F.sort_array(F.transform("__h", lambda x, i: x.bitwiseAND(F.lit(-(2**PLACE_BITS))).bitwiseOR(i.cast("long"))))
    pairs = F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    twice = F.size(F.array_distinct("__h")) < m
    step = step.withColumns({"__packed": F.when(twice & (m < 2**PLACE_BITS), packed), "__pairs": F.when(twice & (m >= 2**PLACE_BITS), pairs)})
    full = lambda x: F.get("__h", x.bitwiseAND(low).cast("int"))
    equal = lambda x, y: (F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS)) & (full(x) == full(y))
    short = F.transform(F.filter("__packed", lambda x, k: equal(x, F.get("__packed", k - 1)) | equal(x, F.get("__packed", k + 1))), lambda x: x.bitwiseAND(low).cast("int"))
    long = F.transform(F.filter("__pairs", lambda x, k: (F.get("__pairs", k - 1)["h"] == x["h"]) | (F.get("__pairs", k + 1)["h"] == x["h"])), lambda x: x["i"])
    step = step.withColumn("__at", F.sort_array(F.coalesce(short, long)))
    covered = F.aggregate("__at", F.struct(F.lit(0).alias("c"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["c"] + F.least(F.lit(3), i - a["last"])).alias("c"), i.alias("last")))["c"]
    step = step.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "__upper": F.regexp_count(body, F.lit(r"\p{Lu}")).cast("long"),
        "__lines": F.size("__lines").cast("long"),
    }).drop("__words", "__h", "__packed", "__pairs", "__at")
    return step.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vector() -> list[Column]:
    """The transformed statistics; meaningful where n_words is not 0."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log1p(n),
        F.col("word_chars") / n,
        F.sqrt(F.col("n_symbols") / n),
        F.col("n_dup_lines") / F.greatest(F.col("__lines"), F.lit(1)),
        F.col("n_repeat_words") / n,
        F.sqrt(F.col("__upper") / F.greatest(F.col("word_chars"), F.lit(1))),
    ]


X = [f"x{i}" for i in range(P)]
M = [f"m{i}" for i in range(P)]


def with_distance(rows: DataFrame) -> DataFrame:
    """d2: squared Mahalanobis distance, by forward substitution through the group's Cholesky factor."""
    for i in range(P):
        rest = F.col(X[i]) - F.col(M[i])
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        rows = rows.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, P)), F.col("y0") * F.col("y0"))).drop(*(f"y{i}" for i in range(P)))


def moments(rows: DataFrame, keys: Sequence[str], factor: float) -> DataFrame:
    """Per group: centre, Cholesky factor of the floored scatter, and its log-determinant."""
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    out = rows.groupBy(*keys).agg(*(F.avg(X[i]).alias(M[i]) for i in range(P)), *(F.covar_pop(X[i], X[j]).alias(f"c{i}{j}") for i, j in pairs))
    for i, j in pairs:
        out = out.withColumn(f"c{i}{j}", F.coalesce(F.col(f"c{i}{j}"), F.lit(0.0)) * factor + (FLOORS[i] ** 2 if i == j else 0.0))
    for j in range(P):
        rest = F.col(f"c{j}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[j] ** 2 / 100))))
        for i in range(j + 1, P):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", rest / F.col(f"l{j}{j}"))
    return out.withColumn("logdet", sum((F.log(f"l{i}{i}") for i in range(1, P)), F.log("l00"))).drop(*(f"c{i}{j}" for i, j in pairs))


def estimates(stats: DataFrame, steps: int = 3, min_group: int = 50) -> tuple[DataFrame, DataFrame]:
    """(group estimates by key g, key g of each (lang, source)).

    stats: lang, source, x0.., of documents that passed the base limits. Two
    starts for each group, the quartile box and a random half, are carried
    through concentration steps; the lower determinant wins and is reweighted.
    """
    spark = stats.sparkSession
    sizes = stats.groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = sizes.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.min("n").alias("least"))
    sizes = sizes.join(by_lang, sizes["lang"].eqNullSafe(by_lang["lang"])).drop(by_lang["lang"])
    key = lambda level, *cols: F.to_json(F.struct(F.lit(level).alias("level"), *cols))
    own, lang, every = key(0, F.col("lang"), F.col("source")), key(1, F.col("lang")), key(2)
    small, lone = F.col("n") < min_group, F.col("lang_n") < min_group
    groups = cut(sizes.select("lang", "source", F.when(~small, own).when(~lone, lang).otherwise(every).alias("g"), F.array_compact(F.array(F.when(~small, own), F.when((F.col("least") < min_group) & ~lone, lang), every)).alias("into")), "mcd-groups")
    used = groups.select("g").distinct()
    near = [stats["lang"].eqNullSafe(groups["lang"]), stats["source"].eqNullSafe(groups["source"])]
    rows = stats.join(groups, near).select(F.explode("into").alias("g"), "h", *X)
    rows = cut(rows.join(used, "g", "left_semi"), "mcd-rows")

    # start 0: quartiles, one by one; start 1: a random half
    quart = rows.groupBy("g").agg(*(F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"q_{x}") for x in X))
    box = quart.select("g", F.lit(0).alias("start"), *(F.col(f"q_{x}")[1].alias(m) for x, m in zip(X, M, strict=True)), *((F.sqrt(F.pow((F.col(f"q_{X[i]}")[2] - F.col(f"q_{X[i]}")[0]) / 1.349, 2) + FLOORS[i] ** 2) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(P) for j in range(i + 1)))
    half = moments(rows.where(F.pmod("h", F.lit(2)) == 0).withColumn("start", F.lit(1)), ["g", "start"], 1.0).select(box.columns)
    fit = cut(box.unionByName(half), "mcd-start")
    for _ in range(steps):
        far = with_distance(rows.join(fit, "g")).select("g", "start", "d2", *X)
        edge = cut(far.groupBy("g", "start").agg(F.percentile_approx("d2", SHARE, 1000).alias("edge")), "mcd-edge")
        fit = cut(moments(far.join(edge, ["g", "start"]).where("d2 <= edge"), ["g", "start"], SHARE_FACTOR), "mcd-step")
    best = fit.groupBy("g").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    fit = fit.join(best, ["g", "start"]).drop("start", "logdet")
    near = with_distance(rows.join(fit, "g")).where(F.col("d2") <= REWEIGHT)
    return cut(moments(near, ["g"], REWEIGHT_FACTOR).drop("logdet"), "mcd"), groups.select("lang", "source", "g")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", cutoff: float = CUTOFF, min_group: int = 50) -> DataFrame:
    """One row for each row of docs: id_col, the base statistics, base_failed, distance (null where base_failed) and kept.

    docs: id_col, text, lang, source. kept is false where base_failed, else
    whether the squared distance is at most cutoff.
    """
    stats = base_statistics(docs.select(id_col, "text", "lang", "source"))
    stats = cut(stats.select(id_col, "lang", "source", *BASE, *(c.alias(x) for c, x in zip(vector(), X, strict=True))), "quality-statistics")
    passed = stats.where(~F.col("base_failed")).select("lang", "source", *X, F.xxhash64(id_col, *X).alias("h"))
    fit, groups = estimates(passed, min_group=min_group)
    groups = cut(groups.join(fit, "g").drop("g"), "mcd-by-source")
    near = [stats["lang"].eqNullSafe(groups["lang"]), stats["source"].eqNullSafe(groups["source"])]
    out = with_distance(stats.join(groups, near, "left").drop(groups["lang"], groups["source"]))
    distance = F.when(~F.col("base_failed"), F.col("d2"))
    return out.select(id_col, *BASE, distance.alias("distance"), (~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))).alias("kept"))
