"""Row rules, column checks and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ashlar.functions import first_match


def validate(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with the first failing reason); rules are (reason, condition that fails)."""
    marked = df.withColumn("reason", first_match([(n, F.coalesce(c, F.lit(False))) for n, c in rules]))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def check_columns(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, failures, passed: all checks in one pass; a null outcome fails."""
    row = df.agg(F.array(*(F.struct(F.lit(n).alias("check"), F.count_if(~F.coalesce(c, F.lit(False))).alias("failures")) for n, c in checks.items())).alias("r"))
    return row.select(F.explode("r").alias("r")).select("r.*", (F.col("r.failures") == 0).alias("passed"))


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def sequence_audit(df: DataFrame, part: str, seq: str) -> DataFrame:
    """Per part: rows, first, last, gaps and missing numbers."""
    step = F.col(seq) - F.lag(seq).over(Window.partitionBy(part).orderBy(seq))
    return df.withColumn("_step", step).groupBy(part).agg(F.count("*").alias("n"), F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.count_if(F.col("_step") > 1).alias("gaps"), F.coalesce(F.sum(F.when(F.col("_step") > 1, F.col("_step") - 1)), F.lit(0)).alias("missing"))


def delivery_audit(sent: DataFrame, received: DataFrame, key: str) -> DataFrame:
    """sent, received, distinct, duplicates, missing."""
    r = received.agg(F.count("*").alias("received"), F.count_distinct(key).alias("distinct_received"))
    s = sent.agg(F.count("*").alias("sent"))
    missing = sent.join(received, key, "left_anti").agg(F.count("*").alias("missing"))
    return s.crossJoin(r).crossJoin(missing).withColumn("duplicates", F.col("received") - F.col("distinct_received"))  # one row each


def assert_none(df: DataFrame, wrong: Column) -> DataFrame:
    """Rows that violate a rule: none is a pass. A rule that is null of a row doesn't hold for it."""
    return df.where(F.coalesce(wrong, F.lit(True)))


def invariants(checks: dict[str, DataFrame]) -> DataFrame:
    """invariant, violations, holds. checks: for each invariant, the rows that break it."""
    counts = [df.agg(F.count("*").alias("violations")).withColumn("invariant", F.lit(n)) for n, df in checks.items()]
    return reduce(DataFrame.unionByName, counts).withColumn("holds", F.col("violations") == 0)


def offset_audit(df: DataFrame, part: list[str], offset: str) -> DataFrame:
    """Per part: low, high, rows, distinct offsets, missing and repeated ones, and the verdict."""
    out = df.groupBy(*part).agg(F.min(offset).alias("low"), F.max(offset).alias("high"), F.count("*").alias("n"), F.count_distinct(offset).alias("ids"))
    out = out.withColumns({"missing": F.col("high") - F.col("low") + 1 - F.col("ids"), "repeated": F.col("n") - F.col("ids")})
    return out.withColumn("verdict", F.when(F.col("repeated") > 0, "duplicates").when(F.col("missing") > 0, "gaps").otherwise("continuous"))


def duplicate_epochs(commits: DataFrame, query: str, epoch: str) -> DataFrame:
    """Commits of one query and epoch that were made twice or more, with the rows that these add."""
    return commits.groupBy(query, epoch).agg(F.count("*").alias("commits"), (F.sum("rows") - F.max("rows")).alias("extra_rows")).where("commits > 1")


def compat_audit(old: DataFrame, new: DataFrame, old_schema: dict[str, tuple[str, bool]], new_schema: dict[str, tuple[str, bool]]) -> DataFrame:
    """reader, field, missing, unreadable, verdict: stored rows (all strings) that the other side's schema can't read.

    Schemas are name: (type, required). BACKWARD: the new schema reads the old
    rows; FORWARD: the old one reads the new rows; FULL: both; NONE. One pass a side.
    """

    def failures(rows: DataFrame, schema: dict[str, tuple[str, bool]], reader: str) -> DataFrame:
        have = set(rows.columns)
        value = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
        cells = [F.struct(F.lit(reader).alias("reader"), F.lit(c).alias("field"), F.count_if(value(c).isNull() & F.lit(required)).alias("missing"), F.count_if(value(c).isNotNull() & value(c).try_cast(kind).isNull()).alias("unreadable")) for c, (kind, required) in schema.items()]
        return rows.agg(F.array(*cells).alias("c")).select(F.inline("c"))

    both = failures(old, new_schema, "new").unionByName(failures(new, old_schema, "old"))
    bad = F.sum(F.when(F.col("reader") == "new", F.col("missing") + F.col("unreadable")).otherwise(0)).over(Window.partitionBy()), F.sum(F.when(F.col("reader") == "old", F.col("missing") + F.col("unreadable")).otherwise(0)).over(Window.partitionBy())  # a row a field
    verdict = F.when((bad[0] == 0) & (bad[1] == 0), "FULL").when(bad[0] == 0, "BACKWARD").when(bad[1] == 0, "FORWARD").otherwise("NONE")
    return both.withColumn("verdict", verdict)
