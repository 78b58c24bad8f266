"""A training corpus in five stages, each of them one operator over all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. Nulls, empty tables and repeated rows
have the results that the operators state. An id stands for all rows that carry
it; near-dedup keeps one row of each id, that of the text with the greatest
hash, and all rows without an id. Other columns of the input aren't read.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.lineage import cut
from ashlar.llm.bpe import encode_decode
from ashlar.llm.line_dedup import line_dedup
from ashlar.llm.mixing import mix, take_mix
from ashlar.llm.near_dedup import near_dedup
from ashlar.llm.quality_rules import quality_rules
from ashlar.llm.text import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """docs but for the ids that are not kept."""
    return docs.join(judged.where(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject."""
    row = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("row"))  # so that rows of one id, or of none, are judged on their own
    rejected = quality_rules(row, "row").where(~F.col("kept")).select("row").distinct()
    return row.join(rejected, "row", "left_anti").select(COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines of templates that recur across documents; n_chars follows."""
    out = line_dedup(docs.select(COLUMNS)).select(COLUMNS)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    kept = _without(docs.select(COLUMNS), near_dedup(docs, k=5))
    rest = [c for c in COLUMNS if c != "doc_id"]
    one = kept.where("doc_id is not null").groupBy("doc_id").agg(F.max_by(F.struct(*rest), F.struct(F.xxhash64("text"), F.xxhash64(*rest))).alias("r"))
    return one.select("doc_id", "r.*").select(COLUMNS).unionByName(kept.where("doc_id is null"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return take_mix(docs.select(COLUMNS), mix(docs))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, a row for each copy."""
    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality_stage), ("line dedup", line_stage), ("near-dedup", near_stage), ("mixing", mix_stage), ("byte-level BPE", bpe_stage)]

#: SQL can't express MinHash components, the covariance estimates or BPE; tests/llm/test_pipeline.py compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name.replace(" ", "-"))
    return docs
