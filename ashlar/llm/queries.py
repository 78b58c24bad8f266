"""The numbered queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.llm.ann import nearest
from ashlar.llm.bpe import encode_decode
from ashlar.llm.conversation_trie import conversation_trie
from ashlar.llm.lattice_lm import lattice_lm
from ashlar.llm.line_dedup import line_dedup
from ashlar.llm.main_text import extract
from ashlar.llm.mixing import mix
from ashlar.llm.near_dedup import near_dedup
from ashlar.llm.quality_classifier import quality_scores
from ashlar.llm.quality_rules import quality_rules
from ashlar.llm.secret_scan import secret_scan, span_digest
from ashlar.llm.text import table
from ashlar.llm.token_align import token_align
from ashlar.llm.token_records import token_records


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    out = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(table(spark, sf_dir, "documents"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = {f"n_{k}": (F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long") for k in ("assign", "access", "hex")}
    digest = F.sha2(span_digest(["assign", "access", "hex"]), 256)
    return out.select("doc_id", *(c.alias(n) for n, c in counts.items()), digest.alias("base_sha256"), span_digest().alias("spans"))


def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    out = lattice_lm(table(spark, sf_dir, "documents"), ~held_out, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), k=2)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2("text", 256).alias("text_sha256"), "text")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"), block=100)


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_mixing, op3_main_text, op4_ann, op5_quality_classifier, op6_secret_scan, op7_lattice_lm, op8_bpe, op9_near_dedup, op10_line_dedup, op11_conversation_trie, op12_token_align, op13_token_records)}

#: Every node by its sequence of turns; crc32 bit by bit, as DuckDB has none.
TRIE_SQL = """
with bytes as (select distinct conv_id, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint) as b from conversations where conv_id is not null),
heads as (select conv_id, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 6 as h from bytes),
own as (select conv_id, list({'k': md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')), 'n': length(coalesce(text, ''))} order by turn nulls first) as t from conversations where conv_id is not null group by 1),
built as (select o.conv_id, list_concat(coalesce(b.t, [])[1:h], o.t[h + 1:]) as t from own o join heads using (conv_id) left join own b on b.conv_id = o.conv_id - o.conv_id % 100),
seqs as (select conv_id, list_transform(t, lambda x: x.k) as k, list_transform(t, lambda x: x.n) as n from built),
prefixes as (select conv_id, k[1:d] as p, d, coalesce(n[d], 0) as n, len(k) = d as ends from (select *, unnest(range(0, len(k) + 1)) as d from seqs)),
nodes as (select p, d, min(conv_id) as conv_id, count(*) as n_convs, max(n) as n, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256 from prefixes group by p, d),
children as (select p[1:d - 1] as p, count(*) as n_children from nodes where d > 0 group by 1),
full_ as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join children using (p)),
above as (select p[1:e] as p, case when n_children = 0 then 1 else 0 end as leaf, (n_convs - 1) * n as saved from (select *, unnest(range(0, d + 1)) as e from full_)),
sums as (select p, sum(leaf)::bigint as n_leaves, sum(saved)::bigint as saved_tokens from above group by 1)
select f.conv_id, f.d as depth, u.conv_id as parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256 from full_ f join sums using (p) left join nodes u on u.p = f.p[1:f.d - 1] and u.d = f.d - 1
"""
ORACLE_SQL: dict[str, str] = {"op11_conversation_trie": TRIE_SQL}
