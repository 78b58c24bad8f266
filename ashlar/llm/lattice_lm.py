"""LM scoring: subword lattice likelihood.

A word's probability is the sum over all its segmentations. The lattice's arcs
are the pieces of an existing unigram vocabulary, byte pieces for what no piece
covers, and one arc for the whole word, with the word's count in the training
documents. A forward recursion in log space sums the paths. A text's
probability is the product over its words and one end.

The vocabulary's scores are the prior of the pieces' weights. They are
re-estimated once from the training documents: the expected count of each piece
over all segmentations (forward and backward) of each word that is seen once,
as new words are like those, plus ``prior`` counts shared by the scores.

Words are scored once each: the corpus's words are counted by Spark, the
lattice runs over the distinct words, and the values come back to the texts by
a join. The commonest words, a bounded number of them above a count that a
histogram gives, are sent to all tasks instead, so that only rare words are
shuffled.

Defined cases: null and empty texts are one end; characters outside the
vocabulary are spelled by byte pieces; repeated rows are texts of their own; an
empty table gives an empty table; with no training documents counts are 0 and
the scores alone weigh; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.lineage import cut
from ashlar.llm.text import words

#: Most words that are sent to all tasks, and the longest of them; counts of the scores when weights are re-estimated.
COMMON, COMMON_CHARS, PRIOR = 200_000, 64, 10_000.0
#: Words of one lattice task: few bytes, but much work.
WORDS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START = "▁"


def piece_weights(path: str, byte_share: float = 0.02) -> tuple[dict[str, float], float, float]:
    """(natural log weights of pieces, of each of the 256 bytes, of the end) from a SentencePiece model.

    Models of ranks (scores 0, -1, -2 ...) are read by Zipf's law, others as
    log-probabilities. Byte pieces share byte_share; the end weighs as the
    commonest piece.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores = {model.id_to_piece(i): model.get_score(i) for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    scores = {p: s for p, s in scores.items() if s > -1e8 and START not in p[1:]}
    if all(s <= 0 and s == int(s) for s in scores.values()):
        scores = {p: -math.log(2.7 - s) for p, s in scores.items()}
    top = max(scores.values())
    total = math.log(sum(math.exp(s - top) for s in scores.values()) + 1.0) + top  # the end included
    keep = math.log1p(-byte_share)
    return {p: s - total + keep for p, s in scores.items()}, math.log(byte_share / 256), top - total + keep


def arcs(pieces: dict[str, float]) -> dict[str, float | None]:
    """pieces and, with None, what only begins pieces."""
    out: dict[str, float | None] = {p[:i]: None for p in pieces for i in range(1, len(p))}
    return out | pieces


def log_sum(terms: list[float]) -> float:
    if len(terms) == 1:
        return terms[0]
    top = max(terms)
    return top + math.log(sum([math.exp(x - top) for x in terms]))


def forward(word: str, table: dict[str, float | None], byte: float, whole: float | None = None) -> float:
    """Natural log of the sum over all segmentations of the word into pieces of table (see arcs) and bytes, and of the whole word's arc if it has one."""
    text = START + word
    n = len(text)
    into: list[list[float] | None] = [[] for _ in range(n + 1)]  # log weights of the paths' last steps
    if whole is not None:
        into[n].append(whole)
    alpha = 0.0
    for begin in range(n):
        c = text[begin]
        into[begin + 1].append(alpha + (byte if c < "\x80" else byte * len(c.encode())))
        for end in range(begin + 1, n + 1):
            part = text[begin:end]
            if part not in table:
                break
            w = table[part]
            if w is not None:
                into[end].append(alpha + w)
        alpha = log_sum(into[begin + 1])
        into[begin] = None
    return alpha


def expected_pieces(word: str, table: dict[str, float | None], byte: float, counts: dict[str, float]) -> None:
    """Add to counts how often each piece (and byte, under "") is expected in the word's segmentations."""
    text = START + word
    n = len(text)
    alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
    into: list[list[float]] = [[] for _ in range(n + 1)]
    steps: list[list[tuple[int, str, float]]] = []  # from each place: end, piece, weight
    for begin in range(n):
        if begin:
            alpha[begin] = log_sum(into[begin])
        c = text[begin]
        found = [(begin + 1, "", byte if c < "\x80" else byte * len(c.encode()))]
        for end in range(begin + 1, n + 1):
            part = text[begin:end]
            if part not in table:
                break
            w = table[part]
            if w is not None:
                found.append((end, part, w))
        for end, _, w in found:
            into[end].append(alpha[begin] + w)
        steps.append(found)
    total = log_sum(into[n])
    for begin in range(n - 1, -1, -1):
        onward = [w + beta[end] for end, _, w in steps[begin]]
        beta[begin] = log_sum(onward)
        for (_, part, _), x in zip(steps[begin], onward, strict=True):
            times = 1 if part or text[begin] < "\x80" else len(text[begin].encode())
            counts[part] = counts.get(part, 0.0) + times * math.exp(alpha[begin] + x - total)


def learned_weights(hapaxes: DataFrame, path: str, prior: float) -> tuple[dict[str, float], float, float]:
    """(natural log weights of pieces, of each byte, of the end), re-estimated from words (word) by expected counts; the end keeps the prior's share, so that all add up to 1."""
    pieces, byte, end = piece_weights(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table: dict[str, float | None] = {}
        counts: dict[str, float] = {}
        for pdf in batches:
            if not table:
                old, old_byte, _ = piece_weights(path)
                table = arcs(old)
            for word in pdf["word"]:
                expected_pieces(word, table, old_byte, counts)
        yield pd.DataFrame({"piece": list(counts), "n": list(counts.values())}, columns=["piece", "n"]).astype({"piece": object, "n": float})

    # no more rows than the vocabulary has pieces
    sums = hapaxes.select("word").mapInPandas(run, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
    seen = dict(zip(sums["piece"], sums["n"], strict=True))
    total = sum(seen.values()) + prior
    new = {p: math.log((seen.get(p, 0.0) + prior * math.exp(w)) / total) for p, w in pieces.items()}
    return new, math.log((seen.get("", 0.0) + 256 * prior * math.exp(byte)) / total / 256), math.log(prior / total) + end


def lattice_scores(vocabulary: DataFrame, pieces: dict[str, float], byte: float, unseen: float) -> DataFrame:
    """vocabulary (word, c) with lattice: the natural log of each word's marginal over its pieces and its whole-word arc of weight c / unseen."""
    sent = vocabulary.sparkSession.sparkContext.broadcast((pieces, byte))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table: dict[str, float | None] = {}
        for pdf in batches:
            if not table:
                table = arcs(sent.value[0])
            yield pdf.assign(lattice=[forward(w, table, sent.value[1], math.log(c / unseen) if c else None) for w, c in zip(pdf["word"], pdf["c"], strict=True)])

    return vocabulary.mapInPandas(run, "word string, c long, lattice double")


def word_counts(docs: DataFrame, trains: Column) -> DataFrame:
    """word, c: the lower-cased words of all documents and their counts in those that train."""
    raw = docs.select(trains.alias("t"), F.explode(words(F.col("text"))).alias("word")).groupBy("word").agg(F.sum(F.col("t").cast("long")).alias("c"))
    return raw.groupBy(F.translate("word", UPPER, LOWER).alias("word")).agg(F.sum("c").alias("c"))


def common_count(counts: DataFrame, most: int) -> int:
    """The least count such that at most so many words have it or a greater one, by a histogram of eighths of octaves."""
    bucket = F.floor(F.log2("c") * 8).cast("int").alias("b")
    rows = counts.where("c > 0").groupBy(bucket).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("b")).collect()  # some 500 at most
    least, total = 2**62, 0
    for r in rows:
        total += r["n"]
        if total > most:
            break
        least = r["c"]
    return least


def lattice_lm(docs: DataFrame, trains: Column, path: str, id_col: str = "doc_id", common: int = COMMON, prior: float = PRIOR) -> DataFrame:
    """One row for each row of docs: id_col, n_tokens, n_known, train_tokens, base_score, score (both log10).

    trains: whether a row's text is learned from. base_score is add-one over
    words; score is the lattice's marginal probability.
    """
    spark = docs.sparkSession
    docs = docs.select(id_col, "text", F.coalesce(trains, F.lit(False)).alias("__train"))
    counts = cut(word_counts(docs, F.col("__train")), "lm-counts")
    ends = docs.agg(F.count_if("__train")).first()[0]
    tokens, types, once, all_ = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), F.count("*")).first()
    n, v = tokens + ends, types + (ends > 0)
    # whole-word arcs have the training counts; the pieces share what words seen once have, at least one token's mass
    unseen = float(max(once, 1))
    pieces, byte, end = learned_weights(counts.where("c = 1").repartition(-(-once // WORDS) or 1), path, prior)
    base = F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))
    model = F.col("lattice") / math.log(10) + (math.log10(unseen) - math.log10(n + unseen))
    values = cut(lattice_scores(counts.repartition(-(-all_ // WORDS) or 1), pieces, byte, unseen).select("word", "c", base.alias("base"), model.alias("model")), "lm-words")
    end_base = math.log10((ends + 1) / (n + v + 1))
    end_model = math.log10((ends + unseen * math.exp(end)) / (n + unseen))
    top = values.where((F.col("c") >= common_count(counts, common)) & (F.length("word") <= COMMON_CHARS)).toPandas()
    sent = spark.sparkContext.broadcast((dict(zip((w.encode() for w in top["word"]), range(len(top)), strict=True)), top["c"].to_numpy() > 0, top["base"].to_numpy(), top["model"].to_numpy()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, known, base_of, model_of = sent.value
        for pdf in batches:
            out: dict[str, list] = {c: [] for c in ("row", "id", "n_tokens", "n_known", "base", "model", "word", "times")}
            for row, i, text in zip(pdf["row"], pdf["id"], pdf["text"], strict=True):
                all_ = (text or "").encode().lower().split()
                at = [place.get(w, -1) for w in all_]
                rare = Counter(w for w, k in zip(all_, at, strict=True) if k < 0)
                at = np.array([k for k in at if k >= 0], np.int64)
                for x, y in zip(out.values(), (row, i, len(all_) + 1, int(known[at].sum()) + (ends > 0), base_of[at].sum() + end_base, model_of[at].sum() + end_model, None, 0), strict=True):
                    x.append(y)
                for w, k in rare.items():
                    for x, y in zip(out.values(), (row, None, None, None, None, None, w.decode(), k), strict=True):
                        x.append(y)
            yield pd.DataFrame({k: pd.array(x, "Int64") if k in ("n_tokens", "n_known") else x for k, x in out.items()})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("string").alias("id"), "text")
    parts = cut(rows.mapInPandas(run, "row long, id string, n_tokens long, n_known long, base double, model double, word string, times long"), "lm-texts")
    found = parts.where("word is not null").select("row", "word", "times").join(values, "word")
    found = found.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("k"), F.sum(F.col("times") * F.col("base")).alias("b"), F.sum(F.col("times") * F.col("model")).alias("m"))
    out = parts.where("word is null").drop("word", "times").join(found, "row", "left")
    plus = lambda x, y: F.col(x) + F.coalesce(F.col(y), F.lit(0))
    return out.select(F.col("id").cast(kind).alias(id_col), "n_tokens", plus("n_known", "k").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), plus("base", "b").alias("base_score"), plus("model", "m").alias("score"))
