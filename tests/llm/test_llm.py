"""The numbered operators against plain versions, and their edge cases."""

import base64
import hashlib
import html
import math
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from ashlar.lineage import cut
from ashlar.llm.ann import nearest
from ashlar.llm.bpe import Coder, encode_decode
from ashlar.llm.lattice_lm import arcs, forward, lattice_lm, learned_weights, piece_weights
from ashlar.llm.line_dedup import line_dedup
from ashlar.llm.main_text import extract, main_text
from ashlar.llm.mixing import mix, source_targets, take_mix
from ashlar.llm.near_dedup import components, near_dedup
from ashlar.llm.quality_classifier import pool, quality_scores
from ashlar.llm.quality_rules import CUTOFF, FLOORS, REWEIGHT, REWEIGHT_FACTOR, SHARE, SHARE_FACTOR, base_statistics, quality_rules, vector
from ashlar.llm.secret_scan import RULES, secret_scan, trigram_query

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __extra int"
ODD = [(1, None, None, None, None, 0), (2, "", "en", "a", 0, 0), (3, " \t\n ", "en", "a", 4, 0), (4, "one", "en", None, 3, 0), (4, "one", "en", None, 3, 0), (5, "x y " * 5000, "en", "b", 20000, 0), (6, "a b c\nd e f g h i\nd e f g h i", "de", "a", 9, 0)]
BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_base_statistics(docs, odd):
    got = base_statistics(docs.select("doc_id", "text").union(odd.select("doc_id", "text"))).collect()
    for r in got:
        w = words(r.text)
        win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(win)
        covered = {j for i, x in enumerate(win) if n[x] > 1 for j in range(i, i + 3)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_rules(spark, docs, odd, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    r = quality_rules(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    assert {x.quality: x.k for x in r}[1] > 0.99
    assert quality_rules(odd).where("not base_failed and kept").count() == 0
    assert quality_rules(odd).count() == len(ODD)
    assert quality_rules(empty).count() == 0


def plain_mcd(x, half):
    """Squared distances by the estimate of one group: two starts, three concentration steps, reweighting."""
    floors = np.diag(np.square(FLOORS))

    def rank(values, share):
        return np.sort(values)[max(math.ceil(share * len(values)), 1) - 1]

    def far(fit):
        return np.square(np.linalg.solve(np.linalg.cholesky(fit[1]), (x - fit[0]).T)).sum(axis=0)

    def moments(rows, factor):
        return rows.mean(axis=0), np.cov(rows.T, bias=True) * factor + floors

    q = [[rank(c, p) for p in (0.25, 0.5, 0.75)] for c in x.T]
    fits = [(np.array([b for _, b, _ in q]), np.diag([((c - a) / 1.349) ** 2 for a, _, c in q]) + floors), moments(x[half], 1.0)]
    for _ in range(3):
        fits = [moments(x[(d := far(f)) <= rank(d, SHARE)], SHARE_FACTOR) for f in fits]
    best = min(fits, key=lambda f: np.linalg.slogdet(f[1])[1])
    return far(moments(x[far(best) <= REWEIGHT], REWEIGHT_FACTOR))


def test_quality_rules_by_plain_estimates(spark, docs):
    """Every document's distance, in groups of language and source, of language, and of all."""
    some = docs.unionByName(docs.withColumns({"doc_id": F.col("doc_id") + 1000, "text": F.concat(F.lit("And so on. "), "text")}))
    stats = cut(base_statistics(some.select("doc_id", "text", "lang", "source")), "statistics").where("not base_failed")
    stats = stats.select("doc_id", "lang", "source", *(c.alias(f"x{i}") for i, c in enumerate(vector())))
    rows = stats.select("*", F.xxhash64("doc_id", *(f"x{i}" for i in range(6))).alias("h")).collect()
    least = 50
    size = Counter((r.lang, r.source) for r in rows)
    by_lang = Counter(r.lang for r in rows)
    group = {r.doc_id: (r.lang, r.source) if size[r.lang, r.source] >= least else (r.lang,) if by_lang[r.lang] >= least else () for r in rows}
    want = {}
    for g in set(group.values()):
        own = [r for r in rows if (r.lang, r.source)[: len(g)] == g]
        d = plain_mcd(np.array([[r[f"x{i}"] for i in range(6)] for r in own]), np.array([r.h % 2 == 0 for r in own]))
        want |= {r.doc_id: x for r, x in zip(own, d, strict=True) if group[r.doc_id] == g}
    got = {r.doc_id: r for r in quality_rules(some, min_group=least).where("not base_failed").collect()}
    assert set(got) == set(want) and len(set(group.values())) > 2
    assert all(math.isclose(got[i].distance, want[i], rel_tol=1e-6) and got[i].kept == (want[i] <= CUTOFF) for i in want)


def test_targets(spark):
    rows = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000), (None, 500)], "source string, source_size long")
    got = {r.source: r.target for r in source_targets(rows).collect()}
    sizes, w = {"a": 100, "b": 10, "c": 1000, None: 500}, {"a": 1, "b": 2, "c": 3, None: 1}
    want, left = {}, dict(sizes)
    while True:
        rest = sum(sizes.values()) - sum(want.values())
        level = rest / sum(w[s] for s in left)
        over = [s for s in left if level * w[s] > 3 * sizes[s]]
        if not over:
            want |= {s: level * w[s] for s in left}
            break
        for s in over:
            want[s] = 3 * sizes[s]
            del left[s]
    assert all(math.isclose(got[s], want[s]) for s in sizes)


def test_mix(docs, odd, empty):
    rows = mix(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    assert {(r.doc_id, r.copies) for r in rows} == {(r.doc_id, r.copies) for r in mix(docs).collect()}
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= max(r.size for r in own)
        assert all(abs(r.copies - r.target / r.source_size) < 1 or r.size == 0 for r in own)
    assert mix(odd).count() == len(ODD) and mix(empty).count() == 0
    assert take_mix(docs, mix(docs)).count() == sum(r.copies for r in rows)


def test_mix_of_repeated_rows(spark):
    """A row that comes 500 times isn't taken or left as a whole; copies go to rows alike."""
    rows = [(1, "w " * 10, "a")] * 500 + [(i, "w " * 5, "a") for i in range(2, 102)] + [(i, "w " * 7, "b") for i in range(200, 900)] + [(None, "w w", "b")] * 7 + [(950, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df).collect()
    assert len(got) == len(rows)
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 10
        assert all(abs(r.copies - r.target / r.source_size) < 1 for r in own)
    taken = take_mix(df, mix(df)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in taken} == {k: n for k, n in sum((Counter({r.doc_id: r.copies}) for r in got), Counter()).items() if n}


def test_main_text():
    page = "<html><head><title>no</title></head><body><nav><a href=x>menu</a></nav><article><h1>Head &amp; more</h1><p>One\n two<p>x &lt; y</article><div class='comments'><p>reader</p></div><footer>foot</footer>"
    assert main_text(page) == "Head & more\nOne two\nx < y"
    assert main_text(None) == main_text("") == ""
    long = "word " * 40
    assert main_text(f"<body><div>hi</div><ul class=menu><li>a</li></ul><p>{long}</p><p>{long}</p></body>").count("word") == 80


def test_main_text_is_found_by_its_distribution():
    """No article element: lengths, window and threshold decide; inside one they do as well."""
    long, link = "word " * 40, "<li><a href=x>elsewhere</a></li>"
    page = f"<body><div>Top</div><ul>{link * 5}</ul><h1>Head</h1><p>{long}</p><p>x</p><p><a href=y>link line</a></p><p>{long}</p><ul>{link * 5}</ul><p>tail</p>"
    body = [long.strip(), "x", "link line", long.strip()]
    assert main_text(page).split("\n") == ["Head", *body]
    assert main_text(page, window=1).split("\n") == [long.strip(), "x", long.strip()]
    short = f"<body><p>{long}</p><ul>{link * 5}</ul><p>{'mid ' * 20}</p><p>mid</p>"
    assert main_text(short, threshold=80).count("mid") == 21 and main_text(short, threshold=90).count("mid") == 0
    ads = "<div class=ad><p>buy</p></div>"
    page = f"<article><h1>Head</h1><p>{long}</p>{ads * 4}<p>End.</p><p>{long}</p></article>"
    assert main_text(page).split("\n") == ["Head", long.strip(), "End.", long.strip()]
    late = f"<article><p>{long}</p>{ads * 4}<p>End.</p></article>"
    assert main_text(late).split("\n") == [long.strip()]  # too little after a dive
    assert main_text(late, threshold=20).split("\n") == main_text(late, window=6).split("\n") == [long.strip(), "End."]


def test_main_text_odd_pages(spark):
    deep = "<div>" * 50_000 + "text " * 40 + "</b>" * 50_000
    broken = "<a <a " * 50_000 + "<p class=\"x>" + "text " * 40
    for page in (deep, broken, "<p>" * 100_000 + "y " * 60, "<" * 200_000):
        begin = time.monotonic()
        main_text(page)
        assert time.monotonic() - begin < 5
    assert main_text(deep) == ("text " * 40).strip()
    assert main_text("a < b and c > d") == "a < b and c > d" and main_text("<p>x&#8212;y&nbsp;z") == "x\u2014y z"
    rows = [(1, "u", "<p>" + "text " * 40, "k"), (1, "u", "<p>" + "text " * 40, "k"), (None, None, None, None), (2, "v", "", "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, __html string")
    want = ("text " * 40).strip()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in extract(df).collect()) == [(0, "", 0), (1, want, len(want)), (1, want, len(want)), (2, "", 0)]
    assert extract(df.limit(0)).count() == 0


def test_main_text_on_pages(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(?:</article>|<footer|$)", r.html, re.DOTALL)[1]
        want = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br)>", body)]
        assert main_text(r.html) == "\n".join(x for x in want if x)


def test_nearest(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((600, 16)).astype("f4")
    v[100:300] = v[7]
    rows = [(i, [float(x) for x in y]) for i, y in enumerate(v)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    hits = 0
    for q in range(0, 600, 50):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        hits += len(set(np.lexsort((np.arange(600), -s))[:5].tolist()) & set(got[q]))
    assert set(got) == set(range(0, 600, 50)) and hits / 60 >= 0.9
    assert nearest(df.limit(0), F.lit(True)).count() == 0


def test_classifier(spark, docs, odd, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    out = quality_scores(docs, labels, ~held)
    assert out.count() == docs.count() and out.where("score between 0 and 1").count() == docs.count()
    test = out.where(held).join(labels, "doc_id").collect()
    assert sum((r.predicted == 1) == (r.quality == 1) for r in test) >= 0.9 * len(test)
    assert quality_scores(odd, labels, ~held).count() == len(ODD) and quality_scores(empty, labels, ~held).count() == 0


def test_secrets(spark, empty):
    text = "x password: 'abcdefgh12' token=short AKIA" + "Q" * 14 + " é " + "0f" * 20
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.text) for s in r.spans] for r in secret_scan(df).collect()}
    assert got == {1: [("assign", "password: 'abcdefgh12"), ("access", "AKIA" + "Q" * 14), ("hex", "0f" * 20)], 2: [], 3: []}
    assert trigram_query("[0-9a-f]+") == [] and frozenset(["aki"]) in trigram_query("AKIA[A-Z0-9]+")
    assert secret_scan(empty).count() == 0


def test_lattice():
    pieces, byte = {"▁": -1.0, "▁a": -2.0, "b": -1.5, "ab": -2.5}, -5.0

    def every(text):  # all segmentations, in turn
        if not text:
            return 1.0
        return sum(math.exp(w) * every(text[len(p) :]) for p, w in pieces.items() if text.startswith(p)) + math.exp(byte * len(text[0].encode())) * every(text[1:])

    for word in ("ab", "abab", "é", "b"):
        assert math.isclose(forward(word, arcs(pieces), byte), math.log(every("▁" + word)))


def segmentations(text, pieces, byte):
    """(weight, pieces; "" for a byte) of every way to spell the text."""
    if not text:
        return [(0.0, [])]
    out = [(w + v, [p, *x]) for p, w in pieces.items() if text.startswith(p) for v, x in segmentations(text[len(p) :], pieces, byte)]
    k = len(text[0].encode())
    return out + [(byte * k + v, [""] * k + x) for v, x in segmentations(text[1:], pieces, byte)]


def test_lm_by_enumeration(spark):
    """Scores of small texts, with weights re-estimated, against all segmentations."""
    path, prior = PIECES, 3.0
    texts = {i: t for i, t in enumerate(["the cat sat", "the dog sat on it", "a cat \u00e9t\u00e9", "the the the", "", None, "\u65e5 ab"])}
    train = {0, 1, 2, 3, 4}
    token = {i: (t or "").encode().lower().decode().split() + [None] for i, t in texts.items()}
    c = Counter(w for i in train for w in token[i])
    n, unseen = sum(c.values()), max(1, sum(k == 1 and w is not None for w, k in c.items()))
    pieces, byte, end = piece_weights(path)
    near = {p: w for p, w in pieces.items() if any(p in "\u2581" + w for x in token.values() for w in x if w)}
    counts = Counter()
    for w in (w for w, k in c.items() if k == 1 and w):
        ways = segmentations("\u2581" + w, near, byte)
        total = sum(math.exp(x) for x, _ in ways)
        for x, used in ways:
            for p in used:
                counts[p] += math.exp(x) / total
    all_ = sum(counts.values()) + prior
    new = {p: math.log((counts[p] + prior * math.exp(w)) / all_) for p, w in near.items()}
    new_byte = math.log((counts[""] + 256 * prior * math.exp(byte)) / all_ / 256)
    word = {w: math.log10((c[w] + unseen * sum(math.exp(x) for x, _ in segmentations("\u2581" + w, new, new_byte))) / (n + unseen)) for x in token.values() for w in x if w}
    word[None] = math.log10((c[None] + unseen * math.exp(end) * prior / all_) / (n + unseen))
    df = spark.createDataFrame([*texts.items(), (0, texts[0])], "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("c", F.lit("clash"))
    for common in (0, 3, 1000):
        for r in lattice_lm(df, F.col("doc_id") < 0, path).collect():
            assert r.n_known == 0
        got = lattice_lm(df.dropDuplicates(["doc_id"]), F.col("doc_id").isin(*train), path, common=common, prior=prior).collect()
        assert {r.doc_id for r in got} == set(texts)
        for r in got:
            assert math.isclose(r.score, sum(word[w] for w in token[r.doc_id]), rel_tol=1e-9)


def test_lm_mass_is_one(spark):
    """Pieces, bytes and the end add up to 1, before and after weights are re-estimated."""
    words_ = spark.createDataFrame([("cat",), ("\u00e9t\u00e9",), ("zzz\u65e5",)], "word string")
    for pieces, byte, end in (piece_weights(PIECES), learned_weights(words_, PIECES, 3.0), learned_weights(words_.limit(0), PIECES, 1.0)):
        assert math.isclose(sum(map(math.exp, pieces.values())) + 256 * math.exp(byte) + math.exp(end), 1.0, rel_tol=1e-9)


def test_lm_learns(docs):
    """Weights re-estimated from training texts make held-out ones likelier."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    total = {p: lattice_lm(docs, ~held, PIECES, prior=p).where(held).agg(F.sum("score")).first()[0] for p in (1e4, 1e12)}
    assert total[1e4] > total[1e12]


def test_lm(docs, odd, empty):
    trains = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2
    texts = {r.doc_id: (r.text, r.t) for r in docs.withColumn("t", trains).collect()}
    token = {i: (t or "").encode().lower().split() + [None] for i, (t, _) in texts.items()}
    c = Counter(w for i, x in token.items() if texts[i][1] for w in x)
    n, v = sum(c.values()), len(c)
    for r in lattice_lm(docs, trains, PIECES, common=500).collect():
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in token[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(token[r.doc_id]), sum(c[w] > 0 for w in token[r.doc_id]), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    assert lattice_lm(odd, trains, PIECES).count() == len(ODD) and lattice_lm(empty, trains, PIECES).count() == 0


def test_bpe(docs, odd, empty):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in encode_decode(docs, BPE, public_tokenizers.PATTERN).collect():
        ids = own.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    for x in ("", "a" * 3000, " " * 2000 + "é" * 300, "<|endoftext|>"):
        coder = Coder(BPE, public_tokenizers.PATTERN)
        coded = coder.encode([x])
        assert coded == [",".join(map(str, own.encode_ordinary(x)))] and coder.decode(coded) == [x.encode()]
    assert encode_decode(odd, BPE, public_tokenizers.PATTERN).count() == len(ODD) and encode_decode(empty, BPE, public_tokenizers.PATTERN).count() == 0


def test_bpe_long_words():
    """Words of any length end soon, in bounded memory, and come out as tiktoken has them."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder, r = Coder(BPE, public_tokenizers.PATTERN), random.Random(2)
    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    texts = [pick("abcdefghijklmnopqrstuvwxyz", 100_000), pick("abcdefghijABCDEFGHIJ", 5_000_000), pick("0123456789", 20_000), "a" * 300_000, "otch" * 20_000, "ab" * 5000 + "aab" * 3000, pick("abcde", 3000), "\u6211\u4eec\u90fd\u77e5\u9053" * 3000, pick("=-", 3000)]
    for x in texts:
        coded = coder.encode([x, "short", x[:70]])
        assert coded == [",".join(map(str, own.encode_ordinary(y))) for y in (x, "short", x[:70])]
        assert coder.decode(coded)[0] == x.encode()


def test_near_dedup(docs, odd, empty):
    sets = {}
    for r in docs.collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * len(sets[i] | sets[j]) and find(i) != find(j):
                top[max(find(i), find(j))] = min(find(i), find(j))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(docs, k=2).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in ids}
    assert near_dedup(odd).count() == len(ODD) and near_dedup(empty).count() == 0


def test_near_dedup_large_bucket(spark):
    """A chain of texts whose ends are far apart is one component."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[i : i + 100]) for i in range(0, 60, 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in near_dedup(df, k=2).collect()} == {0}


def test_components(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 90)], "a long, b long")
    assert {r.id: r.component for r in components(df).collect()} == {i: 0 for i in range(51)} | {100: 90, 90: 90}


def test_line_dedup(spark, odd, empty):
    line = "this line is boilerplate number 17 of many words"
    df = spark.createDataFrame([(1, f"own text one\n{line}", 0), (2, f"{line.replace('17', '18')}\nother text", 1), (3, None, 1), (4, "short\nshort", 1), (5, "short", 1)], "doc_id long, text string, __x int")
    got = {r.doc_id: r.text for r in line_dedup(df).collect()}
    assert got == {1: f"own text one\n{line}", 2: "other text", 3: None, 4: "short\nshort", 5: "short"}
    assert line_dedup(odd).count() == len(ODD) and line_dedup(empty).count() == 0


def test_line_dedup_variants_that_recur_exactly(spark):
    """A variant that recurs exactly and one that doesn't share their general template: only its first document keeps the line."""
    head, tail = "please note that this long passage is shared by", "and goes on for several more words after it"
    variants = [(1, "alpha"), (2, "beta"), (3, "alpha"), (4, "beta"), (5, "gamma")]
    df = spark.createDataFrame([(i, f"own text {w} number {i}\n{head} {w} {tail}") for i, w in variants], "doc_id long, text string")
    for least in (2, 5):
        got = {r.doc_id: r["__dropped"] for r in line_dedup(df, min_docs=least).collect()}
        assert got == {1: 0, 2: 1, 3: 1, 4: 1, 5: 1}
    assert {r["__dropped"] for r in line_dedup(df, min_docs=6).collect()} == {0}


def plain_line_dedup(texts, min_docs=2, share=70, short_docs=10, min_tokens=5, depth=3):
    """Lines to drop of {id: text}: every pair of templates compared."""
    where, short = {}, {}
    for i, text in texts.items():
        for at, line in enumerate((text or "").split("\n")):
            raw = [x for x in re.split(r"[\x20\x09-\x0D]+", line) if x]
            t = tuple("<*>" if re.search("[0-9]", x) else x for x in raw)
            if sum(x != "<*>" for x in t) >= min_tokens:
                where.setdefault(t, []).append((i, at))
            elif any(x.isalpha() for x in line):
                short.setdefault(tuple(raw), []).append((i, at))
    leaves, drop = {}, {}
    for t in where:
        leaves.setdefault((len(t), t[:depth]), []).append(t)
    groups = [(where[t], [x for o in leaf if 100 * sum(a == b for a, b in zip(t, o)) >= share * len(t) for x in where[o]], min_docs) for leaf in leaves.values() for t in leaf]
    for own, of, least in groups + [(x, x, short_docs) for x in short.values()]:
        ids = {i for i, _ in of}
        for i, at in own:
            if len(ids) >= least and i != min(ids):
                drop.setdefault(i, set()).add(at)
    return {i: "\n".join(x for at, x in enumerate(text.split("\n")) if at not in drop.get(i, ())) for i, text in texts.items() if text is not None}


@pytest.mark.parametrize("min_docs", [2, 4])
def test_line_dedup_by_all_pairs(spark, docs, min_docs):
    """Variants in any words, of lines of any length, and short lines by how often they recur."""
    r = random.Random(5)
    words_ = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    bases = [[r.choice(words_) for _ in range(n)] for n in (5, 6, 7, 8, 9, 11, 12, 13, 20, 31, 57)]
    texts = {}
    for i in range(150):
        lines = [f"Own {i} line"]
        for base in r.sample(bases, 3):
            at = set(r.sample(range(len(base)), r.randint(0, len(base) * 2 // 5)))
            lines.append(" ".join(r.choice([*words_, "7", "x9"]) if k in at and (k > 2 or r.random() < 0.1) else x for k, x in enumerate(base)))
        texts[i] = "\n".join(lines + ["All rights reserved."] * (i % 10 == 3) + ["Page 4"] * (i % 20 == 3) + ["---"])
    got = {x.doc_id: x.text for x in line_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), min_docs=min_docs).collect()}
    assert got == plain_line_dedup(texts, min_docs)
    texts = {x.doc_id: x.text for x in docs.select("doc_id", "text").collect()}
    got = {x.doc_id: x.text for x in line_dedup(docs.select("doc_id", "text"), min_docs=min_docs).where("text is not null").collect()}
    assert got == plain_line_dedup(texts, min_docs)


CLASHES = ["id", "h", "n", "t", "at", "row", "word", "c", "p", "v", "q", "b", "x", "key", "sig", "size", "copies", "drop", "lines", "line", "leaf", "exact", "kept", "g", "d2", "x0", "m0", "doc", "d_id", "component", "__id", "__drop", "__all", "__lines", "__dropped", "__words", "__h", "__train", "__html"]


def test_columns_that_clash(spark, docs):
    """Extra columns of any name change nothing."""
    rows = docs.limit(60).collect()
    plain = spark.createDataFrame(rows, docs.schema).coalesce(1)
    other = plain.withColumns({c: F.lit("clash") for c in CLASHES})
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    same = {
        "quality": lambda d: quality_rules(d),
        "mix": lambda d: mix(d),
        "take": lambda d: take_mix(d, mix(d)).select(docs.columns),
        "classifier": lambda d: quality_scores(d, labels, ~held).withColumn("score", F.round("score", 9)),
        "secrets": lambda d: secret_scan(d).withColumn("spans", F.col("spans").cast("string")),
        "bpe": lambda d: encode_decode(d, BPE, public_tokenizers.PATTERN),
        "near": lambda d: near_dedup(d, k=2),
        "lines": lambda d: line_dedup(d).select("doc_id", "text", "__lines", "__dropped"),
    }
    for name, f in same.items():
        assert sorted(map(repr, f(plain).collect())) == sorted(map(repr, f(other).collect())), name
    kept = line_dedup(other)
    assert sorted(kept.columns) == sorted(other.columns) and kept.select("id", "drop").distinct().collect() == [("clash", "clash")]
    assert take_mix(other, mix(other)).columns == other.columns
    vectors = spark.createDataFrame([(i, [float(i), 1.0, 0.5], "x", "y") for i in range(30)] + [(30, [1.0], "x", "y")], "vec_id long, embedding array<float>, id string, v string")
    assert nearest(vectors, F.col("vec_id") % 10 == 0).groupBy("query_id").count().collect() and nearest(vectors, F.col("vec_id") == 30).count() == 0


def test_near_dedup_repeated_and_missing_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    df = spark.createDataFrame([(1, a), (1, a), (2, a), (3, b), (3, a), (None, a), (None, b), (4, b), (None, None)], "doc_id long, text string")
    counts = {t: h for t, h in df.select("text", F.xxhash64("text")).distinct().collect()}
    three = 1 if counts[a] > counts[b] else 3
    got = sorted((str(r.doc_id), str(r.component_id), r.kept, r.n_shingles) for r in near_dedup(df, k=2).collect())
    four = 4 if three == 1 else 3
    assert got == sorted([("1", "1", True, 59), ("1", "1", True, 59), ("2", "1", False, 59), ("3", str(three), three == 3, 59), ("3", str(three), three == 3, 59), ("4", str(four), four == 4, 59), ("None", "None", True, 59), ("None", "None", True, 59), ("None", "None", True, 0)])


def test_secrets_by_plain_search(spark, docs):
    """Every rule searched in every text, without the index."""
    want, r = {}, random.Random(4)
    parts = ["password: hunter2hunter2", "API_KEY='abcd-efgh_1'", "token=short", "AKIA" + "Q2" * 8, "akia" + "Q2" * 8, "0f" * 17, "sk_live_" + "a1" * 9, "plain words", "\u00e9t\u00e9", "ghp_" + "Zz9" * 12, "-----BEGIN RSA PRIVATE KEY-----"]
    made = [(10**6 + i, " ".join(r.choice(parts) for _ in range(r.randint(1, 6)))) for i in range(60)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    for r in docs.collect():
        spans = [(m.start(), k, rule.kind, m.end(), m[0]) for k, rule in enumerate(RULES) for m in re.finditer(rule.pattern, r.text or "", rule.flags) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        want[r.doc_id] = [(x[2], x[0], x[3], x[4]) for x in sorted(spans, key=lambda y: y[:2])]
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in secret_scan(docs).collect()} == want and any(want.values())
    rows = spark.createDataFrame([(None, None, 1), (7, "token=abcdefgh", 2), (7, "token=abcdefgh", 2)], "doc_id long, text string, spans int")
    assert sorted((str(r.doc_id), len(r.spans)) for r in secret_scan(rows).collect()) == [("7", 1), ("7", 1), ("None", 0)]


def test_isotonic_by_its_formula():
    r = np.random.default_rng(1)
    for n in (1, 2, 7, 30):
        total = r.integers(1, 9, n).astype(float)
        good = np.floor(total * r.random(n))
        mean = lambda a, b: good[a : b + 1].sum() / total[a : b + 1].sum()
        want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(pool(total, good), want)


def test_nearest_on_the_given_vectors(spark):
    """Recall against brute force of at least 0.9."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids, u = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    got = {}
    for r in nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = u @ u[q]
        s[q] = -9
        hits += len(got[ids[q]] & set(ids[np.lexsort((ids, -s))[:5]].tolist()))
        total += 5
    assert hits >= 0.9 * total
