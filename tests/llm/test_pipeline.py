"""The pipeline's stages against plain versions, each on its own input."""

import base64
import hashlib
from collections import Counter, defaultdict

import corpus_pipeline as cp
import public_tokenizers
import tiktoken
from test_llm import ODD, SCHEMA, plain_line_dedup, words

from ashlar.llm.mixing import source_targets
from ashlar.llm.quality_rules import quality_rules

SF = "/root/testdata/sf0.001"


def plain_near(texts, k=5):
    """Smallest id of each component: every pair of k-word shingle sets compared."""
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: find(i) for i in ids}


def test_stages(spark, tmp_path):
    odd = spark.createDataFrame([(100_000 + r[0], *r[1:]) for r in ODD] + [(None, "a b " * 40, "en", "a", 9, 1), (None, "z " * 60, None, None, 9, 1)], SCHEMA)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(odd.drop("__extra"))
    assert [n for n, _ in cp.STAGES] == ["quality rules", "line dedup", "near-dedup", "mixing", "byte-level BPE"]
    stage = dict(cp.STAGES)

    def step(name, rows):
        out = stage[name](spark, rows, SF)
        path = str(tmp_path / name.replace(" ", "-"))
        out.write.parquet(path)
        return spark.read.parquet(path)

    first = step("quality rules", docs)
    want = Counter()
    for r in docs.collect():  # the base rules, plainly; the covariance verdict is tested with the operator
        w = words(r.text)
        n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        want[r.doc_id] += len(w) >= 50 and 100 * len(covered) <= 50 * len(w)
    got = Counter(r.doc_id for r in first.collect())
    outliers = sum(r.n for r in [quality_rules(docs).where("not base_failed and not kept").groupBy().count().withColumnRenamed("count", "n").first()])
    assert first.columns == cp.COLUMNS and all(got[i] <= want[i] for i in got) and sum(want.values()) - sum(got.values()) <= outliers + 2

    second = step("line dedup", first)
    texts = {r.doc_id: r.text for r in first.where("doc_id is not null").collect()}
    assert {r.doc_id: r.text for r in second.where("doc_id is not null").collect()} == plain_line_dedup(texts)
    assert all(r.n_chars == len(r.text) for r in second.collect()) and second.columns == cp.COLUMNS

    third = step("near-dedup", second)
    component = plain_near(plain)
    assert sorted(r.doc_id for r in third.where("doc_id is not null").collect()) == sorted(i for i, x in component.items() if i == x)
    assert third.where("doc_id is null").count() == second.where("doc_id is null").count() and third.columns == cp.COLUMNS

    fourth = step("mixing", third)
    sizes, of = defaultdict(int), {r.doc_id: (r.source, len(words(r.text))) for r in third.collect()}
    for s, n in of.values():
        sizes[s] += n
    targets = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    copies = Counter(r.doc_id for r in fourth.collect())
    for s in sizes:
        own = [i for i, (x, _) in of.items() if x == s]
        assert abs(sum(copies[i] * of[i][1] for i in own) - targets[s]) <= max(of[i][1] for i in own)
        assert all(abs(copies[i] - targets[s] / sizes[s]) < 1 for i in own)

    last = step("byte-level BPE", fourth)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r.doc_id: r.text for r in third.collect()}
    ids = {i: own.encode_ordinary(t) for i, t in text.items()}
    want = sorted((str(i), len(ids[i]), hashlib.sha256(",".join(map(str, ids[i])).encode()).hexdigest(), hashlib.sha256(text[i].encode()).hexdigest()) for i in copies.elements())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in last.collect()) == want


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    for name, rows in (("empty", []), ("odd", ODD)):
        folder = tmp_path / name
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(folder / "documents.parquet"))
        assert cp.run(spark, str(folder)).count() == 0
