"""The conversation trie, aligned tokenizers and token records against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ashlar.llm.conversation_trie import conversation_trie
from ashlar.llm.queries import QUERIES
from ashlar.llm.subwords import loaded
from ashlar.llm.token_align import gallop, token_align
from ashlar.llm.token_records import crc32c, frame, read_index, read_records, token_records, unframe, write_records

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a", "  two  spaces \n\n end ", "don't stop, won't!", "x<|endoftext|>y <s></s><unk>", "über Straße ▁ literal", "naïve\x1cfile\x85sep", "日本語 text 😀😀", "=" * 500, "a" * 3000, "1234567890" * 50, "\x00nul", " lead", "tail ", "word " * 4000, "ﬁ　wide"]


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def plain_trie(rows, block=None, most=6):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    own = {c: [y[3:] for y in sorted(v)] for c, v in own.items()}
    built = dict(own)
    if block:
        for c, t in own.items():
            h = zlib.crc32(str(c).encode()) % most
            built[c] = own.get(c - int(np.fmod(c, block)), [])[:h] + t[h:]
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    out = []
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_trie_bursts_at_any_limit(spark, limit):
    rnd = random.Random(4)
    rows = []
    for c in range(120):  # long common beginnings, copies, prefixes of one another, shares of turns
        like = rnd.choice([0, 0, 1, 2, c])
        for t in range(rnd.choice([1, 2, 3, 9])):
            rows.append((c * 7, t, "user" if t % 2 == 0 else None, f"turn {like if t < 5 else rnd.randint(0, 3)} {t}"))
    rows += [(9, None, "late", "first"), (9, 0, "", None), (9, 0, "", None), (None, 1, "no", "id"), (-205, 3, "x", "é😀"), (-200, 1, "y", "z")]
    got = conversation_trie(turns(spark, rows).withColumns({"seq": F.lit(1), "head": F.lit(2)}), limit=limit)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(rows)


def test_trie_grafts(spark):
    rows = [(c, t, "u", f"{c % 3} {t}") for c in [100, 101, 102, 103, 150, 204, 205, 300, -7] for t in range(1 + c % 4)]
    got = conversation_trie(turns(spark, rows), block=100, limit=1)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(rows, 100)
    assert any(r.depth == 0 and r.ends_sha256 != hashlib.sha256(b"").hexdigest() for r in got.collect()), "some conversation has no turn"


def test_trie_of_nothing(spark):
    assert conversation_trie(turns(spark, [])).count() == 0
    assert conversation_trie(turns(spark, [(None, 0, "a", "b")]), block=100).count() == 0


def test_gallop():
    rng = np.random.default_rng(2)
    for _ in range(50):
        longer = np.unique(rng.integers(0, 400, rng.integers(1, 200)))
        ends = np.unique(rng.integers(0, 450, 60))
        start = np.minimum(np.searchsorted(longer, ends), rng.integers(0, len(longer), len(ends)))
        assert gallop(ends, longer, start).tolist() == np.searchsorted(longer, ends).tolist()


def test_words_encode_as_whole_texts():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    whole, model = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    whole.encode_special_tokens = True
    rnd = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "é", "ǃ", "12", "!", ".", ",", "\x1c", "\x85", " ", "　", "▁", "<|endoftext|>", "<s>", "日本", "😀", "\x00", "=", "ﬁ", "​", "́", "A", '"', "(", "_"]
    texts = ODD + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25))) for _ in range(4000)]
    a, b = loaded("byte_level", A), loaded("pieces", B)
    assert a.lists(texts) == [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]
    texts = [x for x in texts if x]
    assert b.lists([" " + x for x in texts]) == model.encode(texts)


def plain_alignment(texts):
    """As the contract says it, with loops; by the libraries on whole texts."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    whole, model = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    whole.encode_special_tokens = True
    a_bytes, b_bytes = loaded("byte_level", A).token_bytes, loaded("pieces", B).token_bytes
    rows, held = [], Counter()
    for x in texts:
        groups = []
        if x:
            a, b = whole.encode(" " + x, add_special_tokens=False).ids, model.encode(x)
            if b"".join(a_bytes[i] for i in a) == b"".join(b_bytes[i] for i in b) == (" " + x).encode():
                i = j = at_a = at_b = 0
                left, right = [], []
                while i < len(a) or j < len(b):
                    if at_a <= at_b:
                        left.append(a[i])
                        at_a += len(a_bytes[a[i]])
                        i += 1
                    else:
                        right.append(b[j])
                        at_b += len(b_bytes[b[j]])
                        j += 1
                    if at_a == at_b and left and right:
                        groups.append((left, right))
                        left, right = [], []
        rows.append(groups)
        held.update({(p, q) for l, r in groups for p in l for q in r})
    best = Counter()
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    out = []
    for groups in rows:
        links = [(p, q) for l, r in groups for p in l for q in r]
        said = ";".join(",".join(map(str, l)) + "|" + ",".join(map(str, r)) for l, r in groups)
        out.append((sum(len(l) for l, _ in groups), sum(len(r) for _, r in groups), len(groups), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


def test_alignment_equals_loops(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + ODD + ODD[4:8] + [None]
    docs = spark.createDataFrame([(i if i % 9 else None, x, i, 0) for i, x in enumerate(texts)], "doc_id long, text string, chunk int, at int")
    got = token_align(docs.repartition(5), A, B).collect()
    want = plain_alignment(texts)
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((i if i % 9 else None, *w) for i, w in enumerate(want)), key=repr)
    assert token_align(docs.limit(0), A, B).count() == 0


def test_checksums_and_frames():
    slices = [b"123456789", b"", bytes(32), bytes(range(256)) * 9, b"x" * 255]
    data = b"".join(slices)
    lengths = np.array(list(map(len, slices)))
    assert crc32c(np.frombuffer(data, np.uint8), np.cumsum(lengths) - lengths, lengths)[:3].tolist() == [0xE3069283, 0, 0x8A9136AA]  # known values
    framed = frame(slices)
    offsets = np.cumsum([len(x) for x in framed]) - [len(x) for x in framed]
    assert unframe(b"".join(framed), offsets, lengths) == slices
    for at in (3, 9, 40, len(b"".join(framed)) - 1):
        broken = bytearray(b"".join(framed))
        broken[at] ^= 4
        with pytest.raises(ValueError):
            unframe(bytes(broken), offsets, lengths)


def test_records_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    texts = ODD + [None, "same", "same", "other"]
    ids = [*range(50, 50 + len(ODD)), 3, None, None, 3]
    docs = spark.createDataFrame(list(zip(ids, texts, texts, strict=True)), "doc_id long, text string, offset string")
    coded = {x: [*whole.encode(x or "", add_special_tokens=False).ids, 0] for x in set(texts)}
    got = token_records(docs.repartition(7), A, f"file://{tmp_path}/a").orderBy("start").collect()
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert [r.doc_id for r in got] == [None, None, 3, 3, *range(50, 50 + len(ODD))]
    crc = lambda x: zlib.crc32(np.array(coded[x], "<u4").tobytes())
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((len(coded[x]), crc(x)) for x in texts)
    shuffled = read_records(read_index(spark, f"file://{tmp_path}/a").orderBy(F.rand(1)), f"file://{tmp_path}/a", keep=["n_tokens"]).collect()
    assert sorted(map(list, (r.ids for r in shuffled))) == sorted(coded[x] for x in texts)
    assert all(len(r.ids) == r.n_tokens for r in shuffled)
    assert token_records(docs.limit(0), A, f"file://{tmp_path}/b").count() == 0


def test_a_damaged_file_is_found(spark, tmp_path):
    folder = tmp_path / "c"
    folder.mkdir()
    index = write_records(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), A, f"file://{folder}")
    (file,) = folder.glob("*.rec")
    data = bytearray(file.read_bytes())
    data[14] ^= 1
    file.write_bytes(bytes(data))
    with pytest.raises(Exception, match="damaged"):
        read_records(index, f"file://{folder}").collect()


def test_queries_have_a_row_a_document(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert QUERIES["op12_token_align"](spark, SF).count() == QUERIES["op13_token_records"](spark, SF).count() == n
