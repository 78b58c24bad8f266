"""Ids of whole texts by the tokenizers of two libraries, word by word.

A text is cut only where no token of the vocabulary and no part of the
tokenizer's own splitting can lie across, so the ids of the words in order are
the ids of the whole text; each distinct word is encoded once by the library
and kept in a table of bounded size. Texts whose blanks follow each other, or
stand at an end, are cut by the general rule, all others by plain replacements
over the Arrow column, with the same result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a table keeps, longest word that is kept.
KEPT, LONG = 600_000, 64
#: Unicode's White_Space but for the space and the line feed, as code points: the byte-level splitting goes by it.
BLANKS = [0x9, 0xB, 0xC, 0xD, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BLANK = " \n" + "".join(map(chr, BLANKS))
#: Latin letters, which the byte-level splitting keeps apart from punctuation.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
MARKS = r',.;:!?|()"'
#: A run of letters before a blank or plain punctuation, other runs up to a blank, blanks.
BYTE_LEVEL_WORD = re.compile(rf" ?[{LETTERS}]+(?![^{BLANK}{MARKS}])| ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
LETTERS_ONLY = re.compile(rf" ?[{LETTERS}]+")
PIECE_WORD = re.compile("[ ▁]+[^ ▁]*|[^ ▁]+")
#: What stands between words while a column is cut; texts that hold it are cut by the general rule.
CUT = "\x1f"


def cut_byte_level(texts: pa.Array) -> pa.Array:
    """Words of texts whose blanks are single spaces and line feeds between other characters."""
    out = pc.replace_substring(pc.replace_substring(texts, " ", CUT + " "), "\n", f"{CUT}\n{CUT}")
    return pc.split_pattern(pc.replace_substring_regex(out, f"([{LETTERS}])([{MARKS}])", rf"\1{CUT}\2"), CUT)


def cut_pieces(texts: pa.Array) -> pa.Array:
    """Words of texts that begin with a space and have single spaces between other characters."""
    return pc.split_pattern(pc.utf8_slice_codeunits(pc.replace_substring(texts, " ", CUT + " "), 1), CUT)


class Subwords:
    """encode(texts): the ids of texts. odd: a pattern of texts that split has to cut; cut does the others."""

    def __init__(self, split: Callable[[str], list[str]], cut: Callable[[pa.Array], pa.Array] | None, odd: str, of_words: Callable[[list[str]], list[list[int]]], token_bytes: list[bytes], most: int = KEPT, whole: bool = False) -> None:
        self.split, self.cut, self.odd, self.of_words, self.token_bytes, self.most, self.whole = split, cut, odd, of_words, token_bytes, most, whole
        self.length = np.array([len(x) for x in token_bytes], np.int64)
        self.known: dict[str, bytes] = {}
        self.unlike: set[str] = set()

    def learn(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        known = self.known
        new = [x for x in words if x not in known]
        if len(known) + len(new) > self.most:
            known.clear()
            self.unlike.clear()
            new = words
        coded = self.of_words(new)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        ids = np.fromiter(chain.from_iterable(coded), np.uint32, int(sizes.sum()))
        flat, ends = ids.tobytes(), (np.cumsum(sizes) * 4).tolist()
        known.update(zip(new, [flat[x:y] for x, y in zip([0, *ends], ends, strict=False)], strict=True))
        if not self.whole and b"".join([self.token_bytes[i] for i in ids.tolist()]) != "".join(new).encode():
            self.unlike.update(x for x, i in zip(new, coded, strict=True) if b"".join([self.token_bytes[t] for t in i]) != x.encode())
        out = [known[x] for x in words]
        for word in new:
            if len(word) > LONG:
                del known[word]
        return out

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(place in the list of distinct words of each word of the texts in order, words of each text, the distinct words)."""
        column = pa.array(texts, pa.string())
        odd = np.array(pc.match_substring_regex(column, self.odd).to_pylist(), bool) if self.cut else np.ones(len(texts), bool)
        even = self.cut(column.filter(pa.array(~odd))) if self.cut else pa.array([], pa.list_(pa.string()))
        parts = pa.array([self.split(texts[i]) for i in np.flatnonzero(odd)], pa.list_(pa.string()))
        words = even.flatten()
        found = pa.concat_arrays([words.cast(pa.string()), parts.flatten()]).dictionary_encode()
        counts = np.zeros(len(texts), np.int64)
        counts[~odd], counts[odd] = pc.list_value_length(even).to_numpy(), pc.list_value_length(parts).to_numpy()
        codes, mask = found.indices.to_numpy(), np.repeat(odd, counts)
        placed = np.empty(len(codes), np.int64)
        placed[~mask], placed[mask] = codes[: len(words)], codes[len(words) :]
        return placed, counts, found.dictionary.to_pylist()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of each text's, whether the bytes of a text's tokens joined are the text's)."""
        if not texts:
            return np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, bool)
        placed, counts, distinct = self.words(texts)
        coded = self.learn(distinct)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) >> 2
        pool, begin = np.frombuffer(b"".join(coded), np.uint32), np.cumsum(sizes) - sizes
        n = sizes[placed]
        ends = np.cumsum(n)
        ids = pool[np.repeat(begin[placed] - (ends - n), n) + np.arange(int(n.sum()))]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        numbers = np.diff(upto)
        alike = np.ones(len(texts), bool)
        if self.unlike:
            bad = np.fromiter((x in self.unlike for x in distinct), bool, len(distinct))
            for i in np.unique(np.repeat(np.arange(len(texts)), counts)[bad[placed]]).tolist():
                alike[i] = b"".join([self.token_bytes[t] for t in ids[upto[i] : upto[i + 1]].tolist()]) == texts[i].encode()
            self.unlike.intersection_update(self.known)
        return ids, numbers, alike

    def lists(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        ids, n, _ = self.encode(texts)
        return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if texts else []


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters for themselves, the others from U+0100 on in order."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level(path: str, most: int = KEPT) -> Subwords:
    """A byte-level BPE of the tokenizers library; strings of special tokens are plain text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    of_char = _byte_of_char()
    names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
    tokens = [bytes(of_char[c] for c in x) if all(c in of_char for c in x) else x.encode() for x in names]
    encode, model = tokenizer.encode_batch_fast, tokenizer.model.tokenize
    table = {b: c for c, b in of_char.items()}

    def of_words(words: list[str]) -> list[list[int]]:
        """A run of letters is one word for the model; the library splits all else."""
        out: list[list[int]] = [[] for _ in words]
        rest = []
        for i, word in enumerate(words):
            if LETTERS_ONLY.fullmatch(word):
                plain = word.replace(" ", table[32]) if word.isascii() else word.encode().decode("latin-1").translate(table)
                out[i] = [x.id for x in model(plain)]
            else:
                rest.append(i)
        for i, x in zip(rest, encode([words[i] for i in rest], add_special_tokens=False) if rest else [], strict=True):
            out[i] = x.ids
        return out

    blanks = "".join(f"\\x{{{x:x}}}" for x in BLANKS)
    odd = rf"[{blanks}{CUT}]|[ \n][ \n]|\A[ \n]|[ \n]\z"
    return Subwords(BYTE_LEVEL_WORD.findall, cut_byte_level, odd, of_words, tokens, most, whole={bytes([i]) for i in range(256)} <= set(tokens))


def pieces(path: str, most: int = KEPT) -> Subwords:
    """A sentencepiece model. Texts are given with the space in front that the model adds by itself.

    Words are cut before spaces that follow other characters; where a piece of the vocabulary lies across such a place, texts aren't cut.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    tokens = [bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
    blank = model.piece_to_id("▁")

    def of_words(words: list[str]) -> list[list[int]]:
        found = model.encode([x[1:] for x in words], num_threads=1) if words else []
        return [ids if len(x) > 1 else [blank] for x, ids in zip(words, found, strict=True)]  # an empty text isn't given its space

    crossed = any(re.search("[^▁]▁", x) for x in names)
    if crossed:
        return Subwords(lambda x: [x], None, "", of_words, tokens, most)
    return Subwords(PIECE_WORD.findall, cut_pieces, rf"▁|{CUT}|  | \z", of_words, tokens, most)


#: A worker keeps its tokenizers, with their words, for later partitions.
_LOADED: dict[tuple[str, str, int], Subwords] = {}


def loaded(kind: str, path: str, most: int = KEPT) -> Subwords:
    if (kind, path, most) not in _LOADED:
        _LOADED[kind, path, most] = {"byte_level": byte_level, "pieces": pieces}[kind](path, most)
    return _LOADED[kind, path, most]
