"""Secret scans over a trigram inverted index.

Each rule's pattern gives a Boolean query over trigrams that any match must
contain: an AND of ORs, read off the pattern's parse. Documents are indexed in
segments, one for each Arrow batch: postings from each trigram that some rule
asks for to the segment's documents. A rule's candidates are the documents
left after intersecting its postings; only these are searched with its
pattern. A rule without a mandatory trigram scans all documents.

Defined cases: null and empty texts have no spans; trigrams are of ASCII
lower-cased UTF-8 bytes, so they only ever admit more; texts are searched
whole; repeated rows are searched alike; an empty table gives an empty table;
other columns, whatever their names, aren't read.
Places are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    kind: str
    pattern: str
    #: Least length of the group; shorter matches are dropped after they have used up their text.
    least: int = 0
    group: int = 0
    flags: int = 0


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, re.IGNORECASE | re.ASCII),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
#: Public token formats, and keys in PEM armour.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

#: Most strings a part of a pattern may stand for and still be spelled out.
SPELLED = 32


def _join(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    return {x + y for x in a for y in b} if a is not None and b is not None and len(a) * len(b) <= SPELLED else None


def trigram_query(pattern: str, flags: int = 0) -> list[frozenset[str]]:
    """AND of ORs of trigrams (lower case) that each match contains; empty if there is none."""
    from re import _parser

    needs: list[frozenset[str]] = []

    def ask(run: set[str] | None) -> None:
        """Each string of a run has its trigrams: one must be met for each string."""
        if not run or min(map(len, run)) < 3:
            return
        if len(run) == 1:
            (text,) = run
            needs.extend(frozenset([text[i : i + 3]]) for i in range(len(text) - 2))
        else:  # its first three and last three letters
            needs.append(frozenset(x[:3] for x in run))
            needs.append(frozenset(x[-3:] for x in run))

    def strings(items: list) -> set[str] | None:
        """All strings that a parsed sequence matches, None if too many; asks for what its runs spell out."""
        run: set[str] | None = {""}
        whole = True
        for op, arg in items:
            part: set[str] | None = None
            name = str(op)
            if name == "LITERAL":
                part = {chr(arg).lower()}
            elif name == "SUBPATTERN":
                part = strings(arg[3])
            elif name == "BRANCH":
                every = [strings_alone(x) for x in arg[1]]
                part = set().union(*every) if all(x is not None for x in every) and sum(map(len, every)) <= SPELLED else None
            elif name == "IN":
                if all(str(o) == "LITERAL" for o, _ in arg):
                    part = {chr(a).lower() for _, a in arg}
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = arg
                if low == 0 and int(high) == 1 and (once := strings_alone(inner)) is not None:
                    part = once | {""}
                elif low == int(high) == 1:
                    part = strings(inner)
            joined = _join(run, part)
            if joined is None:
                ask(run)
                whole = False
                run = part if part is not None else {""}
            else:
                run = joined
        if whole:
            return run
        ask(run)
        return None

    def strings_alone(items: list) -> set[str] | None:
        """As strings(), of a part that a match need not contain: it asks for nothing."""
        kept = list(needs)
        out = strings(items)
        needs[:] = kept
        return out

    ask(strings(list(_parser.parse(pattern, flags))))
    return list(dict.fromkeys(needs))


def places(asked: list[str]) -> np.ndarray:
    """For each three bytes, which of the asked trigrams they are, or -1."""
    wanted = np.full(1 << 24, -1, np.int16)
    for i, t in enumerate(asked):
        b = t.encode()
        wanted[b[0] << 16 | b[1] << 8 | b[2]] = i
    return wanted


class Segment:
    """Postings of the asked trigrams over one batch of texts."""

    def __init__(self, texts: list[str], asked: list[str], wanted: np.ndarray) -> None:
        self.n = len(texts)
        raw = [x.encode().lower() for x in texts]
        ends = np.cumsum([len(x) + 2 for x in raw])  # two zero bytes part texts
        text = np.frombuffer(b"\0\0".join(raw) + b"\0\0", np.uint8)
        self.of = {}
        for begin in range(0, max(len(text) - 2, 0), 1 << 20):
            part = text[begin : begin + (1 << 20) + 2].astype(np.int32)
            which = wanted[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            at = np.flatnonzero(which >= 0)
            docs = np.searchsorted(ends, at + begin, side="right")
            for key in np.unique(which[at].astype(np.int64) << 32 | docs).tolist():
                self.of.setdefault(asked[key >> 32], set()).add(key & 0xFFFFFFFF)

    def candidates(self, query: list[frozenset[str]]) -> list[int]:
        if not query:
            return list(range(self.n))
        left = None
        for any_of in query:
            found = set().union(*(self.of.get(t, ()) for t in any_of))
            left = found if left is None else left & found
        return sorted(left)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each row of docs: id_col and spans, an array of (kind, start, end, text) by start, then in the rules' order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = [[q for q in trigram_query(r.pattern, r.flags) if all(len(t.encode()) == 3 for t in q)] for r in rules]
        finders = [re.compile(r.pattern, r.flags) for r in rules]
        asked = sorted({t for q in queries for any_of in q for t in any_of})
        wanted = places(asked)
        for pdf in batches:
            texts = ["" if x is None else x for x in pdf["text"]]
            segment = Segment(texts, asked, wanted)
            spans: list[list[tuple]] = [[] for _ in texts]
            for order, (rule, query, finder) in enumerate(zip(rules, queries, finders, strict=True)):
                for i in segment.candidates(query):
                    spans[i] += [(m.start(), order, rule.kind, m.end(), m[0]) for m in finder.finditer(texts[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
            yield pd.DataFrame({"id": pdf["id"], "spans": [[{"kind": k, "start": s, "end": e, "text": t} for s, _, k, e, t in sorted(x, key=lambda y: y[:2])] for x in spans]})

    out = docs.select(F.col(id_col).cast("string").alias("id"), "text").mapInPandas(run, f"id string, spans array<struct<kind:string,start:int,end:int,text:string>>")
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def span_digest(kinds: list[str] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined; of some kinds only."""
    spans = F.col("spans") if kinds is None else F.filter("spans", lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
