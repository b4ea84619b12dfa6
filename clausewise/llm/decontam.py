"""Benchmark decontamination by a generalised suffix automaton of the test items' words.

All items go into one automaton over word numbers. A document's words stream through it; the state
carries the longest run of words that ends here and occurs in some item. Where the run is as long as
a window, the window's words are hit, and the state's ancestor at the window's length says in which
items it occurs; an item shorter than a window is a window itself, found as a suffix of the state.
Stretches in which no two neighbouring words are neighbours in any item can't hold a run of two; they
are skipped before streaming (numpy), which changes no result.

Bounds: one automaton is built on the driver from at most `most_words` words of items; more items are
dealt to several automata, which a document passes one after another (their spans and items unite).

Defined results: null has no words; a benchmark without words hits nothing; null item_ids are left
out of the ids but their windows hit; repeated items count once by item_id; repeated documents each
have a row; other columns pass through, an own column named like a result gives way.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import with_result

WINDOW = 10
MOST_WORDS = 2_000_000
#: Bytes that are no part of a word, as spaces: all of ASCII but digits and lower-case letters (upper case is lowered first).
PARTING = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
NAMES = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(PARTING).split()


@dataclass
class Automaton:
    window: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    length: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    items: dict[int, set[str]] = field(default_factory=dict)  # by state
    short: dict[int, set[str]] = field(default_factory=dict)  # whole items shorter than a window, by state
    least: int = 0  # words of the shortest window
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    deep: list[int] = field(default_factory=list)  # each state's ancestor at the window's length
    tails: dict[int, list[tuple[int, frozenset]]] = field(default_factory=dict)  # short items that end at a state

    def extend(self, last: int, c: int) -> int:
        nxt = self.step[last].get(c)
        if nxt is not None:
            if self.length[nxt] == self.length[last] + 1:
                return nxt
            return self.clone(last, c, nxt)
        new = self.state(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.step[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self.clone(p, c, q)
        return new

    def state(self, length: int) -> int:
        self.length.append(length)
        self.link.append(0)
        self.step.append({})
        return len(self.length) - 1

    def clone(self, p: int, c: int, q: int) -> int:
        new = self.state(self.length[p] + 1)
        self.step[new] = dict(self.step[q])
        self.link[new] = self.link[q]
        self.link[q] = new
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = new
            p = self.link[p]
        return new

    @classmethod
    def of(cls, items: list[tuple[str | None, list[bytes]]], window: int) -> Automaton:
        a = cls(window)
        numbered = [(i, [a.vocabulary.setdefault(w, len(a.vocabulary)) for w in ws]) for i, ws in items if ws]
        for _, ids in numbered:
            last = 0
            for c in ids:
                last = a.extend(last, c)
        for i, ids in numbered:  # states are final now
            own = {i} - {None}
            s = 0
            for k, c in enumerate(ids):
                s = a.step[s][c]
                if len(ids) >= window and k + 1 >= window:
                    a.items.setdefault(s, set()).update(own)
            if len(ids) < window:
                a.short.setdefault(s, set()).update(own)
                a.tails.setdefault(s, [])
        a.least = min([len(ids) if len(ids) < window else window for _, ids in numbered], default=0)
        n = len(a.vocabulary)
        a.pairs = np.unique(np.array([x * n + y for _, ids in numbered for x, y in zip(ids, ids[1:], strict=False)], dtype=np.int64))
        order = sorted(range(len(a.length)), key=lambda s: a.length[s])
        a.deep = [-1] * len(a.length)
        for s in order[1:]:
            up = a.link[s]
            if a.length[s] >= window:
                a.deep[s] = s if a.length[up] < window else a.deep[up]
            own = [(a.length[s], frozenset(a.short[s]))] if s in a.short else []
            if got := own + a.tails.get(up, []):
                a.tails[s] = got
        for s in reversed(order):
            if s in a.items and a.length[a.link[s]] >= window:
                a.items.setdefault(a.link[s], set()).update(a.items[s])
        return a

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans of words (half-open, joined) and the items whose windows occur."""
        n = len(ws)
        if not self.least or n < self.least:
            return [], set()
        get = self.vocabulary.get
        ids = np.fromiter([get(w, -1) for w in ws], np.int64, n)
        if self.least == 1:
            able = ids >= 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], able, [False]]).astype(np.int8)))
            runs = edges.reshape(-1, 2)
        else:
            (at,) = np.nonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            keys = ids[at] * len(self.vocabulary) + ids[at + 1]
            place = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            able = np.zeros(n - 1, dtype=bool)
            if len(self.pairs):
                able[at] = self.pairs[place] == keys
            edges = np.flatnonzero(np.diff(np.concatenate([[False], able, [False]]).astype(np.int8)))
            runs = edges.reshape(-1, 2) + [0, 1]
            runs = runs[runs[:, 1] - runs[:, 0] >= self.least]
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        step, length, link, window = self.step, self.length, self.link, self.window
        for a, b in runs.tolist():
            s = l = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                while s and c not in step[s]:
                    s = link[s]
                    l = length[s]
                if c in step[s]:
                    s = step[s][c]
                    l += 1
                if l >= window:
                    spans.append((i + 1 - window, i + 1))
                    found |= self.items.get(self.deep[s], set())
                for k, own in self.tails.get(s, ()):
                    if k <= l:
                        spans.append((i + 1 - k, i + 1))
                        found |= own
        return united(spans), found


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def automata(benchmark: DataFrame, window: int = WINDOW, most_words: int = MOST_WORDS) -> list:
    """Broadcast automata over the items, each of so many words at most (an item longer than that has its own)."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").distinct().orderBy("item_id", "text")
    out, own, held = [], [], 0
    spark = benchmark.sparkSession
    for r in rows.toLocalIterator():
        ws = words(r["text"])
        if own and held + len(ws) > most_words:
            out.append(spark.sparkContext.broadcast(Automaton.of(own, window)))
            own, held = [], 0
        own.append((r["item_id"], ws))
        held += len(ws)
    return [*out, spark.sparkContext.broadcast(Automaton.of(own, window))] if own else out


def matched(text: str | None, found: list) -> tuple[int, list[tuple[int, int]], set[str]]:
    """A text's number of words, its hit spans and the items whose windows occur."""
    ws = words(text)
    spans, items = [], set()
    for a in found:
        s, i = a.value.scan(ws)
        spans, items = united(spans + s) if spans else s, items | i
    return len(ws), spans, items


def scanner(found: list):
    """A column function: text to its digest and hit spans."""

    @F.pandas_udf("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<struct<start:int,end:int>>")
    def scan(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        none = hashlib.sha256(b"").hexdigest()
        for texts in it:
            rows = []
            for t in texts:
                n, spans, items = matched(t, found)
                hit = sum(b - a for a, b in spans)
                sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest() if items else none
                rows.append((n, hit, len(items), sha, hit > 0, [{"start": a, "end": b} for a, b in spans]))
            yield pd.DataFrame(rows, columns=NAMES)

    return scan


def scan(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """documents with n_words, n_hit, n_items, items_sha256, contaminated and hit_spans (in words)."""
    return with_result(documents, scanner(automata(benchmark, window))("text"), NAMES)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them; the white space around a hole becomes one space."""
    data = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORD.finditer(data.lower())]
    out, done = [], 0
    for a, b in spans:
        out.append(data[done : at[a][0]].rstrip(b" "))
        done = at[b - 1][1]
        while done < len(data) and data[done : done + 1] == b" ":
            done += 1
    out.append(data[done:])
    return b" ".join(x for x in out if x).decode("utf-8", "surrogatepass")


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """documents without hit spans; a document of which more than `coverage` of the words are hit goes. n_chars, if there, follows the text."""
    found = automata(benchmark, window)

    @F.pandas_udf("keep boolean, text string")
    def cleaned(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        """One pass over a text: whether it stays, and its rest where passages go (else null)."""
        for texts in it:
            keep, rest = [], []
            for t in texts:
                n, spans, _ = matched(t, found)
                keep.append(sum(b - a for a, b in spans) <= coverage * n)
                rest.append(without(t, spans) if spans and keep[-1] else None)
            yield pd.DataFrame({"keep": keep, "text": pd.Series(rest, dtype=object)})

    own = [c for c in documents.columns if c not in NAMES]
    once = cleaned.asNondeterministic()  # else the filter below is moved under the projection, and every text is scanned twice
    left = documents.select("*", once("text").alias("__clean")).where("__clean.keep").withColumn("__text", F.coalesce("__clean.text", "text"))
    return left.select(*[F.col("__text").alias(c) if c == "text" else F.length("__text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in own])


ORACLE = """
WITH items AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0)
), docs AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents
), places AS (
  SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
), found AS (
  SELECT r, p, places.n AS n, item_id FROM places JOIN windows ON windows.n = places.n AND windows.s = array_to_string(w[p : p + places.n - 1], ' ')
), hits AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + n - 1)) AS q FROM (SELECT DISTINCT r, p, n FROM found)) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""
