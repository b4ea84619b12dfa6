"""Toxic spans by a linear-chain conditional random field.

Two tags, clean and toxic. A token's potential comes from its hashed identity, prefixes and suffixes,
and the identities of its neighbours; the chain adds a potential for each pair of tags. The field is
trained by stochastic gradient on the exact likelihood; forward-backward marginals tag the tokens, and
their sum, largest and share over a document become its score through a logistic calibration.

Labels are given for documents; `token_labels` turns them into labelled tokens. A feature (a word or
a prefix of four letters or more) is marked if it is several times as frequent in toxic texts as in
clean ones and occurs in several distinct toxic texts; marked tokens of toxic documents are the
toxic tokens, all others are clean.

Forward and backward run over all tokens of a slice at once: documents are laid end to end, a
document's first token forgets what came before, the row is cut into chunks, each chunk's 2x2 products
are taken in parallel, and one short pass joins the chunks. The marginals are exact for any length.

Bounds: `rows_per_class` labelled rows of a class at most, of each at most `fit_chars` characters in
even pieces (for the fit alone). Every text is scored whole.

Defined results: null, empty and wordless texts have no tokens and score what the calibration gives at
zero; without labels of both classes every score is 0; other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import fold, logistic, slices, with_result
from clausewise.llm.quality import labelled

BUCKETS = 1 << 18
CHUNK = 128
#: Words whose potentials a worker remembers; beyond that it starts anew.
CACHE = 300_000
WORD = re.compile(r"\w+")
NAMES = ("score", "predicted", "spans")


def features(word: str) -> list[int]:
    """Hashes of a word's own features: itself, prefixes, suffixes."""
    names = ["w" + word, *("p" + word[:k] for k in range(3, min(8, len(word)) + 1)), *("s" + word[-k:] for k in (3, 4) if len(word) >= k)]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for n in names]


def around(word: str) -> tuple[int, int]:
    """Hashes of a word as the one before and as the one after."""
    b = word.encode("utf-8", "surrogatepass")
    return zlib.crc32(b"<" + b) & (BUCKETS - 1), zlib.crc32(b">" + b) & (BUCKETS - 1)


def forward_backward(e: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (n, 2) and pair marginals summed (2, 2) of chains laid end to end; e: (n, 2) positive potentials, first: where a chain begins."""
    n = len(e)
    if not n:
        return np.zeros((0, 2)), np.zeros((2, 2))
    chunks = -(-n // CHUNK)

    def laid(x: np.ndarray, rest: float) -> np.ndarray:
        """(CHUNK, chunks): a step's tokens beside each other."""
        return np.ascontiguousarray(np.concatenate([x, np.full(chunks * CHUNK - n, rest)]).reshape(chunks, CHUNK).T)

    # the step into token t, as a row vector times a matrix; the row's end is filled with steps that change nothing
    m = [[laid(np.where(first, start[i, j], trans[i, j]) * e[:, j], float(i == j)) for j in (0, 1)] for i in (0, 1)]
    (m00, m01), (m10, m11) = m
    w00, w01, w10, w11 = m00[0], m01[0], m10[0], m11[0]
    for k in range(1, CHUNK):
        a0, a1, b0, b1 = m00[k], m01[k], m10[k], m11[k]
        w00, w01, w10, w11 = w00 * a0 + w01 * b0, w00 * a1 + w01 * b1, w10 * a0 + w11 * b0, w10 * a1 + w11 * b1
        if not k & 3:
            s = 1 / (w00 + w01 + w10 + w11)
            w00, w01, w10, w11 = w00 * s, w01 * s, w10 * s, w11 * s
    into, back = np.empty(chunks), np.empty(chunks)  # the first tag's share at a chunk's start, and at its end
    rows = list(zip(w00.tolist(), w01.tolist(), w10.tolist(), w11.tolist(), strict=True))
    now = 0.5
    for c, (x00, x01, x10, x11) in enumerate(rows):
        into[c] = now
        u, v = now * x00 + (1 - now) * x10, now * x01 + (1 - now) * x11
        now = u / (u + v)
    now = 0.5
    for c in range(chunks - 1, -1, -1):
        back[c] = now
        x00, x01, x10, x11 = rows[c]
        u, v = x00 * now + x01 * (1 - now), x10 * now + x11 * (1 - now)
        now = u / (u + v)
    alpha, beta = np.empty((CHUNK, chunks)), np.empty((CHUNK, chunks))
    at = into
    for k in range(CHUNK):
        rest = 1 - at
        u, v = at * m00[k] + rest * m10[k], at * m01[k] + rest * m11[k]
        at = alpha[k] = u / (u + v)
    at = back
    for k in range(CHUNK - 1, -1, -1):
        beta[k] = at
        rest = 1 - at
        u, v = m00[k] * at + m01[k] * rest, m10[k] * at + m11[k] * rest
        at = u / (u + v)
    u, v = alpha * beta, (1 - alpha) * (1 - beta)
    p0 = (u / (u + v)).T.reshape(-1)[:n]
    p = np.stack([p0, 1 - p0], axis=1)
    if not pairs:
        return p, np.zeros((2, 2))
    alpha, beta = alpha.T.reshape(-1)[:n], beta.T.reshape(-1)[:n]
    before = np.concatenate([into[:1], alpha[:-1]])
    both = np.stack([[(f * m[i][j].T.reshape(-1)[:n] * g)[~first] for j, g in ((0, beta), (1, 1 - beta))] for i, f in ((0, before), (1, 1 - before))])
    return p, (both / both.sum(axis=(0, 1))).sum(axis=2) if both.size else np.zeros((2, 2))


@dataclass
class ToxicityModel:
    own: np.ndarray  # difference of the potentials toxic and clean, per hash
    trans: np.ndarray
    start: np.ndarray
    weights: tuple[float, ...] = ()
    cache: dict = field(default_factory=dict, repr=False, compare=False)
    known: array = field(default_factory=lambda: array("d"), repr=False, compare=False)
    table: list = field(default_factory=list, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "cache": {}, "known": array("d"), "table": []}

    def of(self, word: str) -> int:
        """The place of a new word among those remembered."""
        own = self.table
        p, s = around(word)
        got = self.cache[word] = len(self.known) // 3
        self.known.extend((sum([own[k] for k in features(word)]), own[p], own[s]))
        return got

    def tokens(self, texts: list[str]) -> tuple[list[int], np.ndarray]:
        """Words of each text, and each word's three potentials."""
        if not self.table:
            self.table = self.own.tolist()
        if len(self.cache) >= CACHE:
            self.cache.clear()
            del self.known[:]
        get, new, counts, ids = self.cache.get, self.of, [], []
        for t in texts:
            words = WORD.findall(t.lower())
            counts.append(len(words))
            ids += [new(w) if (k := get(w)) is None else k for w in words]
        return counts, np.array(self.known).reshape(-1, 3)[np.array(ids, dtype=np.int64)]

    def marginals(self, texts: list[str]) -> tuple[list[int], np.ndarray]:
        """Words of each text, and for each word the probability that it is toxic."""
        counts, x = self.tokens(texts)
        if not len(x):
            return counts, np.zeros(0)
        first = np.zeros(len(x), dtype=bool)
        first[[at for at, n in zip(np.cumsum([0, *counts[:-1]]), counts, strict=True) if n]] = True
        last = np.append(first[1:], True)
        z = x[:, 0].copy()
        z[1:] += np.where(first[1:], 0, x[:-1, 1])
        z[:-1] += np.where(last[:-1], 0, x[1:, 2])
        z = np.clip(z, -30, 30)
        e = np.stack([np.exp(-z / 2), np.exp(z / 2)], axis=1)
        return counts, forward_backward(e, first, np.exp(self.trans), np.exp(self.start), pairs=False)[0][:, 1]

    def measure(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of each text: log of the toxic words expected, the largest marginal, log of the words, the toxic ones per hundred; and each text's marginals."""
        counts, p = self.marginals(texts)
        out, each, at = np.zeros((len(texts), 4)), [], 0
        for i, n in enumerate(counts):
            own = p[at : at + n]
            at += n
            each.append(own)
            if n:
                total = own.sum()
                out[i] = np.log1p(total), own.max(), np.log1p(n) / 5, np.log1p(100 * total / n)
        return out, each

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights[:-1]) + self.weights[-1], -30, 30))) if len(x) else np.zeros(0)


def spans(text: str, p: np.ndarray, least: float = 0.5) -> list[tuple[int, int]]:
    """Offsets (characters, half-open, in the lower-cased text) of the runs of toxic words."""
    if not (p >= least).any():
        return []
    out: list[tuple[int, int]] = []
    before = False
    for m, x in zip(WORD.finditer(text.lower()), p, strict=True):
        if x >= least:
            if before:
                out[-1] = (out[-1][0], m.end())
            else:
                out.append(m.span())
        before = x >= least
    return out


def token_labels(texts: list[str], y: list[int], ratio: float = 6.0, support: int = 4) -> list[tuple[list[str], np.ndarray]]:
    """Each text's words and their tags, from the labels of the documents."""
    split = [WORD.findall(t.lower()) for t in texts]
    parts = lambda w: {w, *(w[:k] for k in range(4, min(8, len(w)) + 1))}
    often: dict[int, Counter] = {0: Counter(), 1: Counter()}
    among: dict[str, set[int]] = defaultdict(set)
    words = {0: 1, 1: 1}
    for i, (ws, v) in enumerate(zip(split, y, strict=True)):
        words[v] += len(ws)
        for w in ws:
            for f in parts(w):
                often[v][f] += 1
                if v:
                    among[f].add(i)
    clean_docs: Counter = Counter()
    for ws, v in zip(split, y, strict=True):
        if not v:
            clean_docs.update({f for w in ws for f in parts(w)} & among.keys())
    n = {v: max(1, y.count(v)) for v in (0, 1)}
    marked = {
        f
        for f, docs in among.items()
        if len(docs) >= support and often[1][f] / words[1] >= ratio * (often[0][f] + 1) / words[0] and len(docs) / n[1] >= 2 * (clean_docs[f] + 1) / n[0]
    }
    return [(ws, np.array([v and not marked.isdisjoint(parts(w)) for w in ws], dtype=np.int64)) for ws, v in zip(split, y, strict=True)]


def train(rows: list[tuple[list[str], np.ndarray]], epochs: int = 3, rate: float = 0.3, decay: float = 1e-5, clean_share: int = 12, seed: int = 5) -> ToxicityModel:
    """The field's weights; the tokens of a pass are taken in slices of some thousands."""
    rng = np.random.default_rng(seed)
    own, trans, start = np.zeros(BUCKETS), np.zeros((2, 2)), np.zeros((2, 2))
    start[:, 1] = -2.0
    trans[:, 1] = -1.0
    memory: dict[str, tuple[list[int], int, int]] = {}
    seen = np.full(BUCKETS, 1e-2)
    windows = []
    for ws, tags in rows:
        for at in range(0, len(ws), 256):
            windows.append((ws[at : at + 256], tags[at : at + 256]))
    windows = [w for w in windows if len(w[0])]
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 32):
            now = [windows[i] for i in order[at : at + 32]]
            lists, first, tags = [], [], []
            for ws, t in now:
                for w in ws:
                    if w not in memory:
                        memory[w] = (features(w), *around(w))
                for i, w in enumerate(ws):
                    lists.append([*memory[w][0], *([memory[ws[i - 1]][1]] if i else []), *([memory[ws[i + 1]][2]] if i + 1 < len(ws) else [])])
                    first.append(i == 0)
                tags.append(t)
            first_, tags_ = np.array(first), np.concatenate(tags)
            k = np.fromiter((x for f in lists for x in f), np.int64)
            which = np.repeat(np.arange(len(lists)), [len(f) for f in lists])
            z = np.clip(np.bincount(which, own[k], len(lists)), -30, 30)
            p, pair = forward_backward(np.stack([np.exp(-z / 2), np.exp(z / 2)], axis=1), first_, np.exp(trans), np.exp(start))
            g = np.bincount(k, (p[:, 1] - tags_)[which], BUCKETS)
            (hit,) = np.nonzero(g)
            seen[hit] += g[hit] ** 2
            own[hit] -= rate * g[hit] / np.sqrt(seen[hit]) + decay * own[hit]
            true = np.zeros((2, 2))
            np.add.at(true, (tags_[:-1][~first_[1:]], tags_[1:][~first_[1:]]), 1)
            trans -= rate * (pair - true) / max(1, len(lists)) * 5
            begin = np.array([(tags_[first_] == v).sum() - p[first_, v].sum() for v in (0, 1)])
            start += rate * begin / max(1, first_.sum())
    return ToxicityModel(own, trans, start)


def even(text: str | None, limit: int) -> str:
    """A text, or pieces of it of 2,000 characters, evenly spaced."""
    text = text or ""
    if len(text) <= limit:
        return text
    n, take = -(-len(text) // 2000), max(1, limit // 2000)
    return " ".join(text[k * 2000 : (k + 1) * 2000] for k in sorted({i * n // take for i in range(take)}))


def fitted(texts: list[str], y: list[int], share: dict[int, float]) -> ToxicityModel | None:
    """Two thirds of the texts train the field, the rest the calibration. share: weight of a row of each class."""
    texts, y = map(list, zip(*sorted(set(zip(texts, y, strict=True))), strict=True)) if texts else ([], [])
    if len(set(y)) < 2:
        return None
    learn = [zlib.crc32(t.encode("utf-8", "surrogatepass")) % 3 > 0 for t in texts]
    if len({v for v, k in zip(y, learn, strict=True) if k}) < 2 or len({v for v, k in zip(y, learn, strict=True) if not k}) < 2:
        learn = [True] * len(texts)
        check = texts, y
    else:
        check = [t for t, k in zip(texts, learn, strict=True) if not k], [v for v, k in zip(y, learn, strict=True) if not k]
    model = train(token_labels([t for t, k in zip(texts, learn, strict=True) if k], [v for v, k in zip(y, learn, strict=True) if k]))
    x = np.concatenate([model.measure(part)[0] for part in slices(check[0])])
    model.weights = tuple(map(float, logistic(x, np.array(check[1], dtype=float), np.array([share[v] for v in check[1]]), ridge=0.05)))
    return model


def fit(documents: DataFrame, labels: DataFrame, usable: Column, rows_per_class: int = 1000, fit_chars: int = 8000) -> ToxicityModel | None:
    """usable: which doc_ids may be learned from."""
    sample, counts = labelled(documents, labels, "toxic", usable, rows_per_class)

    @F.pandas_udf("string")
    def part(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            yield pd.Series([even(t, fit_chars) for t in texts])

    rows = sample.select("y", part("text").alias("text")).collect()
    y = [r["y"] for r in rows]
    return fitted([r["text"] for r in rows], y, {v: counts.get(v, 1) / max(1, y.count(v)) for v in (0, 1)})


def score(documents: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """documents with score (0 to 1), predicted (1 from 0.5 on) and spans (start, end of toxic runs)."""
    if model is None:
        none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
        return with_result(documents, F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), none.alias("spans")), NAMES)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # weights of a fixed number

    @F.pandas_udf("score double, predicted int, spans array<struct<start:int,end:int>>")
    def scored(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in it:
            s, found = [np.zeros(0)], []
            for part in slices(texts, 500_000):
                x, each = m.measure(part)
                s.append(m.scores(x))
                found += [[{"start": a, "end": b} for a, b in spans(t, p)] for t, p in zip(part, each, strict=True)]
            s = np.concatenate(s)
            yield pd.DataFrame({"score": s, "predicted": (s >= 0.5).astype("int32"), "spans": found})

    return with_result(documents, scored("text"), NAMES)


__all__ = ["ToxicityModel", "fit", "fold", "forward_backward", "score", "spans", "token_labels", "train"]
