"""Language identification by averaged hashed subwords.

A document is the average of the vectors of its character n-grams (2 to 4 characters, inside words
and at their borders), each found by a rolling hash; a linear softmax on top gives the language.
Vectors and softmax are trained together by stochastic gradient descent in numpy. A part of the
training rows sets the temperature of the softmax and the score below which an answer is rejected.

Since average and softmax are linear, prediction folds both into one table of a row per hash.

Bounds: `rows` training rows, dealt evenly to the languages but `LEAST` to each at least (so rows or
`LEAST` times the languages, whichever is more), of distinct doc_ids, so that a rare language is learned; reduced to hash counts on the executors (never more than the
number of hashes per row). Every text is read whole.

Defined results: a null text or one without a letter gives `und` with score 0 and is rejected;
without training rows every answer is `und`; ties go to the first language in order of code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.llm.common import fold, slices, with_result

BUCKETS = 1 << 16
DIMENSIONS = 16
#: Training rows of a language, where it has them.
LEAST = 50
#: Characters whose arrays are held at once in prediction: few, so that they stay in the processor's cache.
PREDICT_CHARS = 100_000
NAMES = ("lang_pred", "score", "rejected")


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (3, n) at each position, which of them count, where each text starts, and each text's letters."""
    low = [t.lower() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])]).astype(np.int64)
    c = np.frombuffer((" ".join(low) + "    ").encode("utf-32-le", "surrogatepass"), "<u4")
    letter = letters()[c]
    c = np.where(letter, c, 32).astype(np.uint32)
    n = starts[-1]
    a, b, d, e = (c[k : k + n] for k in range(4))
    la, lb, ld = letter[:n], letter[1 : 1 + n], letter[2 : 2 + n]
    two = a * np.uint32(2654435761) ^ (b + np.uint32(0x9E3779B9)) * np.uint32(2246822519)
    three = (two ^ (two >> np.uint32(15))) * np.uint32(3266489917) ^ d * np.uint32(668265263)
    four = (three ^ (three >> np.uint32(13))) * np.uint32(374761393) ^ e * np.uint32(2654435761)
    ids = np.stack([(h ^ (h >> np.uint32(16))) & np.uint32(BUCKETS - 1) for h in (two, three + np.uint32(7), four + np.uint32(13))])
    valid = np.stack([la | lb, lb, lb & ld])
    return ids, valid, starts, sums(la.astype(np.int64), starts)


def sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *x.shape[1:]), dtype=np.float64 if x.dtype.kind == "f" else np.int64), np.cumsum(x, axis=0, dtype=np.float64 if x.dtype.kind == "f" else np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's hashes and how often each occurs, in slices, so that long texts take no more memory."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    text = text or ""
    for at in range(0, len(text), 1 << 20):
        ids, valid, _, _ = grams([text[at : at + (1 << 20)]])
        total += np.bincount(ids[valid], minlength=BUCKETS)
    (k,) = np.nonzero(total)
    return k.astype(np.int32), total[k]


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    table: np.ndarray  # float32 (BUCKETS, languages)
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language, -1 without a letter, and the score."""
        found, scores = [], []
        table = np.vstack([self.table, np.zeros((1, len(self.languages)), dtype=np.float32)])  # the last row is for what doesn't count
        for part in slices(texts, PREDICT_CHARS):
            ids, valid, starts, letters_in = grams(part)
            ids = np.where(valid, ids, np.uint32(BUCKETS)).astype(np.intp)
            z = np.take(table, ids[0], axis=0)
            z += np.take(table, ids[1], axis=0)
            z += np.take(table, ids[2], axis=0)
            z = np.add.reduceat(z, starts[:-1], axis=0).astype(np.float64)  # every text has its space at least
            n = np.add.reduceat(valid.sum(axis=0), starts[:-1])
            z = (z / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
            p = softmax(z)
            none = letters_in == 0
            found.append(np.where(none, -1, p.argmax(1)))
            scores.append(np.where(none, 0.0, p.max(1)))
        return (np.concatenate(found), np.concatenate(scores)) if found else (np.zeros(0, int), np.zeros(0))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: list[str], epochs: int = 4, rate: float = 2.0, batch: int = 32, seed: int = 7, precision: float = 0.99) -> LanguageModel | None:
    """rows: hashes and counts of each document."""
    rows, y = zip(*[(r, v) for r, v in zip(rows, y, strict=True) if len(r[0])], strict=True) if any(len(r[0]) for r in rows) else ((), ())
    if not rows:
        return None
    names = tuple(sorted(set(y)))
    target = np.array([names.index(v) for v in y])
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = np.zeros((DIMENSIONS, len(names)), dtype=np.float32)
    weights[: min(DIMENSIONS, len(names)), : min(DIMENSIONS, len(names))] += np.eye(min(DIMENSIONS, len(names)), dtype=np.float32)
    bias = np.zeros(len(names), dtype=np.float32)
    order = rng.permutation(len(rows))
    held = order[: len(order) // 5]
    learn = order[len(order) // 5 :] if len(order) >= 10 else order
    steps, total = 0, epochs * max(1, -(-len(learn) // batch))
    for _ in range(epochs):
        learn = rng.permutation(learn)
        for at in range(0, len(learn), batch):
            now = learn[at : at + batch]
            k = np.concatenate([rows[i][0] for i in now])
            share = np.concatenate([rows[i][1] / rows[i][1].sum() for i in now]).astype(np.float32)
            doc = np.repeat(np.arange(len(now)), [len(rows[i][0]) for i in now])
            first = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in now])[:-1]])
            h = np.add.reduceat(vectors[k] * share[:, None], first, axis=0)
            p = softmax(h @ weights + bias)
            p[np.arange(len(now)), target[now]] -= 1
            p = (p / len(now)).astype(np.float32)
            pace = np.float32(rate * (1 - steps / total))
            back = p @ weights.T
            weights -= pace * h.T @ p
            bias -= pace * p.sum(0)
            np.add.at(vectors, k, (-pace * 40) * share[:, None] * back[doc])
            steps += 1
    table = (vectors @ weights).astype(np.float32)
    check = held if len(held) else order
    z = np.array([(table[rows[i][0]] * (rows[i][1] / rows[i][1].sum())[:, None]).sum(0) + bias for i in check])
    losses = {t: -np.log(softmax(z / t)[np.arange(len(check)), target[check]] + 1e-12).mean() for t in 2.0 ** np.arange(-3, 3.1, 0.5)}
    temperature = min(losses, key=lambda t: (losses[t], t))
    p = softmax(z / temperature)
    right, best = p.argmax(1) == target[check], p.max(1)
    down = np.argsort(-best, kind="stable")
    good = np.nonzero(np.cumsum(right[down]) / np.arange(1, len(down) + 1) >= precision)[0]
    threshold = float(best[down[good[-1]]]) if len(good) else 1.0
    return LanguageModel(names, table, bias.astype(np.float64), float(temperature), min(threshold, 0.5 + 0.5 / len(names)))


def fit(documents: DataFrame, usable: Column, rows: int = 2000) -> LanguageModel | None:
    """usable: which rows may be learned from."""
    known = documents.where(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    n = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each language
    each = max(LEAST, rows // max(1, len(n)))
    part = F.coalesce(*[F.when(F.col("lang") == v, F.lit(min(1.0, 2 * each / c))) for v, c in sorted(n.items())], F.lit(0.0))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < part * (1 << 30))  # about twice as many, before they are put in order
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id"))
    keys = some.withColumn("place", place).where(F.col("place") <= each).select("doc_id", "lang")

    @F.pandas_udf("ids binary, counts binary")
    def reduced(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in it:
            both = [counted(t) for t in texts]
            yield pd.DataFrame({"ids": [a.astype("<i4").tobytes() for a, _ in both], "counts": [b.astype("<i4").tobytes() for _, b in both]})

    found = documents.where(F.col("lang").isNotNull()).select("doc_id", "text").join(F.broadcast(keys), "doc_id").select("doc_id", "lang", reduced("text").alias("r")).orderBy("doc_id", "r").collect()
    return train([(np.frombuffer(r["r"]["ids"], "<i4"), np.frombuffer(r["r"]["counts"], "<i4")) for r in found], [r["lang"] for r in found])


def identify(documents: DataFrame, model: LanguageModel | None) -> DataFrame:
    """documents with lang_pred, score and rejected (the score is under the calibrated threshold)."""
    if model is None:
        return with_result(documents, F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")), NAMES)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a table of a fixed size

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predicted(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        names = np.array([*m.languages, "und"], dtype=object)
        for texts in it:
            best, s = m.predict(texts.tolist())
            yield pd.DataFrame({"lang_pred": names[best], "score": s, "rejected": (best < 0) | (s < m.threshold)})

    return with_result(documents, predicted("text"), NAMES)


__all__ = ["LanguageModel", "fit", "fold", "identify", "train"]
