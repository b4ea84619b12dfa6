"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled text. A text is cut into
blocks of equal length, so that a dictionary counts as much at its end as at its start, and each
block is compressed with either. The difference of the two sums, divided by the text's length, and
the compressed length itself become a score through a logistic calibration on labelled rows that the
dictionaries have not seen.

Bounds: `rows_per_class` labelled rows of a class at most, of each at most `fit_bytes` bytes for a
dictionary (blocks spread evenly over the text). Every text is scored whole.

Defined results: null and empty texts score as text of length zero (what the calibration gives at
zero); without labels of both classes every score is 0.5; rows with a null label, and labels of
unknown documents, are not learned from; repeated label rows count once; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import fold, logistic, smallest, with_result

BLOCK = 1024
LEVEL = 3
NAMES = ("score", "predicted")


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def features(self, texts) -> np.ndarray:
        """For each text: (bytes with the bad dictionary - bytes with the good one) / length, bytes with the good one / length, log length."""
        sides = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            sides.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
        good, bad = sides
        out = np.zeros((len(texts), 3))
        for i, t in enumerate(texts):
            data = (t or "").encode("utf-8", "surrogatepass")
            if data:
                g = b = 0
                for at in range(0, len(data), BLOCK):
                    part = data[at : at + BLOCK]
                    g += len(good(part))
                    b += len(bad(part))
                out[i] = (b - g) / len(data), g / len(data), np.log1p(len(data)) / 10
        return out

    def scores(self, texts) -> np.ndarray:
        return calibrated(self.features(texts), self.weights)


def widened(x: np.ndarray) -> np.ndarray:
    """The calibration's terms: difference, size, their squares, and both against the length."""
    d, s, n = x.T
    return np.column_stack([10 * d, s, n, 100 * d * d, s * s, 10 * d * s, 10 * d * n, s * n])


def calibrated(x: np.ndarray, weights) -> np.ndarray:
    if not len(x):
        return np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(widened(x) @ np.array(weights[:-1]) + weights[-1], -30, 30)))


def spread(text: str | None, limit: int) -> list[bytes]:
    """Blocks of a text, evenly spaced, of so many bytes together at most."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = -(-len(data) // BLOCK)
    take = min(n, limit // BLOCK)
    return [data[k * BLOCK : (k + 1) * BLOCK] for k in sorted({i * n // take for i in range(take)})] if take else []


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b" "


def labelled(documents: DataFrame, labels: DataFrame, label: str, usable: Column, n: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y): at most n rows of either class, joined to their texts; and the rows of each class there are."""
    known = labels.where(usable & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y")).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    some = smallest(known.where("y = 0"), "doc_id", n).unionByName(smallest(known.where("y = 1"), "doc_id", n))
    return documents.select("doc_id", "text").join(F.broadcast(some), "doc_id"), counts


def fit(documents: DataFrame, labels: DataFrame, usable: Column, rows_per_class: int = 2000, fit_bytes: int = 4096, dictionary_bytes: int = 65536) -> QualityModel | None:
    """usable: which doc_ids may be learned from."""
    sample, counts = labelled(documents, labels, "quality", usable, rows_per_class)
    learn = fold(F.col("doc_id"), 2) == 0

    @F.pandas_udf("array<binary>")
    def parts(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            yield pd.Series([spread(t, fit_bytes) for t in texts])

    blocks: dict[int, list[bytes]] = {0: [], 1: []}
    for r in sample.where(learn).select("doc_id", "y", parts("text").alias("parts")).orderBy("doc_id", "parts").collect():
        blocks[r["y"]] += map(bytes, r["parts"])
    if not blocks[0] or not blocks[1]:
        return None
    model = QualityModel(dictionary(blocks[1], dictionary_bytes), dictionary(blocks[0], dictionary_bytes), ())

    @F.pandas_udf("array<double>")
    def measured(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            yield pd.Series(list(model.features(list(texts))))

    rows = sample.where(~learn).select("doc_id", "y", measured("text").alias("x")).orderBy("doc_id", "x").collect()
    y = np.array([r["y"] for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return None
    share = np.array([counts[int(v)] / max(1, (y == v).sum()) for v in y])
    weights = logistic(widened(np.array([r["x"] for r in rows])), y, share / share.mean())
    return QualityModel(model.good, model.bad, tuple(map(float, weights)))


def score(documents: DataFrame, model: QualityModel | None) -> DataFrame:
    """documents with score (0 to 1) and predicted (1 from 0.5 on)."""
    if model is None:
        return with_result(documents, F.struct(F.lit(0.5).alias("score"), F.lit(1).alias("predicted")), NAMES)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size

    @F.pandas_udf("score double, predicted int")
    def scored(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in it:
            s = shared.value.scores(texts.tolist())
            yield pd.DataFrame({"score": s, "predicted": (s >= 0.5).astype("int32")})

    return with_result(documents, scored("text"), NAMES)
