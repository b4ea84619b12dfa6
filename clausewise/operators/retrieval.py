"""Reference wordings: shingles, vectors, nearest neighbours with filters and a fallback."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct character n-grams of the lower-cased text with single spaces."""
    t = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(n))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(a) + F.size(b) - both), F.lit(0.0))


def similar_texts(left: DataFrame, right: DataFrame, least: float = 0.8) -> DataFrame:
    """(left_id, right_id, similarity) of texts whose shingle sets have a Jaccard similarity of `least` or more, exactly.

    A pair that similar shares a shingle among the first of each side's shingles in one common order
    (rarest first), so only those few are joined on; and sizes must be within the same ratio.
    """
    l, r = (d.select(F.col("id").alias(f"{n}_id"), shingles(F.col("text")).alias("s")) for d, n in ((left, "left"), (right, "right")))
    often = r.select(F.explode("s").alias("x")).groupBy("x").count()

    def keyed(d: DataFrame, n: str) -> DataFrame:
        ranked = d.select(f"{n}_id", F.size("s").alias("size"), F.explode("s").alias("x")).join(often, "x", "left").select(f"{n}_id", "size", "x", F.coalesce("count", F.lit(0)).alias("c"))
        w = Window.partitionBy(f"{n}_id").orderBy("c", "x")
        return ranked.withColumn("k", F.row_number().over(w)).where(F.col("k") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).select(f"{n}_id", F.col("size").alias(f"{n}_size"), "x")

    pairs = keyed(l, "left").join(keyed(r, "right"), "x").where((F.col("left_size") >= least * F.col("right_size")) & (F.col("right_size") >= least * F.col("left_size"))).select("left_id", "right_id").distinct()
    full = pairs.join(l.withColumnRenamed("s", "a"), "left_id").join(r.withColumnRenamed("s", "b"), "right_id")
    return full.select("left_id", "right_id", jaccard(F.col("a"), F.col("b")).alias("similarity")).where(F.col("similarity") >= least)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def normalized(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v.cast("array<double>"))


def grams(text: str, sizes: tuple[int, ...] = (3, 4, 5)) -> list[str]:
    """Runs of so many characters of words padded by a space; a word shorter than a run is one."""
    padded = [f" {w} " for w in text.lower().split()]
    return [p[i : i + n] for p in padded for n in sizes for i in range(max(1, len(p) - n + 1))]


def hashed_vector(text: Column, size: int = 1024) -> Column:
    """Counts of character n-grams (3 to 5, of padded words) by hash, of length one; all zero without a word, and for null."""

    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.bincount(np.array([zlib.crc32(g.encode("utf-8", "surrogatepass")) % size for g in grams(t or "")], dtype=np.int64), minlength=size).astype(float)
            out.append(v / (np.linalg.norm(v) or 1.0))
        return pd.Series(out)

    return of(text)


def nearest(queries: DataFrame, references: DataFrame, k: int, same: list[str] | None = None, rows: int = 1000) -> DataFrame:
    """queries (query_id, vector), references (ref_id, vector), ids distinct: the k nearest by cosine, ties by ref_id.

    Both sides are dealt to blocks of about so many rows (of the same filter columns); each block of
    queries meets each block of references in one matrix product that hands on k a query, and a window
    ranks those. Columns of both sides come along.
    """
    keys = same or []
    q_type, r_type = (d.schema[c].dataType.simpleString() for d, c in ((queries, "query_id"), (references, "ref_id")))

    def blocks(side: DataFrame, name: str) -> DataFrame:
        n = max(1, -(-side.count() // rows))
        vectors = side.select(*keys, F.pmod(F.xxhash64(name), F.lit(n)).alias(f"{name}_block"), F.struct(F.col(name).alias("id"), normalized(F.col("vector")).alias("v")).alias("x"))
        return vectors.groupBy(*keys, f"{name}_block").agg(F.sort_array(F.collect_list("x")).alias(f"{name}_rows"))

    @F.pandas_udf(f"array<struct<query_id:{q_type},ref_id:{r_type},score:double>>")
    def best(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for own, others in zip(left, right, strict=True):
            scores = np.array([list(x["v"]) for x in own]) @ np.array([list(x["v"]) for x in others]).T
            tops = np.argsort(-scores, axis=1, kind="stable")[:, :k] if len(others) > k else np.tile(np.arange(len(others)), (len(own), 1))
            edge = np.take_along_axis(scores, tops, 1).min(axis=1)
            # sums differ in their last digits: what comes that near to the k-th goes on as well
            out.append([{"query_id": own[i]["id"], "ref_id": others[j]["id"], "score": float(scores[i, j])} for i in range(len(own)) for j in np.flatnonzero(scores[i] >= edge[i] - 1e-9).tolist()])
        return pd.Series(out)

    left, right = blocks(queries, "query_id"), blocks(references, "ref_id")
    met = left.join(right, keys) if keys else left.crossJoin(right)  # rows are blocks
    found = met.select(F.explode(best("query_id_rows", "ref_id_rows")).alias("x")).select("x.query_id", "x.ref_id", F.round("x.score", 12).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ref_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.join(references.drop("vector", *keys), "ref_id").join(queries.drop("vector"), "query_id")


def matching(references: DataFrame, **filters: str | None) -> DataFrame:
    """References that agree with every filter that isn't None."""
    for name, value in filters.items():
        if value is not None:
            references = references.where(F.col(name) == value)
    return references


def nearest_with_fallback(queries: DataFrame, references: DataFrame, k: int, language: str = "lang", fallback: str = "ru", same: list[str] | None = None) -> DataFrame:
    """Nearest within the query's language; queries that find nothing there ask again in the fallback language."""
    keys = [language, *(same or [])]
    own = nearest(queries, references, k, keys)
    left = queries.join(own.select("query_id").distinct(), "query_id", "left_anti").where(F.col(language) != fallback)
    again = nearest(left.withColumn(language, F.lit(fallback)), references, k, keys)
    return own.unionByName(again)


def coverage_gaps(have: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.select(*keys).distinct().join(have.select(*keys).distinct(), keys, "left_anti")


def balance(rows: DataFrame, keys: list[str], side: str, sides: list[str]) -> DataFrame:
    """Counts by side, with zeros."""
    return rows.groupBy(*keys).pivot(side, sides).count().na.fill(0, sides)
