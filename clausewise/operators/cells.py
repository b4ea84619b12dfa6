"""An index of reference vectors: cells around centres, opened by a query only as far as bounds can't rule them out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: What goes to every worker at most: the centres, as doubles.
CENTRE_BYTES = 32_000_000
#: Vectors a cell that the centres are fitted on, at most.
FITTED = 64
#: The cell of vectors without a direction: their score is 0 to all.
NOWHERE = -1
#: What a batch of rows for a worker holds at most, but for a row of its own: rows here are blocks of vectors, so a count of rows bounds nothing.
BATCH_BYTES = 16_000_000
#: Roots of sums near zero are off by some 1e-8; sums of the same products differ in their last digits.
AWAY_SLACK, SLACK = 1e-7, 1e-9


def usable(side: DataFrame) -> DataFrame:
    """Rows with a vector all of whose components are finite numbers."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return side.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.coalesce(finite, F.lit(False)))


def bounded_batches(spark: SparkSession) -> None:
    """Workers get BATCH_BYTES at once at most; a smaller bound of the session's own stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors at length one, zeros as they are."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def known_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each combination of the keys its cells, with how many they hold and how far from the centre."""
    each = rows.groupBy(*keys, "cell").agg(F.count("*").alias("n"), F.min("__away").alias("low"), F.max("__away").alias("high"))
    return each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cell", "n", "low", "high"))).alias("cells"))


def centres_of(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k-means: means of the vectors nearest to each centre; a centre that none is nearest to stays."""
    centres = sample[np.random.default_rng(seed).permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        own = nearest_centre(sample, centres)[0]
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, sample)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest_centre(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    away = distances(vectors, centres)
    own = away.argmin(axis=1)
    return own, away[np.arange(len(own)), own]


def distances(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (vectors**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * vectors @ centres.T
    return np.sqrt(np.maximum(squares, 0.0))


def ceilings(vectors: np.ndarray, centres: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The highest cosine that a vector (of length one or none) can have with one `low` to `high` away from a centre.

    A triangle's third side: no member is nearer to the query than the difference of both distances to
    the centre, and unit vectors at a distance d have the cosine 1 - d*d/2.
    """
    away = distances(vectors, centres)
    gap = np.maximum(0.0, np.maximum(away - high, low - away) - AWAY_SLACK)
    return np.where((vectors != 0).any(1)[:, None], 1 - gap**2 / 2, 0.0)


class Cells:
    """References (ref_id, vector, ...) in cells, and what is known of each cell.

    rows: the references with `cell` and `__v`, the vector at length one. known: for each combination of
    the filter columns `same` its cells with the number of their members and how far these are from the
    centre. Both are DataFrames; only the centres go through the driver, and their size is bounded.
    References without a vector, or with a component that is null or not finite, are in no cell; null
    filter values meet nothing. All vectors must be of one size, else tasks raise ValueError.
    """

    def __init__(self, rows: DataFrame, known: DataFrame, centres: np.ndarray, same: list[str]) -> None:
        self.rows, self.known, self.centres, self.same = rows, known, centres, same

    @staticmethod
    def build(references: DataFrame, same: list[str] | None = None, cells: int | None = None) -> Cells:
        """Centres are fitted on FITTED vectors a cell at most, those with the smallest hashes of their ids; every reference is indexed. cells: about the square root of the number of references, unless told."""
        keys, spark = same or [], references.sparkSession
        good = usable(references)
        pointed = F.exists("vector", lambda x: x != 0)
        size = good.agg(F.count_if(pointed).alias("n"), F.max(F.size("vector")).alias("width")).first()
        n, width = size["n"], size["width"] or 1
        most = max(1, CENTRE_BYTES // (8 * width))
        cells = min(cells or int(np.ceil(np.sqrt(n))) or 1, most, max(n, 1))
        drawn = good.where(pointed).select("ref_id", "vector").orderBy(F.xxhash64("ref_id"), "ref_id").limit(min(cells * FITTED, max(most, cells))).collect()
        sample = unit(np.array([r["vector"] for r in drawn], dtype=np.float64).reshape(-1, width))
        centres = centres_of(sample, cells) if len(sample) else np.zeros((1, width))
        return Cells.dealt(good, centres, keys, spark)

    @staticmethod
    def dealt(references: DataFrame, centres: np.ndarray, keys: list[str], spark: SparkSession) -> Cells:
        sent = spark.sparkContext.broadcast(centres)

        @F.pandas_udf("struct<v:array<double>,cell:int,away:double>")
        def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for vectors in batches:
                m = unit(np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1))
                own, away = nearest_centre(m, sent.value)
                yield pd.DataFrame({"v": list(m), "cell": np.where((m != 0).any(1), own, NOWHERE), "away": away})

        placed = references.withColumn("__p", place("vector"))
        rows = placed.select(*[c for c in references.columns if c != "vector"], F.col("__p.v").alias("__v"), "__p.cell", F.col("__p.away").alias("__away"))
        return Cells(rows, known_of(rows, keys), centres, keys)

    def save(self, folder: str) -> Cells:
        """Rows in a folder for each cell, so that cells that no query opens need not be read; a cell of many rows is written by several tasks. Returns the index as it was written, every reference placed once."""
        spark = self.rows.sparkSession
        self.rows.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/rows")
        known_of(spark.read.schema(self.rows.schema).parquet(f"{folder}/rows"), self.same).write.mode("overwrite").parquet(f"{folder}/known")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres")
        return Cells.load(spark, folder, self.rows.schema)

    @staticmethod
    def load(spark: SparkSession, folder: str, schema: StructType | None = None) -> Cells:
        centres = np.array([r["centre"] for r in spark.read.parquet(f"{folder}/centres").orderBy("cell").collect()])
        known = spark.read.parquet(f"{folder}/known")
        rows = spark.read if schema is None else spark.read.schema(schema)  # an empty index has no file to tell it
        return Cells(rows.parquet(f"{folder}/rows"), known, centres, [c for c in known.columns if c != "cells"])

    # --- search ---

    def asked(self, queries: DataFrame, rows: int) -> DataFrame:
        """Queries of the same filters in blocks of about so many, with the cells that these filters leave."""
        n = max(1, -(-queries.count() // rows))
        floor = F.col("floor") if "floor" in queries.columns else F.lit(None).cast("double")
        blocks = queries.groupBy(*self.same, F.pmod(F.xxhash64("query_id"), F.lit(n)).alias("__block")).agg(F.sort_array(F.collect_list(F.struct(F.col("query_id").alias("id"), F.col("__v").alias("v"), floor.alias("floor")))).alias("own"))
        return blocks.join(self.known, self.same) if self.same else blocks.join(F.broadcast(self.known))  # known is one row then

    def opened(self, queries: DataFrame, k: int, first: bool, rows: int) -> DataFrame:
        """(same..., cell, own): which queries of a block open which cell.

        At first, each opens its most promising cells until they hold k references. Then, knowing the
        score of its k-th so far, each opens all others whose ceiling isn't below it.
        """
        sent = self.rows.sparkSession.sparkContext.broadcast(self.centres)

        @F.pandas_udf("array<struct<cell:int,at:array<int>>>")
        def choose(blocks: pd.Series, known: pd.Series) -> pd.Series:
            out = []
            for own, cells in zip(blocks, known, strict=True):
                cell, n = (np.array([c[f] for c in cells]) for f in ("cell", "n"))
                low, high = (np.array([c[f] for c in cells], dtype=np.float64) for f in ("low", "high"))
                vectors = unit(np.array([list(x["v"]) for x in own], dtype=np.float64))
                top = np.where(cell == NOWHERE, 0.0, ceilings(vectors, sent.value[np.maximum(cell, 0)], low, high))
                order = np.argsort(-top, axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                begun = np.zeros(top.shape, dtype=bool)
                np.put_along_axis(begun, order, before < k, axis=1)
                if first:
                    take = begun
                else:
                    floor = np.array([-np.inf if x["floor"] is None else x["floor"] for x in own])
                    take = ~begun & (top >= floor[:, None] - SLACK)
                out.append([{"cell": int(cell[j]), "at": np.flatnonzero(take[:, j]).tolist()} for j in np.flatnonzero(take.any(0))])
            return pd.Series(out)

        # a worker names places in the block; a cell's queries are copied from there row by row, not all cells' at once
        each = self.asked(queries, rows).select(*self.same, "own", F.explode(choose("own", "cells")).alias("x"))
        return each.select(*self.same, "x.cell", F.transform("x.at", lambda i: F.struct(F.get("own", i)["id"].alias("id"), F.get("own", i)["v"].alias("v"))).alias("own"))

    def met(self, opened: DataFrame, k: int, id_type: str, rows: int) -> DataFrame:
        """(query_id, ref_id, score): k of each block of an opened cell. Cells are dealt to blocks of about so many references, whatever their size."""
        keys = [*self.same, "cell"]
        ref_type = self.rows.schema["ref_id"].dataType.simpleString()
        sizes = self.known.select(*self.same, F.explode("cells").alias("c")).select(*self.same, "c.cell", F.ceil(F.col("c.n") / rows).alias("__parts"))
        wanted = sizes.join(opened.select(*keys).distinct(), keys, "left_semi")
        parts = self.rows.join(wanted, keys).groupBy(*keys, F.pmod(F.xxhash64("ref_id"), "__parts").alias("__part")).agg(F.sort_array(F.collect_list(F.struct(F.col("ref_id").alias("id"), F.col("__v").alias("v")))).alias("others"))

        @F.pandas_udf(f"array<struct<query_id:{id_type},ref_id:{ref_type},score:double>>")
        def best(left: pd.Series, right: pd.Series) -> pd.Series:
            out = []
            for own, others in zip(left, right, strict=True):
                scores = (unit(np.array([list(x["v"]) for x in own], dtype=np.float64)) @ np.array([list(x["v"]) for x in others]).T).round(12)
                tops = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # others are in order of their ids, so ties go to smaller ones
                out.append([{"query_id": x["id"], "ref_id": others[j]["id"], "score": float(scores[i, j])} for i, x in enumerate(own) for j in tops[i].tolist()])
            return pd.Series(out)

        return opened.join(parts, keys).select(F.explode(best("own", "others")).alias("x")).select("x.query_id", "x.ref_id", "x.score")

    def nearest(self, queries: DataFrame, k: int, rows: int = 1000) -> DataFrame:
        """queries (query_id, vector, and the filter columns): (query_id, ref_id, score, rank) of the k nearest by cosine, ties by ref_id, exactly.

        Queries without a usable vector find nothing. A query or reference of zeros scores 0 with all.
        """
        bounded_batches(self.rows.sparkSession)
        id_type = queries.schema["query_id"].dataType.simpleString()
        mine = usable(queries).select(*self.same, "query_id", F.col("vector").alias("__v"))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ref_id")

        def ranked(found: DataFrame) -> DataFrame:
            return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

        begun = ranked(self.met(self.opened(mine, k, True, rows), k, id_type, rows))
        floors = begun.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        rest = self.opened(mine.join(floors, "query_id", "left"), k, False, rows)
        return ranked(begun.drop("rank").unionByName(self.met(rest, k, id_type, rows)))

    def shares(self, queries: DataFrame, k: int, rows: int = 1000) -> DataFrame:
        """(query_id, looked_at, indexed): how many references of the opened cells a query of `nearest` is compared with, of how many that its filters leave."""
        id_type = queries.schema["query_id"].dataType.simpleString()
        mine = usable(queries).select(*self.same, "query_id", F.col("vector").alias("__v"))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ref_id")
        begun = self.opened(mine, k, True, rows)
        floors = self.met(begun, k, id_type, rows).withColumn("rank", F.row_number().over(w)).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        both = begun.unionByName(self.opened(mine.join(floors, "query_id", "left"), k, False, rows))
        sizes = self.known.select(*self.same, F.explode("cells").alias("c")).select(*self.same, "c.cell", "c.n")
        seen = both.select(*self.same, "cell", F.explode("own.id").alias("query_id")).join(sizes, [*self.same, "cell"]).groupBy("query_id").agg(F.sum("n").alias("looked_at"))
        all_ = self.known.select(*self.same, F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c["n"]).alias("indexed"))
        return (mine.join(all_, self.same) if self.same else mine.join(F.broadcast(all_))).select("query_id", "indexed").join(seen, "query_id", "left").select("query_id", F.coalesce("looked_at", F.lit(0)).alias("looked_at"), "indexed")
