"""A store of reference vectors: Parquet, with what made them beside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewise.operators.retrieval import hashed_vector, normalized


class MismatchError(RuntimeError):
    """The stored vectors were made by something else."""


def embedder(name: str, models: dict[str, Callable[[Column], Column]] | None = None) -> Callable[[Column], Column]:
    """A column function from text to vector: `hashing`, or one of the caller's own (a model needs weights that this library doesn't have)."""
    known = {"hashing": hashed_vector} | (models or {})
    if name not in known:
        raise ValueError(f"no embedder {name!r}; known: {sorted(known)}")
    return known[name]


class Store:
    def __init__(self, spark: SparkSession, folder: str, name: str, version: str) -> None:
        self.spark, self.folder, self.name, self.version = spark, folder, name, version

    def meta(self) -> dict[str, str] | None:
        try:
            return self.spark.read.json(f"{self.folder}/meta").first().asDict()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def generation(self) -> str:
        return f"{self.folder}/rows-{(self.meta() or {}).get('generation', 0)}"

    def rows(self) -> DataFrame:
        self.check()
        return self.spark.read.parquet(self.generation())

    def check(self) -> None:
        m = self.meta()
        if m is not None and (m["embedder"], m["version"]) != (self.name, self.version):
            raise MismatchError(f"made by {m['embedder']} {m['version']}, asked for {self.name} {self.version}")

    def write(self, rows: DataFrame) -> None:
        """A new generation of rows, which the next reader sees: what it is made of may be the one before."""
        next_ = int((self.meta() or {}).get("generation", -1)) + 1
        rows.write.mode("overwrite").parquet(f"{self.folder}/rows-{next_}")
        self.spark.createDataFrame([(self.name, self.version, next_)], "embedder string, version string, generation long").coalesce(1).write.mode("overwrite").json(f"{self.folder}/meta")

    def add(self, rows: DataFrame) -> None:
        """rows (id, vector, ...): new ones come in, those with a known id take its place."""
        self.check()
        new = rows.withColumn("vector", normalized(F.col("vector"))).withColumn("__new", F.lit(1))
        old = new.limit(0) if self.meta() is None else self.rows().withColumn("__new", F.lit(0))
        w = Window.partitionBy("id").orderBy(F.desc("__new"))
        self.write(old.unionByName(new).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new"))

    def load(self, rows: DataFrame, rebuild: bool = False) -> bool:
        """Fills the store anew if it is empty, or of another version and `rebuild` is set. Returns whether it did; raises MismatchError if it should and may not."""
        m = self.meta()
        if m is not None and not rebuild:
            self.check()
            return False
        self.write(rows.withColumn("vector", normalized(F.col("vector"))))
        return True
