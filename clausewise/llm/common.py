"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a worker turns into numpy arrays at once; a longer text is a slice of its own.
SLICE_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or our own where it is unset (tests)."""
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(conf or f"file:///tmp/clausewise-checkpoint-{uuid.uuid4().hex}")
    return conf or sc.getCheckpointDir()


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python workers so many rows at once at most: a worker and its executor hold a tenth of what Spark's default batch takes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut: a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders of rows that were written to be read again; whoever has written the result may clear them.
_scratch: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder."""
    _scratch.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


def drop(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes all scratch folders. DataFrames that read them are of no use then."""
    while _scratch:
        drop(spark, _scratch.pop())


def tidy(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files and checkpoints of finished steps now, which it does when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def with_result(df: DataFrame, result: Column, names: Sequence[str]) -> DataFrame:
    """df with the fields of a struct column beside its own; an own column that has a field's name gives way."""
    taken = {n.lower() for n in names}
    own = [c for c in df.columns if c.lower() not in taken]
    return df.select(*map(col, own), result.alias("__result")).select(*map(col, own), *[col("__result").getField(n).alias(n) for n in names])


def fold(column: Column, n: int) -> Column:
    """crc32 of an id's decimal text, modulo n."""
    return F.crc32(column.cast("string").cast("binary")) % n


def smallest(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows at most, those of the smallest hashes of a key: a bounded sample, the same on every run."""
    return df.orderBy(F.xxhash64(col(key)), col(key)).limit(n)


def slices(texts: Iterable[str | None], chars: int = SLICE_CHARS) -> Iterator[list[str]]:
    """The texts in lists of about so many characters; null reads as empty."""
    part: list[str] = []
    held = 0
    for t in texts:
        t = t or ""
        if part and held + len(t) > chars:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part


def logistic(x, y, weight=None, ridge: float = 1e-3, steps: int = 50):
    """Weights of a logistic regression by Newton's method; the last one is the intercept."""
    import numpy as np

    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return w
