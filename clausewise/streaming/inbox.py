"""An inbox of contracts: files that arrive in a folder become clauses, each contract once.

A file source remembers in the checkpoint which files belong to which batch, so a batch that died is
given again with the same files; its rows replace those of the first try, because a batch writes to a
partition of its own and overwrites it. A reader of `clauses` therefore sees each contract once, whatever
was killed when. The same contract under another name (equal text) is left out by its id, first within a
batch, then against the ids that earlier batches have written.

Defined results: an empty file is no contract (the source gives no row for it); files that change
after they were read are not read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clausewise.operators import segment

SEEN = "doc_id string, path string, batch long"


FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    """(doc_id, path, text) of UTF-8 files as they come, so many a batch at most; the id is that of the bytes."""
    found = spark.readStream.schema(FILE).format("binaryFile").option("maxFilesPerTrigger", files).load(folder)
    text = F.regexp_replace(F.coalesce(F.decode("content", "UTF-8"), F.lit("")), "^\ufeff", "")
    return found.select(F.substring(F.sha2("content", 256), 1, 12).alias("doc_id"), "path", text.alias("text"))


def known(spark: SparkSession, out: str, before: int) -> DataFrame:
    """Contracts that batches before this one have taken in; a batch's own first try is not among them."""
    try:
        return spark.read.schema(SEEN).parquet(f"{out}/contracts").where(F.col("batch") < before)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SEEN)


def taken(batch: DataFrame, number: int, out: str) -> None:
    """One batch: new contracts and their clauses, in partitions of the batch's number, which a second try overwrites."""
    spark = batch.sparkSession
    one = batch.groupBy("doc_id").agg(F.min_by(F.struct("path", "text"), "path").alias("c")).select("doc_id", "c.path", "c.text")
    new = one.join(known(spark, out, number).select("doc_id"), "doc_id", "left_anti")
    write = lambda df, name: df.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/{name}")
    write(segment.clauses(new).drop("path"), "clauses")
    write(new.select("doc_id", "path"), "contracts")


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, files: int = 1000, once: bool = False, take=taken) -> StreamingQuery:
    """Takes in what arrives; once: what is there now, in batches, and then ends."""
    stream = arriving(spark, folder, files).writeStream.foreachBatch(lambda df, n: take(df, n, out)).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="10 seconds")).start()
