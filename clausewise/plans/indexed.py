"""Queries over an index of vectors."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.operators.cells import Cells


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")
    return asked, e.select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("vector"), "label")


def cells(spark: SparkSession, sf_dir: str, same: bool) -> DataFrame:
    """The five nearest by cells and bounds, from an index written to the shared folder: what `knn_topk` and `knn_filtered` find by meeting all."""
    asked, references = sides(spark, sf_dir)
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file:///tmp"
    found = Cells.build(references, ["label"] if same else None).save(f"{base}/cells-{uuid.uuid4().hex}").nearest(asked, 5)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "ref_id", F.round("score", 5).alias("score"))


def queries() -> dict[str, tuple]:
    from clausewise.plans.catalogue import knn_sql

    return {"knn_cells": (partial(cells, same=False), knn_sql(False)), "knn_cells_filtered": (partial(cells, same=True), knn_sql(True))}
