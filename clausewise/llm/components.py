"""Connected components of links between long ids, by large and small stars, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import cut


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links: (u, v) longs, any order. Returns (node, root), a row for each node of a link; root is the component's smallest node.

    In every round each node hands its larger neighbours to its smallest one (large star), then its
    smaller ones (small star); the sum of labels falls until nothing changes. Minima combine before they
    are shuffled, so a node with very many links is a few partial rows; the joins back are split by
    adaptive execution where a node is hot. Each round is a checkpoint in the shared folder.
    """
    edges = cut(links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("m <> u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == (now["n"], now["s"]):
            break
        before = (now["n"], now["s"])
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
