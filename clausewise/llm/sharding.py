"""Sharding by longest processing time.

Groups that must stay together (equal texts) are placed from the largest down, each on the shard that
holds least, through a heap. Groups whose bytes agree in their leading bits form a class (1,023 exact
sizes, then 512 to each doubling: under 30,000 classes for any input), and the driver places classes: a class of many groups is poured
level over the shards and only its rest goes through the heap, which is what placing its groups one
by one gives up to the 0.2 % by which sizes within a class differ. The groups themselves never leave
the executors; each finds its shard by its rank within its class.

Law `bytes`: the shards' bytes are as near equal as groups that can't be split allow; a group larger
than a shard's fair part has a shard to itself.

Defined results: a null text has no bytes and no checksum bytes (crc32 of nothing, 0), and forms a
group apart from empty texts; null doc_ids come first in their shard; repeated rows each have a slot;
other columns pass through `shard` untouched, an own column named like a result gives way.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.llm.common import cut, partitions, with_result

RANK_PARTS = 64


def text_key(column: str = "text") -> Column:
    """32 bytes that equal texts share; null has a key of its own."""
    return F.coalesce(F.unhex(F.sha2(F.col(column).cast("binary"), 256)), F.lit(b"null").cast("binary"))


def size_class(b: str) -> Column:
    """The ten leading bits of a size, the others zero."""
    shift = f"greatest(length(bin({b})) - 10, 0)"
    return F.expr(f"shiftleft(shiftright({b}, {shift}), {shift})")


def place(classes: list[tuple[int, int, int]], shards: int) -> dict[int, list[int]]:
    """classes: (class, groups, bytes). Of each class how many of its groups each shard takes; largest first."""
    heap = [(0.0, s) for s in range(shards)]
    out: dict[int, list[int]] = {}
    for c, n, total in sorted(classes, reverse=True):
        took, each = [0] * shards, total / n
        if n > 4 * shards and each > 0:
            loads = sorted(heap)
            low, high = loads[0][0], loads[-1][0] + each * n
            for _ in range(100):
                level = (low + high) / 2
                if sum(max(0, int((level - x) // each)) for x, _ in loads) <= n:
                    low = level
                else:
                    high = level
            heap = []
            for x, s in loads:
                took[s] = max(0, int((low - x) // each))
                heap.append((x + took[s] * each, s))
            heapq.heapify(heap)
        for _ in range(n - sum(took)):
            x, s = heap[0]
            heapq.heapreplace(heap, (x + each, s))
            took[s] += 1
        out[c] = took
    return out


def assign(groups: DataFrame, shards: int) -> DataFrame:
    """groups: (key, bytes), keys distinct. Returns (key, shard)."""
    spark = groups.sparkSession
    classed = groups.withColumn("class", size_class("bytes")).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(RANK_PARTS)))
    counted = classed.groupBy("class", "part").agg(F.count("*").alias("n"), F.sum("bytes").alias("total"))
    counted = cut(counted)
    classes = [tuple(r) for r in counted.groupBy("class").agg(F.sum("n"), F.sum("total")).collect()]
    took = [(c, [sum(t[: i + 1]) for i in range(shards)]) for c, t in place(classes, shards).items()]
    ends = spark.createDataFrame(took, "class long, ends array<long>")
    before = counted.select("class", "part", F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = classed.withColumn("rank", F.row_number().over(Window.partitionBy("class", "part").orderBy("key")) - 1)
    return (
        ranked.join(before, ["class", "part"])
        .join(F.broadcast(ends), "class")  # a row for each class, under 30,000
        .select("key", F.expr("size(filter(ends, e -> e <= rank + before))").alias("shard"))
    )


def numbered(rows: DataFrame, order: list[str], parts: int) -> DataFrame:
    """rows with slot, gapless from 0 in each shard. Slots run through parts of a shard, so that no task holds a whole shard."""
    own = rows.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    counts = own.groupBy("shard", "__part").agg(F.count("*").alias("n"))
    before = counts.select("shard", "__part", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    ranked = own.withColumn("__rank", F.row_number().over(Window.partitionBy("shard", "__part").orderBy(*order)) - 1)
    return ranked.join(F.broadcast(before), ["shard", "__part"]).withColumn("slot", (F.col("__rank") + F.col("__before")).cast("long")).drop("__part", "__rank", "__before")  # shards x parts rows


def digest(documents: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): where each document goes."""
    rows = cut(documents.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), text_key().alias("key")))
    shard_of = assign(rows.groupBy("key").agg(F.sum("size").alias("bytes")), shards)
    placed = cut(rows.join(shard_of, "key").select("doc_id", "size", "text_crc32", "shard"))
    parts = max(1, -(-2 * partitions(documents.sparkSession) // shards))
    return numbered(placed, ["doc_id", "text_crc32", "size"], parts).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard(documents: DataFrame, shards: int = 24) -> DataFrame:
    """documents with the shard of their group."""
    keyed = documents.withColumn("__key", text_key())
    sizes = keyed.groupBy("__key").agg(F.sum((F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")).alias("bytes"))
    shard_of = assign(cut(sizes.select(F.col("__key").alias("key"), "bytes")), shards)
    joined = keyed.join(shard_of.select(F.col("key").alias("__key"), F.col("shard").cast("int").alias("__shard")), "__key").drop("__key")
    return with_result(joined, F.struct(F.col("__shard").alias("shard")), ["shard"]).drop("__shard")
