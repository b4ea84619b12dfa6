"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources in code-point order (null last) weigh as given, share `budget` times all words, and
stop at `most` times their own words; what a stopped source leaves goes to the others by weight.

Drawing: a source's documents are laid out in an order of hashes and cut into blocks of equally many
words (the last may be short). An epoch is a random permutation of the blocks, a keyed bijection that
each task evaluates for itself; a target is so many whole epochs and the first blocks of one more, the
last of them in part, so that a source's words are its target rounded to a word. These block quotas
are split among the output shards by a binary tree: at a node the left half's blocks are drawn from
the node's quotas by the multivariate hypergeometric law, so shards are alike in their mix. A shard
takes the next run of each source's permuted blocks, as long as its quota: the runs are disjoint, and
what no shard takes is not in the mix. Within a shard documents are in order of a hash.

Scale: the driver holds a row for each source (and source x shard); a source's layout is numbered in
parts of about `part_words` words, so a source with a third of all rows is spread over many tasks, and
a shard is written in so many pieces.

Defined results: null or wordless texts have size 0 and are never taken; an empty table has no rows;
repeated rows are documents of their own (equal rows may trade places, and lie in one part); reruns
agree, as all choices follow hashes and a fixed seed. `quotas` returns its columns alone; `mix` has all
columns of its input, and own columns mix_shard and mix_order give way.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewise.llm.common import col, cut, partitions

WEIGHTS = (3, 1, 2)
BLOCK = 8192
PART_WORDS = 2_000_000
SHARDS = 64
WORD = r"[^\x20\x09-\x0D]+"
#: Rounds of the bijection on a grid of about the blocks' number, and how often a place beyond the blocks is sent on.
ROUNDS, WALK = 6, 64


def words(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights=WEIGHTS, budget: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, free = {}, budget * sum(sizes.values()), set(order)
    while free:
        total = sum(weight[s] for s in order if s in free)
        over = [s for s in order if s in free and left * weight[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in order if s in free}
            break
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def split_quotas(quotas: list[int], shards: int, seed: int = 17) -> np.ndarray:
    """(shards, sources): how many of each source's draws each shard takes; columns add up to the quotas, rows are within one of each other."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def go(low: int, high: int, own: np.ndarray, ends: np.ndarray) -> None:
        if high - low == 1:
            out[low] = own
            return
        mid = (low + high) // 2
        left = hypergeometric(rng, own, int(ends[mid] - ends[low]))
        go(low, mid, left, ends)
        go(mid, high, own - left, ends)

    total = int(sum(quotas))
    go(0, shards, np.array(quotas, dtype=np.int64), np.array([total * i // shards for i in range(shards + 1)]))
    return out


def hypergeometric(rng: np.random.Generator, own: np.ndarray, n: int) -> np.ndarray:
    """n drawn without replacement from so many of each kind, whatever the numbers."""
    rest, out = int(own.sum()), np.zeros_like(own)
    for i, k in enumerate(own.tolist()):
        rest -= k
        out[i] = drawn(rng, k, rest, n)
        n -= int(out[i])
    return out


def drawn(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws are good, by the inverse of the distribution; its support is cut where less than 1e-30 lies beyond."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mean = n * good / total
    reach = 12 * math.sqrt(n * (good / total) * (bad / total) * (total - n) / max(1, total - 1)) + 12
    low, high = max(low, int(mean - reach)), min(high, int(mean + reach))
    x = np.arange(low, high, dtype=np.float64)
    step = np.log((good - x) * (n - x)) - np.log((x + 1) * (bad - n + x + 1))
    log = np.concatenate([[0.0], np.cumsum(step)])
    p = np.cumsum(np.exp(log - log.max()))
    return low + int(np.searchsorted(p, rng.random() * p[-1], side="right"))


def place(k: str, salt: str) -> str:
    """SQL: the place of block k among `blocks` in the permutation of a salt: rounds on a grid of `wide` x `deep`, again while the place is none of the blocks'."""
    turn = f"""if(r % 2 = 1,
        named_struct('x', pmod(s.x + pmod(xxhash64(s.y, r, {salt}), wide), wide), 'y', s.y),
        named_struct('x', s.x, 'y', pmod(s.y + pmod(xxhash64(s.x, r, {salt}), deep), deep)))"""
    once = f"aggregate(sequence(1L, {ROUNDS}L), named_struct('x', at div deep, 'y', at % deep), (s, r) -> {turn}, s -> s.x * deep + s.y)"
    return f"aggregate(sequence(1, {WALK}), {k}, (at, i) -> if(i > 1 and at < blocks, at, {once}))"


def plan(spark: SparkSession, sizes: dict[str | None, int], shards: int, weights=WEIGHTS, budget: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: int = 17) -> list[tuple]:
    """A row for each source: source, source_size, target, parts, blocks, wide, deep, salts (by epoch), draws, rest (words of the last draw if it is a part), ends (of each shard's run of draws)."""
    goal = targets(sizes, weights, budget, most)
    order = sorted(goal, key=lambda s: (s is None, s or ""))
    grids = []
    for i, s in enumerate(order):
        blocks = -(-sizes[s] // block)
        wide = max(1, math.isqrt(max(blocks - 1, 0)) + 1)
        salts = [1_000_003 * seed + 1_009 * i + e for e in range(epochs(most) + 1)]
        grids.append((i, blocks, wide, max(1, -(-blocks // wide)), salts, int(round(goal[s]) // sizes[s]) if sizes[s] else 0))
    last: dict[int, int] = {}
    if any(g[1] for g in grids):  # where the last block, which may be short, comes in the epoch that is drawn in part
        known = spark.createDataFrame(grids, "i int, blocks long, wide long, deep long, salts array<long>, `full` int").where("blocks > 0")
        last = {r["i"]: r["p"] for r in known.select("i", F.expr(place("blocks - 1", "salts[`full`]")).alias("p")).collect()}
    rows = []
    for (i, blocks, wide, deep, salts, full), s in zip(grids, order, strict=True):
        n = sizes[s]
        short, left = n - (blocks - 1) * block, round(goal[s]) - full * n
        if not n or left <= last[i] * block:
            m, rest = divmod(left, block)
        elif left < last[i] * block + short:
            m, rest = last[i], left - last[i] * block
        else:
            m, rest = divmod(left + block - short, block)
        rows.append((s, n, float(goal[s]), int(max(1, -(-n // PART_WORDS))), blocks, wide, deep, salts, full * blocks + m + (rest > 0), rest))
    ends = np.cumsum(split_quotas([r[8] for r in rows], shards, seed), axis=0).T.tolist() if rows else []
    return [(*r, [int(x) for x in e]) for r, e in zip(rows, ends, strict=True)]


PLAN = "__s string, source_size long, target double, parts long, blocks long, wide long, deep long, salts array<long>, draws long, rest long, ends array<long>"


def epochs(most: float) -> int:
    return max(1, math.ceil(most))


def piece(epoch: int, block: int) -> str:
    """SQL: of a document from word `at` on what a shard takes from it with block k in an epoch: words lo to hi of the document, and the shard; none without a shard."""
    end = f"least(at + size, (k + 1) * {block}L, if(rest > 0 and place + 1 = draws, k * {block}L + rest, source_size))"
    found = f"transform(array({epoch} * blocks + {place('k', f'salts[{epoch}]')}), place -> named_struct('lo', greatest(at, k * {block}L) - at, 'hi', {end} - at, 'shard', size(filter(ends, e -> e <= place))))"
    return f"element_at({found}, 1)"


def laid_out(documents: DataFrame, shards: int, weights, budget: float, most: float, block: int, keep: list[str], held: bool) -> DataFrame:
    """Documents (columns `keep`) with size, their source's plan, and pieces: for each epoch an array of what the shards take.

    held: the rows are checkpointed. Rows that carry texts are not: counting their words again costs less than a copy of all texts.
    """
    spark = documents.sparkSession
    rows = documents.select(*keep, F.col("source").alias("__s"), F.coalesce("source", F.lit("")).alias("__k"), F.col("source").isNull().alias("__u"), words().alias("size"), F.xxhash64("doc_id", "text", F.lit(97)).alias("__h"))
    rows = cut(rows) if held else rows
    sizes = {r["__s"]: int(r["n"]) for r in rows.groupBy("__s").agg(F.sum("size").alias("n")).collect()}
    table = F.broadcast(spark.createDataFrame(plan(spark, sizes, shards, weights, budget, most, block), PLAN))  # a row for each source
    own = rows.join(table.withColumnRenamed("__s", "__t"), F.col("__s").eqNullSafe(F.col("__t"))).drop("__t")
    own = own.withColumn("__part", F.pmod(F.shiftright("__h", 7), F.col("parts")))
    # windows and join share one partitioning (source without its null, so a plain equality), so texts are shuffled once
    key = ["__k", "__u", "__part"]
    sums = own.groupBy(*key).agg(F.sum("size").alias("n"))
    before = sums.select(*key, F.coalesce(F.sum("n").over(Window.partitionBy("__k", "__u").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    running = F.coalesce(F.sum("size").over(Window.partitionBy(*key).orderBy("__h", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = own.withColumn("__run", running).join(before, key).withColumn("at", F.col("__run") + F.col("__before"))
    some = f"if(size = 0, cast(array() as array<long>), sequence(at div {block}, (at + size - 1) div {block}))"
    return at.withColumn("pieces", F.array(*[F.expr(f"filter(transform({some}, k -> {piece(e, block)}), x -> x.shard < {shards} and x.hi > x.lo)") for e in range(epochs(most))]))


def quotas(documents: DataFrame, shards: int = SHARDS, weights=WEIGHTS, budget: float = 1.5, most: float = 2.0, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards): what the mix takes of each document, and how many words each shard takes."""
    laid = laid_out(documents, shards, weights, budget, most, block, ["doc_id"], held=True).withColumn("own", F.flatten("pieces"))
    total = "aggregate({}, 0L, (n, x) -> n + x.hi - x.lo)"
    of = F.expr(f"transform(array_sort(array_distinct(transform(own, x -> x.shard))), s -> named_struct('shard', s, 'words', {total.format('filter(own, x -> x.shard = s)')}))")
    return laid.select("doc_id", "size", "source_size", "target", F.expr(total.format("own")).alias("taken"), of.alias("shards"))


def cut_words(text: str, ranges: list[tuple[int, int]]) -> str:
    """The words in the ranges, with the white space between them as it was."""
    at = [m.span() for m in re.finditer(WORD, text)]
    return " ".join(text[at[a][0] : at[b - 1][1]] for a, b in ranges)


def merged(ranges) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def mix(documents: DataFrame, shards: int = SHARDS, weights=WEIGHTS, budget: float = 1.5, most: float = 2.0, block: int = BLOCK) -> DataFrame:
    """The mix itself: for each document, epoch and shard that takes from it a row with the document's columns, text cut to the words taken, mix_shard and mix_order.

    A text that a shard takes whole is its own; one that lies over the border of two shards' blocks gives each its words.
    Rows lie by shard and order, a shard in as many pieces as it has `PART_WORDS` words.
    """
    own = [c for c in documents.columns if c not in ("mix_shard", "mix_order")]
    at = {c: f"c{i}" for i, c in enumerate(own)}
    rows = documents.select(F.struct(*[col(c).alias(x) for c, x in at.items()]).alias("__row"))
    named = rows.select("__row", *[F.col(f"__row.{at[c]}").alias(c) for c in ("doc_id", "text", "source")])
    drawn = laid_out(named, shards, weights, budget, most, block, ["__row"], held=False)
    by_shard = F.expr("transform(array_distinct(transform(pieces, x -> x.shard)), s -> named_struct('shard', s, 'own', filter(pieces, x -> x.shard = s)))")
    each = drawn.select("__row", "size", "__h", F.col("target"), F.posexplode("pieces").alias("epoch", "pieces")).select("__row", "size", "__h", "epoch", F.explode(by_shard).alias("x")).select("__row", "size", "__h", "epoch", "x.*")

    @F.pandas_udf("string")
    def text(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, pieces in it:
            yield pd.Series([None if t is None else cut_words(t, merged((p["lo"], p["hi"]) for p in ps)) for t, ps in zip(texts, pieces, strict=True)], dtype=object)

    # only the few texts that the end of a run cuts go to Python
    full = F.col(f"__row.{at['text']}")
    whole = F.expr("aggregate(own, 0L, (n, x) -> n + x.hi - x.lo) = size")
    each = each.withColumn("__text", F.when(whole, full).otherwise(text(F.when(~whole, full), F.when(~whole, F.col("own")))))
    result = each.select(*[F.col("__text").alias(c) if c == "text" else F.length("__text").cast("long").alias(c) if c == "n_chars" else F.col(f"__row.{x}").alias(c) for c, x in at.items()], F.col("shard").alias("mix_shard"), F.xxhash64("__h", "epoch", "shard").alias("mix_order"))
    return pieced(result, shards, math.ceil(budget * total_words(documents) / shards / PART_WORDS))


def total_words(documents: DataFrame) -> int:
    return documents.agg(F.coalesce(F.sum(words()), F.lit(0)).alias("n")).first()["n"]


def pieced(rows: DataFrame, shards: int, pieces: int) -> DataFrame:
    """rows by mix_shard and mix_order, a shard in so many pieces, each a range of the order."""
    pieces = max(1, pieces)
    piece_of = F.floor((F.shiftrightunsigned("mix_order", 33) * pieces) / F.lit(float(1 << 31)))
    n = min(shards * pieces, max(shards, 4 * partitions(rows.sparkSession)))
    return rows.withColumn("__piece", piece_of).repartition(n, "mix_shard", "__piece").sortWithinPartitions("mix_shard", "__piece", "mix_order").drop("__piece")


__all__ = ["mix", "plan", "quotas", "split_quotas", "targets"]
