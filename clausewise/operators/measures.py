"""Evaluation: counts of true and false findings, precision and recall with their undefined cases, slices, bootstrap, thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Null where nothing was predicted (precision) or nothing was there (recall); F1 is 0 if something was but nothing matched."""
    p, r = F.try_divide(tp.cast("double"), tp + fp), F.try_divide(tp.cast("double"), tp + fn)
    f = F.when((p > 0) & (r > 0), 2 * p * r / (p + r)).when(tp + fp + fn > 0, 0.0)
    return p.alias("precision"), r.alias("recall"), f.alias("f1")


def outcomes(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each distinct key of either side with tp, fp and fn (0 or 1); null keys match null keys."""
    g = gold.select(*keys).distinct().withColumn("__g", F.lit(1))
    p = predicted.select(*[F.col(k).alias(f"__p_{k}") for k in keys]).distinct().withColumn("__p", F.lit(1))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__p_{k}"))
    both = g.join(p, cond, "full")
    hit, want = F.col("__p").isNotNull(), F.col("__g").isNotNull()
    return both.select(*[F.coalesce(F.col(k), F.col(f"__p_{k}")).alias(k) for k in keys], (hit & want).cast("int").alias("tp"), (hit & ~want).cast("int").alias("fp"), (~hit & want).cast("int").alias("fn"))


def scored(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums of tp, fp, fn and their precision, recall and F1; with `by`, over all rows and by each column alone in one pass."""
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    if not by:
        out = counts.agg(*sums)
    else:
        out = counts.groupingSets([[], *[[c] for c in by]], *by).agg(F.grouping_id().alias("gid"), *sums)
        named, value = F.lit("all"), F.lit("all")
        for i, c in enumerate(by):
            alone = F.col("gid") == 2 ** len(by) - 1 - 2 ** (len(by) - 1 - i)
            named, value = F.when(alone, c).otherwise(named), F.when(alone, F.col(c)).otherwise(value)
        out = out.select(named.alias("slice"), value.alias("value"), "tp", "fp", "fn")
    return out.select("*", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def bundle(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(measure, tp, fp, fn): detection by document and clause, strict with the category, and recall of clauses whose gold level is high."""
    clause = ["doc_id", "clause"]
    high = gold.where("level = 3")
    parts = {"detection": outcomes(gold, predicted, clause), "strict": outcomes(gold, predicted, [*clause, "category"]), "high": outcomes(high, predicted.join(high.select(*clause).distinct(), clause, "left_semi"), clause)}
    out = None
    for name, counts in parts.items():
        one = counts.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).select(F.lit(name).alias("measure"), "tp", "fp", "fn")
        out = one if out is None else out.unionByName(one)
    return out


def coverage(gold: DataFrame, clauses: DataFrame) -> DataFrame:
    """How many gold clauses the segmenter found."""
    g = gold.where("clause is not null").select("doc_id", "clause").distinct()
    hit = g.join(clauses.select("doc_id", F.col("clause_id").alias("clause")).distinct(), ["doc_id", "clause"], "left_semi").count()
    return g.agg(F.lit(hit).alias("found"), F.count("*").alias("all"))


def resampled(rows: DataFrame, values: list[str], times: int = 1000, seed: int = 13) -> DataFrame:
    """(resample, n, sums of `values`) over resamples of the rows, in one pass: each row counts a Poisson(1) number of times.

    Equal rows are drawn together: m of them count Poisson(m) times, which is what m single draws add up
    to. A draw is seeded by the values, so it is the same however the rows are dealt. A task sums its own
    draws, so what is shuffled is the distinct rows and `times` rows a task. Null values count as 0.
    """
    groups = rows.select(*[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values]).groupBy(*values).agg(F.count("*").alias("n"))

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((times, 1 + len(values)))
        for batch in batches:
            for n, *own in batch[["n", *values]].itertuples(index=False):
                key = np.array(own, dtype=np.float64).view(np.uint64)
                weights = np.random.default_rng([seed, *map(int, key)]).poisson(n, times)
                sums += np.outer(weights, [1.0, *own])
        yield pd.DataFrame({"resample": np.arange(times), **{c: sums[:, i] for i, c in enumerate(["n", *values])}})

    parts = groups.mapInPandas(drawn, "resample long, " + ", ".join(f"{c} double" for c in ["n", *values]))
    return parts.groupBy("resample").agg(*[F.sum(c).alias(c) for c in ["n", *values]])


def poisson_interval(counts: DataFrame, low: float = 0.025, high: float = 0.975, times: int = 1000, seed: int = 13) -> DataFrame:
    """counts (tp, fp, fn) of each document: as `interval`, by `resampled` in place of draws."""
    return bounds(resampled(counts, ["tp", "fp", "fn"], times, seed), low, high)


def macro_interval(accuracies: DataFrame, times: int = 1000, seed: int = 13) -> DataFrame:
    """accuracies (accuracy) by document: the mean's bounds over resamples of documents; null without any."""
    means = resampled(accuracies.where("accuracy is not null"), ["accuracy"], times, seed).select(F.try_divide("accuracy", "n").alias("m"))
    return means.agg(*[F.bround(F.percentile("m", q), 4).alias(name) for q, name in ((0.025, "low"), (0.975, "high"))])


def level_confusion(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Of matches: how many have the gold level, a lower or a higher one; the highest level of a key counts."""
    g, p = gold.groupBy(*keys).agg(F.max("level").alias("g")), predicted.groupBy(*keys).agg(F.max("level").alias("p"))
    m = g.join(p, keys)
    return m.agg(F.count("*").alias("matches"), F.count_if(F.col("g") == F.col("p")).alias("right"), F.count_if(F.col("p") < F.col("g")).alias("under"), F.count_if(F.col("p") > F.col("g")).alias("over"))


def clean_false_alarms(docs: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Predictions on documents without any gold finding, and how many such documents there are."""
    clean = docs.select("doc_id").join(gold.select("doc_id").distinct(), "doc_id", "left_anti")
    alarms = predicted.join(clean, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))
    return clean.join(alarms, "doc_id", "left").agg(F.count("*").alias("clean_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("false_alarms"))


def resamples(n: int, times: int = 1000, seed: int = 13) -> np.ndarray:
    """(times, n): which documents each resample draws."""
    return np.random.default_rng(seed).integers(0, n, size=(times, n))


def interval(counts: DataFrame, draws: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """counts: (pos, tp, fp, fn) for each document; draws: (resample, pos). Bounds of precision, recall and F1.

    Undefined precision and recall of a resample are left out; its F1 is then 0 and counts.
    """
    return bounds(draws.join(counts, "pos").groupBy("resample").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]), low, high)


def bounds(sums: DataFrame, low: float, high: float) -> DataFrame:
    """sums (tp, fp, fn) of each resample: bounds of their precision, recall and F1."""
    s = sums.select(*prf(F.col("tp"), F.col("fp"), F.col("fn"))).withColumn("f1", F.coalesce("f1", F.lit(0.0)))
    return s.agg(*[F.bround(F.percentile(m, q), 4).alias(f"{m}_{name}") for m in ("precision", "recall", "f1") for q, name in ((low, "low"), (high, "high"))])


def best_threshold(scores: DataFrame, least_precision: float = 0.9, times: str | None = None) -> DataFrame:
    """scores: (score, label, and how many times the row counts). The threshold of the highest F1 among those of enough precision; the lowest of equals.

    Candidates are the distinct scores rounded to three digits. Counts at or above each are running sums
    over one row per candidate, so the window holds a thousand rows at most for scores of 0 to 1.
    """
    n = F.lit(1) if times is None else F.col(times)
    t = scores.groupBy(F.bround("score", 3).alias("t")).agg(F.sum(F.col("label") * n).alias("pos"), F.sum(n).alias("n"))
    down = Window.orderBy(F.desc("t"))
    run = t.select("t", F.sum("pos").over(down).alias("tp"), F.sum("n").over(down).alias("n"), F.sum("pos").over(Window.partitionBy()).alias("all"))
    p, r, f = prf(F.col("tp"), F.col("n") - F.col("tp"), F.col("all") - F.col("tp"))
    good = run.select("t", p, r, f).where(F.col("precision") >= least_precision)
    return good.orderBy(F.desc("f1"), "t").limit(1).select(F.col("t").alias("threshold"), "f1", "precision", "recall")
