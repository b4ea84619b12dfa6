"""Runs of detectors over labelled contracts: counts of each document, kept in tables that only grow; measures, slices, intervals and tables of text come from these alone."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewise.operators import findings, measures
from clausewise.sources.corpus import markdown

#: Part of every run's id: raise it when counts come to mean something else.
COUNTED_AS = "1"
SLICES = ("contract_type", "language", "origin")
SIDES = "side string, doc_id string, clause string, category string, level int, source string, rule_id string, confidence double"
COUNTS = "doc_id string, contract_type string, language string, origin string, measure string, category string, tp long, fp long, fn long"
RUNS = "detector string, config string, split string, dataset string"


class Detector(NamedTuple):
    """What finds risks: clauses (doc_id, clause_id, ...) and requests (doc_id, party_role) to findings."""

    name: str
    detect: Callable[[DataFrame, DataFrame], DataFrame]
    config: Mapping[str, object] = {}


def nothing(clauses: DataFrame, requests: DataFrame) -> DataFrame:
    """Findings of a detector that never finds any."""
    return findings.of_documents(clauses, requests).where("false")


def detector(name: str, more: Mapping[str, Detector] | None = None) -> Detector:
    """`null`, `rules`, or one of the caller's own: a learned model or a hybrid needs what it was trained on."""
    known = {"null": Detector("null", nothing), "rules": Detector("rules", findings.findings)} | dict(more or {})
    if name not in known:
        raise ValueError(f"no detector {name!r}; known: {sorted(known)}")
    return known[name]


def counts(docs: DataFrame, gold: DataFrame, predicted: DataFrame, clauses: DataFrame) -> DataFrame:
    """(doc_id, contract_type, language, origin, measure, category, tp, fp, fn) of each document.

    docs (doc_id, contract_type, language, origin), gold (doc_id, clause, category, level) and predicted
    (the same), levels from 1 to 3, clauses (doc_id, clause_id); a null clause is the document itself.
    Findings of no document of docs don't count; a finding that occurs again counts once, at its highest
    level, but as two alarms.

    detection: clauses. strict: clauses with the category. document: the documents' own findings.
    high: clauses that gold calls high, found or not. level: matches of strict with the right level (tp),
    a higher (fp), a lower (fn). clean: alarms (fp) on documents without gold. coverage: clauses of gold
    that were read. Every document has rows of detection, high and coverage, and of clean where it is
    clean, so documents without any finding are drawn in resamples as well.
    """
    none = F.lit(0).cast("long")
    sides = [
        gold.select("doc_id", "clause", "category", F.col("level").alias("g"), F.lit(None).cast("int").alias("p"), F.lit(1).alias("gn"), none.alias("pn"), none.alias("seen")),
        predicted.select("doc_id", "clause", "category", F.lit(None).cast("int").alias("g"), F.col("level").alias("p"), F.lit(0).alias("gn"), F.lit(1).cast("long").alias("pn"), none.alias("seen")),
        clauses.where("clause_id is not null").select("doc_id", F.col("clause_id").alias("clause"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("int").alias("g"), F.lit(None).cast("int").alias("p"), F.lit(0).alias("gn"), none.alias("pn"), F.lit(1).cast("long").alias("seen")),
    ]
    rows = sides[0].unionByName(sides[1]).unionByName(sides[2])
    best = [F.max(c).alias(c) for c in ("g", "p", "gn", "seen")]
    each = rows.groupBy("doc_id", "clause", "category").agg(*best, F.sum("pn").alias("pn"))
    want, have, own = F.col("gn") > 0, F.col("pn") > 0, F.col("clause").isNull()

    def outcome(of: Column) -> list[Column]:
        return [F.count_if(of & want & have).alias("tp"), F.count_if(of & ~want & have).alias("fp"), F.count_if(of & want & ~have).alias("fn")]

    def named(measure: str, of: list[Column]) -> Column:
        return F.struct(F.lit(measure).alias("measure"), *[c.alias(n) for c, n in zip(of, ("tp", "fp", "fn"), strict=True)])

    match = ~own & want & have
    levels = [F.count_if(match & c).alias(n) for c, n in ((F.col("p") == F.col("g"), "tp"), (F.col("p") > F.col("g"), "fp"), (F.col("p") < F.col("g"), "fn"))]
    by_category = each.groupBy("doc_id", "category").agg(F.struct(*outcome(~own)).alias("s"), F.struct(*outcome(own)).alias("d"), F.struct(*levels).alias("l"))
    three = F.array(*[named(m, [F.col(f"{s}.{n}") for n in ("tp", "fp", "fn")]) for m, s in (("strict", "s"), ("document", "d"), ("level", "l"))])
    strict = by_category.select("doc_id", "category", F.explode(three).alias("m")).where("m.tp + m.fp + m.fn > 0")

    clause = each.groupBy("doc_id", "clause").agg(*best, F.sum("pn").alias("pn"))
    high = F.coalesce(F.col("g") == 3, F.lit(False)) & ~own
    sums = clause.groupBy("doc_id").agg(
        F.struct(*outcome(~own)).alias("d"), F.count_if(high & have).alias("h_tp"), F.count_if(high & ~have).alias("h_fn"), F.sum("pn").alias("alarms"), F.max("gn").alias("gold"),
        F.count_if(~own & want & (F.col("seen") > 0)).alias("c_tp"), F.count_if(~own & want & (F.col("seen") == 0)).alias("c_fn"),
    )
    zero = lambda c: F.coalesce(F.col(c), none)
    of_all = [named("detection", [zero("d.tp"), zero("d.fp"), zero("d.fn")]), named("high", [zero("h_tp"), none, zero("h_fn")]), named("coverage", [zero("c_tp"), none, zero("c_fn")])]
    clean = F.when(zero("gold") == 0, named("clean", [none, zero("alarms"), none]))
    whole = docs.join(sums, "doc_id", "left").select("doc_id", *SLICES, F.lit(None).cast("string").alias("category"), F.explode(F.array_compact(F.array(*of_all, clean))).alias("m"))
    return docs.select("doc_id", *SLICES).join(strict, "doc_id").unionByName(whole).select("doc_id", *SLICES, "m.measure", "category", "m.tp", "m.fp", "m.fn")


def dataset_hash(docs: DataFrame, gold: DataFrame, texts: DataFrame | None = None) -> str:
    """16 hex digits that change with any document, text or label, whatever the order of rows; repeated rows count."""

    def summed(rows: DataFrame) -> DataFrame:
        # sums of two hashes of each row: one number a task, nothing gathered
        whole = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
        return rows.select(*[F.xxhash64(F.sha2(F.concat(whole, F.lit(salt)), 256)).cast("decimal(38,0)").alias(salt) for salt in ("a", "b")]).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("n"))

    parts = [summed(d).first() for d in (docs, gold, *([texts] if texts is not None else []))]
    return docs.sparkSession.range(1).select(F.substring(F.sha2(F.lit(str([tuple(map(str, p)) for p in parts])), 256), 1, 16)).first()[0]


class Runs:
    """Tables in a folder: `sides` (gold and predictions in long form), `counts`, and `runs`, whose line is written last.

    A run's id is made of what it ran on, so that a run that is asked for again is the same run: what is
    there already isn't written twice, and what a killed run left is written over. Readers see finished
    runs only.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def read(self, name: str, schema: str) -> DataFrame:
        full = f"{schema}, run_id string"
        try:
            return self.spark.read.schema(full).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], full)
            raise

    def runs(self) -> DataFrame:
        return self.read("runs", RUNS)

    def finished(self, name: str, schema: str) -> DataFrame:
        return self.read(name, schema).join(self.runs().select("run_id"), "run_id", "left_semi")

    def counts(self) -> DataFrame:
        return self.finished("counts", COUNTS)

    def sides(self) -> DataFrame:
        return self.finished("sides", SIDES)

    def add(self, by: Detector, split: str, docs: DataFrame, gold: DataFrame, clauses: DataFrame, requests: DataFrame, dataset: str | None = None) -> str:
        """Runs a detector over docs' clauses; returns the run's id. gold (doc_id, clause, category, level). dataset: `dataset_hash`, where it is known already."""
        dataset = dataset or dataset_hash(docs, gold, clauses.select("doc_id", "clause_id", "text"))
        config = json.dumps(dict(by.config), sort_keys=True, ensure_ascii=False)
        run_id = self.spark.range(1).select(F.substring(F.sha2(F.lit(json.dumps([COUNTED_AS, by.name, config, split, dataset])), 256), 1, 16)).first()[0]
        if self.runs().where(F.col("run_id") == run_id).first():
            return run_id
        names = ("doc_id", "clause", "category", "level", "source", "rule_id", "confidence")
        found = by.detect(clauses, requests).select(F.lit("predicted").alias("side"), F.col("doc_id").cast("string"), F.col("clause_id").alias("clause"), "category", F.col("level").cast("int"), "source", "rule_id", F.round("confidence", 4).alias("confidence"))
        wanted = gold.select(F.lit("gold").alias("side"), F.col("doc_id").cast("string"), "clause", "category", F.col("level").cast("int"), *[F.lit(None).cast(t).alias(n) for n, t in zip(names[4:], ("string", "string", "double"), strict=True)])
        mine = docs.select(F.col("doc_id").cast("string"), *SLICES)
        found.unionByName(wanted).join(mine.select("doc_id"), "doc_id", "left_semi").write.mode("overwrite").parquet(f"{self.folder}/sides/run_id={run_id}")
        both = self.spark.read.schema(SIDES).parquet(f"{self.folder}/sides/run_id={run_id}")
        four = ("doc_id", "clause", "category", "level")
        told = counts(mine, both.where("side = 'gold'").select(*four), both.where("side = 'predicted'").select(*four), clauses.select(F.col("doc_id").cast("string"), "clause_id"))
        told.write.mode("overwrite").parquet(f"{self.folder}/counts/run_id={run_id}")
        self.spark.createDataFrame([(by.name, config, split, dataset)], RUNS).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/runs/run_id={run_id}")
        return run_id

    # --- what the tables tell ---

    def measured(self, *by: str) -> DataFrame:
        """(run_id, columns of by, measure, docs, alarmed, tp, fp, fn, precision, recall, f1): by `category`, by a slice, or over all. alarmed: documents with any fp."""
        sums = self.counts().groupBy("run_id", *by, "measure").agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct(F.when(F.col("fp") > 0, F.col("doc_id"))).alias("alarmed"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
        return sums.select("*", *measures.prf(F.col("tp"), F.col("fp"), F.col("fn")))

    def intervals(self, run_id: str, measure: str = "detection", times: int = 1000) -> DataFrame:
        """Bounds of a run's precision, recall and F1 over resamples of its documents."""
        every = self.counts().where(F.col("run_id") == run_id)
        own = every.where(F.col("measure") == measure).groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
        return measures.poisson_interval(every.select("doc_id").distinct().join(own, "doc_id", "left"), times=times)

    def summary(self) -> DataFrame:
        """A row a run: its measures side by side, in order of split, detector and id."""
        value = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
        wide = self.measured().groupBy("run_id").agg(
            value("detection", "docs").alias("docs"), *[value("detection", c).alias(c) for c in ("precision", "recall", "f1")], value("strict", "f1").alias("strict_f1"), value("high", "recall").alias("high_recall"),
            F.try_divide(value("level", "tp"), value("level", "tp") + value("level", "fp") + value("level", "fn")).alias("level_accuracy"),
            F.try_divide(value("clean", "fp"), value("clean", "docs")).alias("alarms_per_clean"), F.try_divide(value("clean", "alarmed"), value("clean", "docs")).alias("clean_alarmed"), value("document", "f1").alias("document_f1"), value("coverage", "recall").alias("coverage"),
        )
        return self.runs().join(wide, "run_id", "left").orderBy("split", "detector", "run_id")

    def table(self, times: int = 1000) -> str:
        """The summary as markdown, with the bounds of F1; what is undefined is a dash."""
        f1 = [(r["run_id"], *self.intervals(r["run_id"], times=times).select("f1_low", "f1_high").first()) for r in self.runs().collect()]
        bounds = self.spark.createDataFrame(f1, "run_id string, low double, high double")
        two = lambda c: F.coalesce(F.format_number(c, 2), F.lit("—"))
        shown = self.summary().join(F.broadcast(bounds), "run_id", "left").orderBy("split", "detector", "run_id")
        ci = F.coalesce(F.concat(F.lit(" ["), F.format_number("low", 2), F.lit("–"), F.format_number("high", 2), F.lit("]")), F.lit(""))
        return markdown(shown.select("run_id", "detector", "split", F.substring("dataset", 1, 8).alias("dataset"), two("precision").alias("P"), two("recall").alias("R"), F.concat(two("f1"), ci).alias("F1"), two("strict_f1").alias("strict F1"), two("high_recall").alias("high R"), two("alarms_per_clean").alias("alarms a clean document"), two("document_f1").alias("document F1")))

    def errors(self, run_id: str, texts: DataFrame, most: int = 12, chars: int = 220) -> DataFrame:
        """(kind, category, n, doc_id, clause, excerpt): the first errors of each kind and category, with how many there are. texts (doc_id, clause_id, text). A document's own findings have no excerpt."""
        own = self.sides().where(F.col("run_id") == run_id)
        each = own.groupBy("doc_id", "clause", "category").agg(F.bool_or(F.col("side") == "gold").alias("want"), F.bool_or(F.col("side") == "predicted").alias("have")).where("want <> have")
        kind = each.withColumn("kind", F.when(F.col("want"), "missed").otherwise("false alarm"))
        sizes = kind.groupBy("kind", "category").agg(F.count("*").alias("n"))
        w = Window.partitionBy("kind", "category").orderBy("doc_id", "clause")  # the engine keeps the first of each task before it shuffles
        picked = kind.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
        said = texts.select(F.col("doc_id").cast("string"), F.col("clause_id").alias("clause"), F.col("text"))
        cut = F.when(F.length("text") > chars, F.concat(F.substring("text", 1, chars - 1), F.lit("…"))).otherwise(F.col("text"))
        return picked.join(said, ["doc_id", "clause"], "left").join(sizes, ["kind", "category"]).select("kind", "category", "n", "doc_id", "clause", cut.alias("excerpt")).orderBy(F.desc("n"), "kind", "category", "doc_id", "clause")
