"""A learned detector of clauses that burden the reader: role-relative text, features, training, thresholds, prediction.

Texts are made relative to the reader's role by column expressions; terms are counted by groups,
classes learned by Spark's `LogisticRegression`. Cutting a text into terms, weighing them and the
products with the weights are Arrow functions. Training and scoring take every row; rows of equal words
and labels are one training row that counts as often (`n`).

Defined results: null texts count as empty; a clause without any known term scores by the intercept;
training needs rows of both classes, else ValueError.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from clausewise.dims import TYPE_OF, lookup
from clausewise.functions.text import FLAGS, has, signature
from clausewise.operators import findings, measures, parties, rules

#: Writes rows and reads them back, with a schema of its own if that is given.
Keep = Callable[..., DataFrame]

VERSION = "1"
BUCKETS = 4_096
VOCABULARY = 1 << 17
RESULT = ("score", "category", "level", "reasons")
LEAST_PRECISION, MISSED, FOLDS, STRENGTH = 0.9, 0.05, 5, 4.0

# Features in words.
SAID = {
    "RATE_HIGH": "пеня от 0,5% в день", "RATE_MED": "пеня 0,1–0,5% в день", "RATE_LOW": "пеня до 0,1% в день", "NOCAP": "без потолка неустойки", "CAPPED": "с потолком неустойки",
    "FINE_HIGH": "штраф от 30%", "FINE_MED": "штраф 10–30%", "FINE_LOW": "штраф до 10%", "NOTICE_SHORT": "предупреждение меньше месяца", "NOTICE_OK": "предупреждение от месяца",
    "NOTICE_LONG": "уведомление за 60+ дней", "TERM_VERYLONG": "срок от 120 дней", "TERM_LONG": "срок 60–119 дней", "TERM_TINY": "срок до 3 дней", "FORCE_MAJEURE": "форс-мажор",
}
WHO = {"USER": "вы", "CP": "контрагент", "BOTH": "обе стороны"}


# --- texts -------------------------------------------------------------------


def feature_tokens() -> Column:
    """Features of a clause with the columns of `rules.analysed`, in a fixed order."""
    rate, fine = F.col("rate")["value"], F.col("fine")["value"]
    notice, term = (F.transform(F.col(c), lambda s: s["value"]) for c in ("notices", "terms"))
    longest = F.array_max(term)
    return F.array_compact(
        F.array(
            F.when(rate >= 0.5, "RATE_HIGH").when(rate > 0.1, "RATE_MED").when(rate.isNotNull(), "RATE_LOW"),
            F.when(rate.isNotNull(), F.when(F.col("capped"), "CAPPED").otherwise("NOCAP")),
            F.when(fine >= 30, "FINE_HIGH").when(fine > 10, "FINE_MED").when(fine.isNotNull(), "FINE_LOW"),
            F.when(F.array_min(notice) < 30, "NOTICE_SHORT").when(F.size(notice) > 0, "NOTICE_OK"),
            F.when(F.array_max(notice) >= 60, "NOTICE_LONG"),
            F.when(longest >= 120, "TERM_VERYLONG").when(longest >= 60, "TERM_LONG"),
            F.when(F.array_min(term) <= 3, "TERM_TINY"),
            F.when(has(F.col("text"), rules.FORCE_MAJEURE), "FORCE_MAJEURE"),
        )
    )


def relative_text() -> Column:
    """The text with the two parties as USER and CP (and their case), mutual wording as BOTH, and the features after it."""
    text, role = F.col("text"), F.col("party_role")

    def step(acc: Column, m: Column) -> Column:
        who = F.when(m["role"] == role, "USER").otherwise("CP")
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, m["start"] - acc["at"]), F.lit(" "), who, F.lit("_"), m["gcase"], F.lit(" "))
        return F.struct(m["end"].alias("at"), piece.alias("out"))

    spliced = F.aggregate("mentions", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    both = F.when(F.col("lang") == "kk", F.regexp_replace(spliced, FLAGS + parties.MUTUAL["kk"], " BOTH ")).otherwise(F.regexp_replace(spliced, FLAGS + parties.MUTUAL["ru"], " BOTH "))
    return F.trim(F.regexp_replace(F.concat_ws(" ", both, F.array_join("tokens", " ")), r"(?U)\s+", " "))


def relative(clauses: DataFrame) -> DataFrame:
    """clauses (text, lang, party_role, other columns) with tokens and relative."""
    own = [F.col(c) for c in clauses.columns]
    seen = rules.analysed(clauses.withColumn("contract_type", lookup(TYPE_OF, F.col("party_role"))))
    return rules.held(seen, tokens=feature_tokens()).select(*own, "tokens", relative_text().alias("relative"))


def humanized(feature: str) -> str:
    """A feature as a reader would say it."""
    words = []
    for w in feature.split():
        upper = w.upper()
        words.append(SAID.get(upper) or WHO.get(upper.split("_")[0]) or w)
    return " ".join(words)


# --- vectors -----------------------------------------------------------------


WORD = re.compile(r"[\w%]+")


def words_of(text: str | None) -> list[str]:
    """Words and runs of two and of three words."""
    w = WORD.findall((text or "").lower())
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def grams_of(text: str | None) -> list[str]:
    """Runs of three to five characters within words padded by a space; a word shorter than a run is one."""
    padded = [f" {w} " for w in (text or "").lower().split()]
    return [p[i : i + n] for p in padded for n in (3, 4, 5) for i in range(max(1, len(p) - n + 1))]


#: Terms of each block, and how many rows must have one.
BLOCKS = {"words": (words_of, 2), "chars": (grams_of, 3)}


def distinct_terms(terms: Callable[[str | None], list[str]]):
    @F.pandas_udf("array<string>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(set(terms(t))))

    return of


@dataclass
class Terms:
    """The terms of each block, and what their counts weigh: place and inverse document frequency."""

    known: dict[str, dict[str, tuple[int, float]]]

    @classmethod
    def fit(cls, rows: DataFrame, column: str = "relative") -> Terms:
        """rows (the column, n)."""
        known, at = {}, 0
        for name, (terms, least) in BLOCKS.items():
            made = rows.select(distinct_terms(terms)(column).alias("t"), "n")
            total = rows.agg(F.sum("n")).first()[0] or 0
            df = made.select(F.explode("t").alias("t"), "n").groupBy("t").agg(F.sum("n").alias("count")).where(F.col("count") >= least).orderBy(F.desc("count"), "t").limit(VOCABULARY)
            known[name] = {r["t"]: (at + i, math.log((1 + total) / (1 + r["count"])) + 1) for i, r in enumerate(df.collect())}  # a row for each term, `VOCABULARY` at most
            at += len(known[name])
        return cls(known)

    def size(self) -> int:
        return sum(map(len, self.known.values()))

    def vector(self, text: str | None) -> tuple[list[int], list[float]]:
        """Places and values: a count's logarithm times its weight, each block of length one."""
        places, values = [], []
        for (terms, _), known in zip(BLOCKS.values(), self.known.values(), strict=True):
            found = sorted((*known[t], n) for t, n in Counter(terms(text)).items() if t in known)
            x = [(1 + math.log(n)) * idf for _, idf, n in found]
            norm = math.sqrt(sum(v * v for v in x)) or 1.0
            places += [i for i, *_ in found]
            values += [v / norm for v in x]
        return places, values

    def transform(self, rows: DataFrame, keep: Keep, column: str = "relative") -> DataFrame:
        """rows with features: a sparse vector, as Parquet holds it."""
        size = self.size()

        @F.pandas_udf("type tinyint, size int, indices array<int>, values array<double>")
        def of(texts: pd.Series) -> pd.DataFrame:
            made = [self.vector(t) for t in texts]
            return pd.DataFrame({"type": np.zeros(len(made), "int8"), "size": np.full(len(made), size, "int32"), "indices": [i for i, _ in made], "values": [v for _, v in made]})

        schema = StructType([*rows.schema.fields, StructField("features", VectorUDT())])
        return keep(rows.withColumn("features", of(column)), schema)


# --- models ------------------------------------------------------------------


def regression(rows: DataFrame, label: str, balanced: bool) -> LogisticRegressionModel:
    """On features, n and a label of 0 to k - 1, weighing classes alike if balanced."""
    counts = {r[label]: r["count"] for r in rows.groupBy(label).agg(F.sum("n").alias("count")).collect()}
    n, k = sum(counts.values()), len(counts)
    if balanced:
        by_class = F.create_map(*[F.lit(x) for c, m in counts.items() for x in (float(c), n / (k * m))])
        rows = rows.withColumn("__w", by_class[F.col(label).cast("double")] * F.col("n"))
    else:
        rows = rows.withColumn("__w", F.col("n").cast("double"))
    model = LogisticRegression(featuresCol="features", labelCol="__y", weightCol="__w", regParam=1 / (STRENGTH * n), elasticNetParam=0.0, standardization=False, maxIter=100, probabilityCol="__p", rawPredictionCol="__r", predictionCol="__c")
    return model.fit(rows.withColumn("__y", F.col(label).cast("double")))


def folds(sizes: Iterable[tuple[str, int]], k: int = FOLDS) -> dict[str, int]:
    """A fold for each group: largest first, to the fold that holds least."""
    load, out = [0] * k, {}
    for group, n in sorted(sizes, key=lambda g: (-g[1], g[0])):
        f = min(range(k), key=lambda i: (load[i], i))
        load[f] += n
        out[group] = f
    return out


def bucket(group: str) -> Column:
    """One of `BUCKETS` for each group: as many are dealt to folds at most, so the driver knows no more of them."""
    return F.pmod(F.xxhash64(group), F.lit(BUCKETS)).cast("string")


def dealt(rows: DataFrame, group: str, fold: str, k: int) -> DataFrame:
    """rows (a bucket of groups, n) with the fold of the bucket in its place."""
    of = folds([(r["g"], r["n"]) for r in rows.groupBy(F.col(group).alias("g")).agg(F.sum("n").alias("n")).collect()], k)  # `BUCKETS` at most
    table = F.broadcast(rows.sparkSession.createDataFrame(list(of.items()), f"{group} string, {fold} int"))
    return rows.join(table, group).drop(group)


def out_of_fold(rows: DataFrame, fold: str, keep: Keep, k: int = FOLDS) -> DataFrame:
    """(row, score): each row (row, relative, risky, n) scored by a model that saw no row of its fold."""
    out = None
    for f in range(k):
        seen = rows.where(F.col(fold) != f)
        terms = Terms.fit(seen)
        model = ClauseModel(terms, Linear.of(regression(terms.transform(seen.select("relative", "risky", "n"), keep), "risky", True)))
        part = model.scored(rows.where(F.col(fold) == f).select("row", "relative")).select("row", "score")
        out = part if out is None else out.unionByName(part)
    return out


@dataclass
class Linear:
    """Weights (class x place) and intercepts of a logistic regression."""

    weights: list[list[float]]
    intercepts: list[float]

    @classmethod
    def of(cls, model: LogisticRegressionModel) -> Linear:
        return cls(model.coefficientMatrix.toArray().tolist(), model.interceptVector.toArray().tolist())


@dataclass
class ClauseModel:
    terms: Terms
    risk: Linear
    category: Linear | None = None
    level: Linear | None = None
    categories: list[str] = field(default_factory=list)
    levels: list[int] = field(default_factory=list)
    threshold: float = 0.5
    emit: float = 0.99
    route: float = 0.0
    measured: dict[str, float] = field(default_factory=dict)

    def scored(self, clauses: DataFrame, reasons: int = 4) -> DataFrame:
        """clauses (relative) with score, category, level and the words that spoke most for a risk; own columns of these names give way."""
        terms, categories, levels = self.terms, self.categories, self.levels
        matrices = {n: (np.array(m.weights), np.array(m.intercepts)) for n, m in (("risk", self.risk), ("category", self.category), ("level", self.level)) if m is not None}
        words = list(terms.known["words"])

        def best(name: str, values: list, at: list[int], x: np.ndarray):
            if name not in matrices:
                return values[0] if values else None
            w, b = matrices[name]
            z = w[:, at] @ x + b
            return values[int(z[0] > 0) if len(z) == 1 else int(np.argmax(z))]

        @F.pandas_udf("score double, category string, level int, reasons array<string>")
        def of(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            w, b = matrices["risk"][0][0], matrices["risk"][1][0]
            for texts in it:
                out = []
                for t in texts:
                    at, x = terms.vector(t)
                    part = w[at] * x
                    top = sorted(((float(c), words[i]) for c, i in zip(part, at, strict=True) if i < len(words) and c > 0), reverse=True)[:reasons]
                    out.append((1 / (1 + math.exp(-max(-700.0, float(part.sum()) + b))), best("category", categories, at, x), best("level", levels, at, x), [humanized(n) for _, n in top]))
                made = pd.DataFrame(out, columns=["score", "category", "level", "reasons"])
                yield made.assign(level=made["level"].astype("Int32"))

        return clauses.withColumn("__m", of("relative")).select(*[F.col(c) for c in clauses.columns if c not in RESULT], "__m.*")

    def save(self, spark: SparkSession, path: str) -> None:
        """One row of JSON: a model is a few megabytes, bounded by `VOCABULARY`."""
        spark.createDataFrame([(json.dumps({"version": VERSION} | asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ClauseModel | None:
        """The saved model; None if it was made by another version."""
        known = json.loads(spark.read.text(path, wholetext=True).first()["value"])
        if known.pop("version") != VERSION:
            return None
        terms = Terms({b: {t: tuple(x) for t, x in own.items()} for b, own in known.pop("terms")["known"].items()})
        linear = {n: Linear(**known.pop(n)) if known[n] else known.pop(n) for n in ("risk", "category", "level")}
        return cls(terms, **linear, **known)


def training_frame(clauses: DataFrame, gold: DataFrame) -> DataFrame:
    """Clauses that can be analysed (doc_id, clause_id, text, lang, party_role) with risky, category and level by gold (doc_id, clause_id, category, level, gold_ord); of several the last counts."""
    last = gold.groupBy("doc_id", "clause_id").agg(F.max(F.struct("gold_ord", "category", "level")).alias("g"))
    joined = clauses.join(last, ["doc_id", "clause_id"], "left")
    return joined.select(*[F.col(c) for c in clauses.columns], F.col("g").isNotNull().cast("int").alias("risky"), F.col("g.category").alias("category"), F.col("g.level").alias("level"))


def train(rows: DataFrame, keep: Keep, silent: DataFrame | None = None, k: int = FOLDS) -> ClauseModel:
    """rows: a training frame. keep() writes rows and reads them back. silent: (doc_id, clause_id) that rules say nothing of.

    The threshold is that of the best F1 at enough precision, out of folds by document. A hybrid emits
    above all silent clauses without a risk, and routes what 95 of 100 risky clauses score by wording.
    All rows are learned from: those of equal words, labels and fold are one row, and how many they are.
    """
    quiet = F.lit(True)
    if silent is not None:
        rows = rows.join(silent.select("doc_id", "clause_id").distinct().withColumn("__quiet", F.lit(True)), ["doc_id", "clause_id"], "left")
        quiet = F.col("__quiet").isNotNull()
    own = ("text", "lang", "party_role", "risky", "category", "level", "quiet")
    each = keep(rows.withColumn("quiet", quiet).groupBy(*own, bucket("doc_id").alias("doc")).agg(F.count("*").alias("n")))
    if each.select("risky").distinct().count() < 2:
        raise ValueError("training needs clauses with and without a risk")
    equal = dealt(each, "doc", "doc_fold", k).groupBy(*own, "doc_fold").agg(F.sum("n").alias("n"))
    made = keep(relative(equal).withColumn("__wording", signature(F.col("relative"))).withColumn("wording", bucket("__wording")).withColumn("row", F.monotonically_increasing_id()))
    made = keep(dealt(made, "wording", "wording_fold", k))
    by_doc, by_wording = (keep(out_of_fold(made, fold, keep, k)) for fold in ("doc_fold", "wording_fold"))
    scored = made.select("row", "n", "quiet", F.col("risky").alias("label")).join(by_doc, "row")
    best = measures.best_threshold(scored, LEAST_PRECISION, "n").first()
    threshold = best["threshold"] if best else 0.5
    top = scored.where("label = 0 and quiet").agg(F.max("score").alias("s")).first()["s"]
    hits = made.select("row", "n", (F.col("risky") == 1).alias("g")).join(by_wording, "row").withColumn("p", F.col("score") >= threshold)
    many = lambda x: F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0))
    c = hits.agg(F.percentile(F.when(F.col("g"), F.col("score")), MISSED, F.col("n")).alias("route"), *[many(x).alias(n) for n, x in (("tp", F.col("p") & F.col("g")), ("fp", F.col("p") & ~F.col("g")), ("fn", ~F.col("p") & F.col("g")))]).first()
    terms = Terms.fit(made)
    ready = terms.transform(made.select("relative", "risky", "category", "level", "n"), keep)
    risky = ready.where("risky = 1")
    values = {c: sorted(r[0] for r in risky.select(c).distinct().collect() if r[0] is not None) for c in ("category", "level")}

    def of(name: str) -> Linear | None:
        own = values[name]
        if len(own) < 2:
            return None
        place = F.array_position(F.array(*map(F.lit, own)), F.col(name)).cast("int") - 1
        return Linear.of(regression(risky.where(F.col(name).isNotNull()).withColumn("__i", place), "__i", False))

    return ClauseModel(
        terms, Linear.of(regression(ready, "risky", True)), of("category"), of("level"), values["category"], values["level"], threshold,
        emit=round(min(0.99, top + 1e-3), 4) if top is not None else 0.99, route=round(c["route"], 4),
        measured={"by_doc_f1": round(best["f1"], 4) if best else 0.0, "by_wording_f1": round(2 * c["tp"] / max(1, 2 * c["tp"] + c["fp"] + c["fn"]), 4)},
    )


# --- detectors ---------------------------------------------------------------


def once(asked: DataFrame, model: ClauseModel) -> DataFrame:
    """`model.scored(relative(asked))`, each wording scored once for a role: it rests on text, language and role alone. Clauses are read twice."""
    key = F.unhex(F.md5(F.concat_ws("\0", F.coalesce("party_role", F.lit("\1")), F.coalesce("lang", F.lit("\1")), F.coalesce("text", F.lit("\1")))))
    tasks = 3 * asked.sparkSession.sparkContext.defaultParallelism
    said = model.scored(relative(asked.select("text", "lang", "party_role").distinct().repartition(tasks)))
    own = [c for c in asked.columns if c not in RESULT]
    return asked.select(*own, key.alias("__key")).join(said.select(key.alias("__key"), "tokens", "relative", *RESULT), "__key").select(*own, "tokens", "relative", *RESULT)


def scored(clauses: DataFrame, requests: DataFrame, model: ClauseModel) -> DataFrame:
    """Every clause that can be analysed, for every role that is asked for, with the model's score and guess."""
    return once(clauses.where(findings.analysable()).join(requests, "doc_id"), model)


def of_model(scores: DataFrame, least: float) -> DataFrame:
    """Findings of the model: clauses that score `least` or more; the whole clause is the evidence."""
    quote = F.array(F.struct(F.col("text").alias("quote"), F.lit(0).alias("start"), F.length("text").alias("end")))
    p = F.bround("score", 4)
    details = F.create_map(F.lit("probability"), p.cast("string"), F.lit("reasons"), F.array_join("reasons", "; "))
    return scores.where(F.col("score") >= least).select("doc_id", "party_role", "clause_id", "clause_ord", F.lit(0).alias("hit_ord"), F.lit("ml").alias("rule_id"), "category", "level", F.lit("ml").alias("source"), p.alias("confidence"), quote.alias("evidence"), details.alias("details"))


def silent(clauses: DataFrame, requests: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, clause_id, party_role, clause's columns) that can be analysed and have no finding."""
    asked = clauses.where(findings.analysable()).join(requests, "doc_id")
    return asked.join(found.where("clause_id is not null").select("doc_id", "clause_id", "party_role").distinct(), ["doc_id", "clause_id", "party_role"], "left_anti")


def hybrid(clauses: DataFrame, requests: DataFrame, found: DataFrame, model: ClauseModel | None = None, assess=None) -> tuple[DataFrame, DataFrame]:
    """Rules' findings and, on clauses where rules are silent, what a language model says of those that the learned model routes to it, or else what the learned model is sure of.

    assess: silent clauses to findings. Returns findings, and (doc_id, party_role, clause_id, score, routed) of the silent clauses.
    """
    quiet = silent(clauses, requests, found)
    scores = once(quiet, model) if model is not None else quiet.withColumn("score", F.lit(None).cast("double"))
    routed = F.lit(True) if model is None else F.col("score") >= model.route
    route = scores.select("doc_id", "party_role", "clause_id", "score", (routed if assess is not None or model is None else F.lit(False)).alias("routed"))
    more = None
    if assess is not None:
        more = assess(scores.where(routed) if model is not None else scores)
    elif model is not None:
        more = of_model(scores, model.emit)
    out = found if more is None else found.unionByName(more)
    return findings.dedupe(out), route


def routing_counts(route: DataFrame) -> DataFrame:
    """How many clauses rules were silent on, and how many of them were routed."""
    return route.agg(F.count("*").alias("silent"), F.count_if(F.col("routed")).alias("routed"))

