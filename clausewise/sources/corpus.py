"""Curated tables: reference wordings with their licences, labelled contracts, gold records, prices, run histories; and what is written of a run.

Labels are YAML files, a file to a contract; they are read by Spark as whole texts and parsed in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewise.dims import CATEGORIES, TYPE_OF, TYPES, lookup
from clausewise.operators.retrieval import balance, coverage_gaps

# Licences that may be loaded; what the audits ask for.
ALLOWED = ("authored_cc0", "official_public_domain", "cc_by")
LEAST_NEUTRAL, MOST_GAP = 0.5, 1
WITHOUT_NEUTRAL = {"lease": ("payment", "acceptance")}

SOURCES = "id string, title string, license_status string, url string, legal_basis string, attribution string, notes string"
CLAUSES = "id string, contract_type string, category string, lang string, favours string, text string, source_id string, note string"
GOLD = "clause string, category string, level string, trap_id string, note string"


class LicenceError(ValueError):
    pass


def stem(path: str = "path") -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def yaml_rows(files: DataFrame, schema: str, many: str) -> DataFrame:
    """files (path, text): the rows below key `many` of each YAML file, with the file's own scalars where a row has none."""
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    @F.pandas_udf(f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")
    def rows(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import yaml

        for texts in it:
            out = []
            for t in texts:
                raw = yaml.safe_load(t) or {}
                common = {k: v for k, v in raw.items() if not isinstance(v, list | dict)}
                out.append([{n: None if (v := (common | item).get(n)) is None else str(v) for n in names} for item in raw.get(many) or []])
            yield pd.Series(out)

    return files.select("path", F.posexplode(rows("text")).alias("ord", "r")).select("path", "ord", "r.*")


def licence_faults(sources: DataFrame) -> DataFrame:
    """Sources that lack what their licence asks for."""
    basis = (F.col("license_status") == "official_public_domain") & (F.coalesce("legal_basis", F.lit("")) == "")
    name = (F.col("license_status") == "cc_by") & (F.coalesce("attribution", F.lit("")) == "")
    return sources.where(basis | name).select("id", F.when(basis, "legal_basis missing").otherwise("attribution missing").alias("fault"))


def licence_gate(clauses: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clauses that may be loaded, and those that may not with the reason: an unknown source, or a licence that isn't allowed."""
    j = clauses.join(F.broadcast(sources.select(F.col("id").alias("source_id"), "license_status", F.lit(True).alias("__known"))), "source_id", "left")
    ok = F.coalesce(F.col("license_status").isin(*ALLOWED), F.lit(False))
    reason = F.when(F.col("__known").isNull(), "unknown source").otherwise(F.concat(F.lit("licence "), F.coalesce("license_status", F.lit("none"))))
    return j.where(ok).select(clauses.columns), j.where(~ok).select(*clauses.columns, reason.alias("reason"))


def load_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """sources.yaml and clauses/*.yaml of a folder; raises if a clause may not be loaded, favours nobody of its type, or shares its id."""
    sources = yaml_rows(whole_texts(spark, f"{folder}/sources.yaml"), SOURCES, "sources")
    files = whole_texts(spark, f"{folder}/clauses/*.yaml").withColumn("text", F.regexp_replace("text", r"(?m)^source:", "source_id:"))
    clauses = yaml_rows(files, CLAUSES, "clauses").withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).drop("path", "ord")
    if row := licence_faults(sources).first():
        raise LicenceError(f"{row['id']}: {row['fault']}")
    good, bad = licence_gate(clauses, sources)
    if row := bad.first():
        raise LicenceError(f"{row['id']}: {row['reason']}")
    if row := good.where((F.col("favours") != "neutral") & ~F.coalesce(lookup(TYPE_OF, F.col("favours")) == F.col("contract_type"), F.lit(False))).first():
        raise ValueError(f"{row['id']}: favours {row['favours']}")
    if row := good.groupBy("id").count().where("count > 1").first():
        raise ValueError(f"{row['id']}: id occurs again")
    return good


def balance_of(clauses: DataFrame) -> DataFrame:
    """For each type and category how many wordings are neutral, favour the drafting side, or the other."""
    drafting = {rs[0]: "side_a" for rs in TYPES.values()} | {rs[1]: "side_b" for rs in TYPES.values()} | {"neutral": "neutral"}
    return balance(clauses.withColumn("side", lookup(drafting, F.col("favours"))), ["contract_type", "category"], "side", ["neutral", "side_a", "side_b"])


def balance_audit(table: DataFrame) -> DataFrame:
    """Rows of a balance table with too few neutral wordings, or with sides too far apart."""
    few = F.try_divide(F.col("neutral"), F.col("neutral") + F.col("side_a") + F.col("side_b")) < LEAST_NEUTRAL
    uneven = F.abs(F.col("side_a") - F.col("side_b")) > MOST_GAP
    return table.select("*", F.array_compact(F.array(F.when(few, "few neutral"), F.when(uneven, "uneven sides"))).alias("problems")).where(F.size("problems") > 0)


def required(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, c) for t in TYPES for c in CATEGORIES if c not in WITHOUT_NEUTRAL.get(t, ())], "contract_type string, category string")


def coverage_audit(clauses: DataFrame) -> DataFrame:
    """Types and categories that must have a neutral wording and have none."""
    return coverage_gaps(clauses.where("favours = 'neutral'"), required(clauses.sparkSession), ["contract_type", "category"])


def load_split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """<id>.txt and <id>.yaml of a folder: (doc_id, contract_type, language, party_role, origin, text), (doc_id, gold_ord, clause, category, level, trap_id, note). Labels without a text are left out; a role of another type, or an id that occurs again, raises ValueError."""
    labels = whole_texts(spark, f"{folder}/*.yaml")
    heads = yaml_rows(labels.withColumn("text", F.concat("text", F.lit("\n__one: [{}]\n"))), "doc_id string, contract_type string, language string, party_role string, origin string", "__one").withColumn("doc_id", F.coalesce("doc_id", stem())).drop("ord")
    gold = yaml_rows(labels, f"doc_id string, {GOLD}", "findings").withColumn("doc_id", F.coalesce("doc_id", stem())).withColumnRenamed("ord", "gold_ord").drop("path")
    if row := heads.where(~F.coalesce(lookup(TYPE_OF, F.col("party_role")) == F.col("contract_type"), F.lit(False))).first():
        raise ValueError(f"{row['doc_id']}: role {row['party_role']} in a contract of {row['contract_type']}")
    if row := heads.groupBy("doc_id").count().where("count > 1").first():
        raise ValueError(f"{row['doc_id']}: id occurs again")
    texts = whole_texts(spark, f"{folder}/*.txt").select(stem().alias("stem"), "text")
    docs = heads.withColumn("stem", stem()).join(texts, "stem").drop("stem", "path")
    return docs, gold.join(docs.select("doc_id"), "doc_id", "left_semi")


def load_gold(spark: SparkSession, path: str, texts: str, labels: str) -> DataFrame:
    """Gold records (JSON lines of doc_id, path, labels) with their texts; labels: DDL of the record."""
    rows = spark.read.schema(f"doc_id string, path string, labels struct<{labels}>").json(path)
    return rows.withColumn("stem", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)).join(whole_texts(spark, texts).select(stem().alias("stem"), "text"), "stem").drop("stem")


def load_pricing(spark: SparkSession, path: str) -> DataFrame:
    """model: {input, output} of a YAML file, dollars per million tokens; null is unknown."""

    @F.pandas_udf("array<struct<model:string,in_price:double,out_price:double>>")
    def rows(texts: pd.Series) -> pd.Series:
        import yaml

        out = []
        for t in texts:
            raw = yaml.safe_load(t) or {}
            out.append([{"model": k, "in_price": v.get("input"), "out_price": v.get("output")} for k, v in raw.get("models", raw).items() if isinstance(v, dict)])
        return pd.Series(out)

    return whole_texts(spark, path).select(F.explode(rows("text")).alias("r")).select("r.*")


def load_runs(spark: SparkSession, folder: str, metrics: str) -> DataFrame:
    """Run files, a JSON object each, in order of their ids."""
    return spark.read.schema(f"run_id string, model string, split string, prompt_version string, git_commit string, workers int, metrics struct<{metrics}>").option("multiLine", True).json(folder).orderBy("run_id")


def content_hash(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """16 hex digits of a table's content, whatever the order of its rows: a hash of sorted row hashes, first within 256 parts."""
    each = rows.select(F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in [key, *columns]]), 256).alias("h"))
    parts = each.groupBy(F.substring("h", 1, 2).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return parts.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("part", "h"))), ""), 256), 1, 16).alias("hash"))


def quoted(value: Column) -> Column:
    """A value as a scalar that is read back as the same text, whatever it looks like (1.10, yes, a: b); null as null."""
    return F.coalesce(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(value.cast("string"), r'([\\"])', r"\\$1"), "\n", r"\\n"), F.lit('"')), F.lit("null"))


def dump_labels(docs: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_id, yaml): labels as text that is the same for the same labels: fixed order of keys, findings by clause, category and level; all scalars quoted."""
    kept = [c for c in ("clause", "category", "level", "trap_id", "note") if c in gold.columns]
    fields = F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), quoted(F.col(c))) for c in kept if c in ("clause", "category", "level")], *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), quoted(F.col(c)))) for c in kept if c in ("trap_id", "note")])
    line = F.concat(F.lit("- {"), fields, F.lit("}"))
    rows = gold.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("clause", "category", "level", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    head = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), quoted(F.col(c))) for c in ("doc_id", "contract_type", "language", "party_role", "origin")])
    body = F.when(F.col("lines").isNull(), "findings: []").otherwise(F.concat(F.lit("findings:\n"), F.col("lines")))
    return docs.join(rows, "doc_id", "left").select("doc_id", F.concat(head, F.lit("\n"), body, F.lit("\n")).alias("yaml"))


def exact_leaks(left: DataFrame, right: DataFrame) -> DataFrame:
    """left (id, text) whose text, case and white space aside, is one of right's."""

    def key(d: DataFrame) -> DataFrame:
        return d.withColumn("__key", F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))))

    return key(left).join(key(right).select("__key").distinct(), "__key", "left_semi").drop("__key")


def missing_clauses(gold: DataFrame, clauses: DataFrame) -> DataFrame:
    """Gold findings of a clause that the segmenter didn't find."""
    return gold.where("clause is not null").join(clauses.select("doc_id", F.col("clause_id").alias("clause")), ["doc_id", "clause"], "left_anti")


def markdown(table: DataFrame) -> str:
    """A small table (of runs or fields) as markdown."""
    rows = [[("" if v is None else str(v)).replace("|", "\\|") for v in r] for r in table.collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [table.columns, ["-"] * len(table.columns), *rows])


def write_run(run: DataFrame, errors: DataFrame, folder: str) -> None:
    """A run as one JSON line, and its errors as JSON lines."""
    run.coalesce(1).write.mode("overwrite").json(f"{folder}/run")
    errors.write.mode("overwrite").json(f"{folder}/errors")


def error_excerpts(outcomes: DataFrame, most: int = 220) -> DataFrame:
    """Errors by kind, the most frequent first, with an excerpt of each text."""
    cut = F.when(F.length("text") > most, F.concat(F.substring("text", 1, most - 1), F.lit("…"))).otherwise(F.col("text"))
    sizes = outcomes.groupBy("kind").agg(F.count("*").alias("n"))
    return outcomes.withColumn("excerpt", cut).join(F.broadcast(sizes), "kind").orderBy(F.desc("n"), "kind", "doc_id")


def unwrapped(text: Column) -> Column:
    """Lines that were broken within a sentence joined again, empty ones dropped."""
    joined = F.regexp_replace(text, r"(?U)(?<![.;:!?\n])\n(?=\p{Ll})", " ")
    return F.array_join(F.filter(F.transform(F.split(joined, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def sampled(rows: DataFrame, by: str, n: int, seed: int = 7) -> DataFrame:
    """n rows of each group at most, by a seeded hash: the same rows on every run."""
    w = Window.partitionBy(by).orderBy(F.xxhash64(*rows.columns, F.lit(seed)))
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")

