"""Queries of the learned detector: features, role-relative text, scores, hybrid routing, on clauses and contracts made of the order tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clausewise.operators import findings, learned, rules, segment
from clausewise.plans import factory

RULE = "penalty.daily_rate"
_RATE = "CASE WHEN p = 10 THEN 'RATE_LOW' WHEN p >= 5 THEN 'RATE_HIGH' WHEN p >= 2 THEN 'RATE_MED' ELSE 'RATE_LOW' END"
#: wording -> SQL of its features, and how it reads for the tenant (buyer in the last) and for the other side.
READS = [
    (_RATE + " || ' NOCAP'", "За просрочку платежа {A}_nom уплачивает {B}_dat пеню в размере 0,{p}% за каждый день просрочки."),
    (_RATE + " || ' CAPPED'", "{A}_nom уплачивает пеню в размере 0,{p}% за каждый день просрочки, но не более {n}% от долга."),
    ("'RATE_HIGH NOCAP'", "За просрочку {A}_nom уплачивает пеню {n}% за каждый день."),
    ("'RATE_HIGH NOCAP'", "{A}_nom әрбір кешіктірілген күн үшін {n}% өсімпұл төлейді."),
    ("'RATE_HIGH NOCAP'", "BOTH срок платежа, уплачивает неустойку {n}% за каждый день."),
]


def counted(df: DataFrame) -> DataFrame:
    return df.groupBy(*[c for c in df.columns if c != "lines"]).agg(F.sum("lines").alias("lines"))


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factory.clauses(spark, sf_dir, RULE).withColumn("party_role", F.when(F.col("contract_type") == "lease", "tenant").otherwise("buyer"))


def feature_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = learned.relative(factory.once(clauses(spark, sf_dir).select("v", "n", "p", "text", "lang", "party_role")))
    return counted(made.select("v", "lines", F.array_join("tokens", " ").alias("tokens")))


def _lines() -> str:
    return f"(SELECT k % {len(READS)} AS v, n, p FROM (SELECT {factory.PARAMETERS_SQL} FROM lineitem))"


def _tokens_sql() -> str:
    return "CASE v " + " ".join(f"WHEN {v} THEN {t}" for v, (t, _) in enumerate(READS)) + " END"


TOKENS_SQL = f"SELECT v, tokens, count(*) AS lines FROM (SELECT v, {_tokens_sql()} AS tokens FROM {_lines()}) GROUP BY ALL"


def relative_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For either side of the contract."""
    made = clauses(spark, sf_dir).withColumn("side", F.explode(F.array(F.lit("user"), F.lit("other"))))
    other = F.when(F.col("contract_type") == "lease", "landlord").otherwise("supplier")
    made = made.withColumn("party_role", F.when(F.col("side") == "user", F.col("party_role")).otherwise(other))
    return counted(learned.relative(factory.once(made.select("v", "side", "text", "lang", "party_role"))).select("v", "side", "lines", "relative"))


def _relative_sql() -> str:
    def said(t: str, a: str, b: str) -> str:
        t = t.replace("{A}", a).replace("{B}", b).replace("'", "''")
        return "replace(replace('" + t + "', '{n}', CAST(n AS VARCHAR)), '{p}', CAST(p AS VARCHAR))"

    text = "CASE " + " ".join(f"WHEN v = {v} AND side = '{s}' THEN {said(t, *ab)}" for v, (_, t) in enumerate(READS) for s, ab in (("user", ("USER", "CP")), ("other", ("CP", "USER")))) + " END"
    return f"SELECT v, side, relative, count(*) AS lines FROM (SELECT v, side, {text} || ' ' || {_tokens_sql()} AS relative FROM {_lines()}, (VALUES ('user'), ('other')) AS t(side)) GROUP BY ALL"


RELATIVE_SQL = _relative_sql()


def kept(spark: SparkSession):
    """Rows written to the shared folder and read back, so that no model is fitted twice and no lineage grows."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"file:///tmp/clausewise-learned-{uuid.uuid4().hex}"

    def keep(df: DataFrame, schema: StructType | None = None) -> DataFrame:
        at = f"{folder}/learned-{uuid.uuid4().hex}"
        df.write.parquet(at)
        return spark.read.parquet(at) if schema is None else spark.read.schema(schema).parquet(at)

    return keep


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parameters of a contract's lines say of its clauses."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    p, n, ends = F.round(F.col("l_discount") * 100).cast("int"), F.col("l_quantity").cast("int"), F.col("l_returnflag") == "R"
    level = F.when(ends, F.when(n < 30, 2)).when(p == 10, 1).when(p >= 5, 3).when(p >= 2, 2).otherwise(1)
    own = lines.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("2."), F.row_number().over(w).cast("string")).alias("clause_id"), F.when(ends, "termination").otherwise("penalty").alias("category"), level.alias("level"))
    return own.where("level is not null").withColumn("gold_ord", F.lit(0))


def trained(spark: SparkSession, sf_dir: str, docs: DataFrame, parsed: DataFrame, keep, found: DataFrame) -> learned.ClauseModel:
    """On every clause of every contract."""
    mine = parsed.where(findings.analysable()).withColumn("party_role", F.lit("tenant"))
    rows = learned.training_frame(mine.select("doc_id", "clause_id", "text", "lang", "party_role"), gold(spark, sf_dir))
    quiet = learned.silent(parsed, docs.select("doc_id", F.lit("tenant").alias("party_role")), found)
    return learned.train(rows, keep, quiet, k=2)


def screened(spark: SparkSession, sf_dir: str):
    """Contracts, their clauses, the tenant's requests, what the rule of daily rates finds, and a model; each written once."""
    from clausewise.plans.catalogue import contracts

    keep = kept(spark)
    docs = contracts(spark, sf_dir)
    parsed = keep(segment.clauses_by_form(docs))
    asked = docs.select("doc_id", F.lit("tenant").alias("party_role"))
    found = keep(findings.dedupe(findings.of_clauses(parsed, asked, (rules.daily_rate,))))
    return parsed, asked, found, trained(spark, sf_dir, docs, parsed, keep, found)


def ml_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clause of every contract, scored for the tenant."""
    parsed, asked, _, model = screened(spark, sf_dir)
    scores = learned.scored(parsed, asked, model)
    return scores.select("doc_id", "clause_id", F.bround("score", 6).alias("score"), (F.col("score") >= model.threshold).alias("risky"), "category", "level", F.array_join("reasons", "; ").alias("reasons"))


def hybrid_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules first, then the model on what they are silent on: findings by source, category and level."""
    parsed, asked, found, model = screened(spark, sf_dir)
    both, _ = learned.hybrid(parsed, asked, found, model)
    return both.groupBy("source", "category", "level").agg(F.count("*").alias("findings"))


QUERIES = {"feature_tokens": (feature_tokens, TOKENS_SQL), "relative_text": (relative_text, RELATIVE_SQL), "ml_scores": (ml_scores, None), "hybrid_routing": (hybrid_routing, None)}
