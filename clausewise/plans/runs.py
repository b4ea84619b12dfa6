"""A harness's runs over contracts whose gold is known from their parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.operators import findings, rules, segment
from clausewise.operators.harness import Detector, Runs, dataset_hash, detector


def daily(clauses: DataFrame, asked: DataFrame) -> DataFrame:
    return findings.dedupe(findings.of_clauses(clauses, asked, (rules.daily_rate,)))


#: Daily rates only; the same, but all of them called high.
OWN = {"daily": Detector("daily", daily, {"rules": ["daily_rate"]}), "loud": Detector("loud", lambda c, r: daily(c, r).withColumn("level", F.lit(3)), {"level": 3})}


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of clauses what their parameters say, and a clause that isn't there for orders divisible by ten; of documents the missing force majeure, but for orders divisible by three."""
    from clausewise.plans import learning

    own = learning.gold(spark, sf_dir).select("doc_id", F.col("clause_id").alias("clause"), "category", "level")
    orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("m"))
    absent = orders.where("doc_id % 10 = 0").select("doc_id", F.lit("9.9").alias("clause"), F.lit("payment").alias("category"), F.lit(3).alias("level"))
    whole = orders.where("doc_id % 2 = 1 and m >= 2 and doc_id % 3 <> 0").select("doc_id", F.lit(None).cast("string").alias("clause"), F.lit("force_majeure").alias("category"), F.lit(2).alias("level"))
    return own.unionByName(absent).unionByName(whole)


def ran(spark: SparkSession, sf_dir: str, folder: str, names: tuple[str, ...] = ("null", "daily", "loud", "rules")) -> Runs:
    """Every contract, read once, through each detector for the tenant."""
    from clausewise.plans.catalogue import contracts

    texts = contracts(spark, sf_dir)
    docs = texts.select("doc_id", F.lit("lease").alias("contract_type"), F.lit("ru").alias("language"), F.concat(F.lit("o"), (F.col("doc_id") % 4).cast("string")).alias("origin"))
    at = f"{folder}/clauses-{uuid.uuid4().hex}"
    segment.clauses_by_form(texts).write.parquet(at)
    clauses, labels, runs = spark.read.parquet(at), gold(spark, sf_dir), Runs(spark, f"{folder}/runs")
    dataset = dataset_hash(docs, labels, clauses.select("doc_id", "clause_id", "text"))
    for name in names:
        runs.add(detector(name, OWN), "made", docs, labels, clauses, docs.select("doc_id", F.lit("tenant").alias("party_role")), dataset)
    return runs


def harness_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four detectors' measures over all documents (origin is null) and by origin, from the tables of runs alone."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file:///tmp"
    runs = ran(spark, sf_dir, f"{base}/harness-{uuid.uuid4().hex}")
    both = runs.measured().withColumn("origin", F.lit(None).cast("string")).unionByName(runs.measured("origin"))
    return both.join(F.broadcast(runs.runs().select("run_id", "detector")), "run_id").select("detector", "origin", "measure", "docs", "alarmed", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


HARNESS_SQL = """
WITH x AS (SELECT l_orderkey AS d, '2.' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS c, l_returnflag = 'R' AS ends, CAST(l_quantity AS INT) AS n, CAST(round(l_discount * 100) AS INT) AS p, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem),
k AS (SELECT d, c, CASE WHEN ends THEN 'termination' ELSE 'penalty' END AS cat, CASE WHEN ends THEN 2 WHEN p = 10 THEN 1 WHEN p >= 5 THEN 3 WHEN p >= 2 THEN 2 ELSE 1 END AS lev FROM x WHERE NOT ends OR n < 30),
o AS (SELECT d, max(m) AS m, bool_or(NOT ends) AS pays FROM x GROUP BY d),
g AS (SELECT * FROM k UNION ALL SELECT d, '9.9', 'payment', 3 FROM o WHERE d % 10 = 0 UNION ALL SELECT d, NULL, 'force_majeure', 2 FROM o WHERE d % 2 = 1 AND m >= 2 AND d % 3 <> 0),
p AS (SELECT 'daily' AS detector, * FROM k WHERE cat = 'penalty' UNION ALL SELECT 'loud', d, c, cat, 3 FROM k WHERE cat = 'penalty' UNION ALL SELECT 'rules', * FROM k UNION ALL SELECT 'rules', d, NULL, 'force_majeure', 2 FROM o WHERE d % 2 = 1 AND m >= 2 UNION ALL SELECT 'rules', d, NULL, 'liability', 2 FROM o WHERE pays AND m + 3 + CASE WHEN d % 2 = 0 THEN 1 ELSE 0 END >= 5),
t AS (SELECT unnest(['null', 'daily', 'loud', 'rules']) AS detector),
gs AS (SELECT * FROM t, g), j AS (SELECT coalesce(gs.detector, p.detector) AS detector, coalesce(gs.d, p.d) AS d, coalesce(gs.c, p.c) AS c, gs.lev AS gl, p.lev AS pl FROM gs FULL JOIN p ON gs.detector = p.detector AND gs.d = p.d AND gs.cat = p.cat AND gs.c IS NOT DISTINCT FROM p.c),
u AS (SELECT detector, d, c, max(gl) AS gl, max(pl) AS pl FROM j GROUP BY ALL),
r AS (
 SELECT detector, d, CASE WHEN c IS NULL THEN 'document' ELSE 'strict' END AS measure, CAST(gl IS NOT NULL AND pl IS NOT NULL AS INT) AS tp, CAST(gl IS NULL AS INT) AS fp, CAST(pl IS NULL AS INT) AS fn FROM j
 UNION ALL SELECT detector, d, 'level', CAST(gl = pl AS INT), CAST(pl > gl AS INT), CAST(pl < gl AS INT) FROM j WHERE c IS NOT NULL AND gl IS NOT NULL AND pl IS NOT NULL
 UNION ALL SELECT detector, d, 'detection', CAST(gl IS NOT NULL AND pl IS NOT NULL AS INT), CAST(gl IS NULL AS INT), CAST(pl IS NULL AS INT) FROM u WHERE c IS NOT NULL
 UNION ALL SELECT detector, d, 'high', CAST(pl IS NOT NULL AS INT), 0, CAST(pl IS NULL AS INT) FROM u WHERE c IS NOT NULL AND gl = 3
 UNION ALL SELECT detector, d, 'coverage', CAST(c <> '9.9' AS INT), 0, CAST(c = '9.9' AS INT) FROM u WHERE c IS NOT NULL AND gl IS NOT NULL
 UNION ALL SELECT t.detector, d, unnest(['detection', 'high', 'coverage']), 0, 0, 0 FROM t, o
 UNION ALL SELECT t.detector, o.d, 'clean', 0, CAST((SELECT count(*) FROM p WHERE p.detector = t.detector AND p.d = o.d) AS INT), 0 FROM t, o WHERE o.d NOT IN (SELECT d FROM g)
),
s AS (SELECT detector, origin, measure, d, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT *, NULL AS origin FROM r UNION ALL SELECT *, 'o' || d % 4 FROM r) GROUP BY ALL),
a AS (SELECT detector, origin, measure, count(*) AS docs, count(*) FILTER (fp > 0) AS alarmed, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM s GROUP BY ALL)
SELECT detector, origin, measure, docs, alarmed, tp, fp, fn, round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 6) AS precision, round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) WHEN tp + fp + fn > 0 THEN 0.0 END, 6) AS f1 FROM a
"""

QUERIES = {"harness_runs": (harness_runs, HARNESS_SQL)}
