"""Queries of findings, comparison, corpora, evaluation and assessment over the driver's tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.operators import analyzer, assess, compare, extraction, findings, measures, retrieval, rules
from clausewise.plans import factory
from clausewise.plans.learning import kept
from clausewise.sources import corpus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- corpora -----------------------------------------------------------------

LICENCES = [("web", "authored_cc0"), ("books", "cc_by"), ("forum", "candidate")]


def _sources() -> str:
    return "CASE WHEN doc_id % 4 = 3 THEN 'unknown' WHEN doc_id % 4 = 2 THEN 'forum' WHEN doc_id % 4 = 1 THEN 'books' ELSE 'web' END"


def licence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as wordings of four sources: how many may be loaded, and why the others may not."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", f"{_sources()} AS source_id")
    sources = spark.createDataFrame(LICENCES, "id string, license_status string")
    good, bad = corpus.licence_gate(rows, sources)
    both = good.withColumn("reason", F.lit("loaded")).unionByName(bad)
    return both.groupBy("source_id", "reason").agg(F.count("*").alias("rows"))


LICENCE_SQL = f"SELECT source_id, CASE source_id WHEN 'unknown' THEN 'unknown source' WHEN 'forum' THEN 'licence candidate' ELSE 'loaded' END AS reason, count(*) AS rows FROM (SELECT {_sources()} AS source_id FROM documents) GROUP BY ALL"


def _wordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as wordings: type, category and whom they favour by their ids."""
    side = "CASE WHEN doc_id % 5 < 2 THEN 'neutral' WHEN doc_id % 7 < 3 THEN element_at(array('landlord', 'supplier', 'contractor'), cast(doc_id % 3 + 1 as int)) ELSE element_at(array('tenant', 'buyer', 'customer'), cast(doc_id % 3 + 1 as int)) END"
    return table(spark, sf_dir, "documents").selectExpr("element_at(array('lease', 'supply', 'works'), cast(doc_id % 3 + 1 as int)) AS contract_type", "element_at(array('penalty', 'payment', 'liability'), cast((doc_id div 3) % 3 + 1 as int)) AS category", f"{side} AS favours")


BALANCE_SQL = "SELECT ['lease', 'supply', 'works'][doc_id % 3 + 1] AS contract_type, ['penalty', 'payment', 'liability'][(doc_id // 3) % 3 + 1] AS category, count(*) FILTER (doc_id % 5 < 2) AS neutral, count(*) FILTER (doc_id % 5 >= 2 AND doc_id % 7 < 3) AS side_a, count(*) FILTER (doc_id % 5 >= 2 AND doc_id % 7 >= 3) AS side_b FROM documents GROUP BY ALL"


def balance_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.balance_audit(corpus.balance_of(_wordings(spark, sf_dir))).withColumn("problems", F.array_join("problems", "; "))


AUDIT_SQL = f"SELECT * FROM (SELECT *, concat_ws('; ', CASE WHEN neutral / CAST(neutral + side_a + side_b AS DOUBLE) < 0.5 THEN 'few neutral' END, CASE WHEN abs(side_a - side_b) > 1 THEN 'uneven sides' END) AS problems FROM ({BALANCE_SQL})) WHERE problems <> ''"


def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.coverage_audit(_wordings(spark, sf_dir))


COVERAGE_SQL = (
    "SELECT t.contract_type, c.category FROM (VALUES ('lease'), ('supply'), ('works')) AS t(contract_type), (VALUES ('penalty'), ('auto_renewal'), ('liability'), ('force_majeure'), ('jurisdiction'), ('termination'), ('unilateral_change'), ('payment'), ('acceptance')) AS c(category) "
    f"WHERE NOT (t.contract_type = 'lease' AND c.category IN ('payment', 'acceptance')) AND (t.contract_type, c.category) NOT IN (SELECT (contract_type, category) FROM ({BALANCE_SQL}) WHERE neutral > 0)"
)


def exact_leak_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that occur among documents, every third of them planted there in capitals and other white space."""
    items = table(spark, sf_dir, "benchmark")
    planted = items.where("item_id % 3 = 0").select((-F.col("item_id") - 1).alias("id"), F.concat(F.lit("  "), F.regexp_replace(F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), " ", "\n "), F.lit("\t")).alias("text"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(planted)
    return corpus.exact_leaks(items.select(F.col("item_id").alias("id"), "text"), docs).select(F.col("id").alias("item_id"))


LEAK_SQL = r"SELECT item_id FROM benchmark WHERE item_id % 3 = 0 OR lower(regexp_replace(trim(text), '\s+', ' ', 'g')) IN (SELECT lower(regexp_replace(trim(text), '\s+', ' ', 'g')) FROM documents)"

# --- findings ----------------------------------------------------------------


def findings_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as findings of an order's clauses (null for the whole contract): one of each clause and category stays."""
    f = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS doc_id", "'tenant' AS party_role", "if(l_linenumber = 7, null, cast(l_linenumber % 3 as string)) AS clause_id", "if(l_returnflag = 'R', 'penalty', 'payment') AS category", "cast(l_quantity % 3 + 1 as int) AS level",
        "cast(l_linenumber * 1000000 + l_partkey * 4 + l_suppkey % 4 as long) AS hit_ord",
    )
    return findings.dedupe(f).groupBy("doc_id", "clause_id", "category").agg(F.max("level").cast("long").alias("level"), F.count("*").alias("kept"), F.min("hit_ord").alias("hit_ord"))


DEDUPE_SQL = "SELECT doc_id, clause_id, category, level, 1 AS kept, hit_ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, clause_id, category ORDER BY level DESC, hit_ord) AS n FROM (SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_linenumber % 3 AS VARCHAR) END AS clause_id, CASE WHEN l_returnflag = 'R' THEN 'penalty' ELSE 'payment' END AS category, CAST(l_quantity % 3 + 1 AS BIGINT) AS level, l_linenumber * 1000000 + l_partkey * 4 + l_suppkey % 4 AS hit_ord FROM lineitem)) WHERE n = 1"


def analysis_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for the tenant of every order's contract: counts by level, verdict and warnings."""
    from clausewise.plans.catalogue import contracts

    docs = contracts(spark, sf_dir)
    asked = docs.select("doc_id", F.lit("tenant").alias("party_role"))
    r = analyzer.reports(docs, asked, kept(spark), lambda c, q: findings.dedupe(findings.of_clauses(c, q, (rules.daily_rate, rules.unilateral_exit))))
    return r.select("doc_id", "title", "contract_type", "language", *[F.col(c).cast("long").alias(c) for c in ("clauses_total", "clauses_analysed", "high", "medium", "low")], "verdict", F.size("warnings").cast("long").alias("warnings"), F.coalesce(F.size("findings"), F.lit(0)).cast("long").alias("findings"))


def _reports_sql() -> str:
    from clausewise.plans.catalogue import ORDER_SQL, SEGMENT_SQL

    verdict = "CASE WHEN coalesce(high, 0) > 0 THEN 'Подписывать в таком виде не стоит' WHEN coalesce(medium, 0) > 0 THEN 'Есть что обсудить до подписания' WHEN coalesce(low, 0) > 0 THEN 'Существенных рисков не найдено, есть что знать' ELSE 'Рискованных условий не найдено' END"
    counts = f"SELECT doc_id, count(*) FILTER (level = 3) AS high, count(*) FILTER (level = 2) AS medium, count(*) FILTER (level = 1) AS low FROM ({ORDER_SQL}) GROUP BY doc_id"
    return (
        "SELECT s.doc_id, 'ДОГОВОР АРЕНДЫ № ' || s.doc_id AS title, 'lease' AS contract_type, 'ru' AS language, clause + heading + preamble + requisites AS clauses_total, clause AS clauses_analysed, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, "
        f"{verdict} AS verdict, 0 AS warnings, coalesce(high + medium + low, 0) AS findings FROM ({SEGMENT_SQL}) s LEFT JOIN ({counts}) c USING (doc_id)"
    )


# --- evaluation --------------------------------------------------------------


def _leveled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "labels")
    gold = rows.where("toxic = 1 or quality = 0").selectExpr("doc_id", "cast(doc_id % 5 as string) AS clause", "if(toxic = 1, 'penalty', 'payment') AS category", "cast(doc_id % 3 + 1 as int) AS level")
    guess = rows.where("doc_id % 7 <> 0").selectExpr("doc_id", "cast(doc_id % 5 as string) AS clause", "if(doc_id % 11 = 0, 'payment', if(toxic = 1, 'penalty', 'payment')) AS category", "cast(doc_id % 4 as int) AS level").where("level > 0")
    return gold, guess


_GOLD_SQL = "(SELECT doc_id, CASE WHEN toxic = 1 THEN 'penalty' ELSE 'payment' END AS category, doc_id % 3 + 1 AS level FROM labels WHERE toxic = 1 OR quality = 0)"
_GUESS_SQL = "(SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'payment' WHEN toxic = 1 THEN 'penalty' ELSE 'payment' END AS category, doc_id % 4 AS level FROM labels WHERE doc_id % 7 <> 0 AND doc_id % 4 > 0)"


def prf_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By document, clause and category, each category on its own."""
    gold, guess = _leveled(spark, sf_dir)
    counts = measures.outcomes(gold, guess, ["doc_id", "clause", "category"])
    out = counts.groupBy("category").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r, f = measures.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.select("category", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


STRICT_SQL = f"SELECT category, tp, fp, fn, round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 6) AS precision, round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM (SELECT coalesce(g.category, p.category) AS category, count(*) FILTER (g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) AS tp, count(*) FILTER (g.doc_id IS NULL) AS fp, count(*) FILTER (p.doc_id IS NULL) AS fn FROM {_GOLD_SQL} g FULL JOIN {_GUESS_SQL} p ON g.doc_id = p.doc_id AND g.category = p.category GROUP BY 1)"


def level_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, guess = _leveled(spark, sf_dir)
    return measures.level_confusion(gold, guess, ["doc_id", "clause", "category"])


CONFUSION_SQL = f"SELECT count(*) AS matches, count(*) FILTER (g.level = p.level) AS right, count(*) FILTER (p.level < g.level) AS under, count(*) FILTER (p.level > g.level) AS over FROM {_GOLD_SQL} g JOIN {_GUESS_SQL} p ON g.doc_id = p.doc_id AND g.category = p.category"


def metric_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection, strict, high only: one row each."""
    gold, guess = _leveled(spark, sf_dir)
    return measures.bundle(gold, guess)


_BUNDLE = "SELECT '{n}' AS measure, count(*) FILTER (g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) AS tp, count(*) FILTER (g.doc_id IS NULL) AS fp, count(*) FILTER (p.doc_id IS NULL) AS fn FROM (SELECT DISTINCT {c} FROM {g} {w}) g FULL JOIN (SELECT DISTINCT {c} FROM {p}) p ON {j}"
BUNDLE_SQL = " UNION ALL ".join(
    _BUNDLE.format(n=n, c=c, g=_GOLD_SQL, w=w, p=p, j=j)
    for n, c, w, p, j in (
        ("detection", "doc_id", "", _GUESS_SQL, "g.doc_id = p.doc_id"),
        ("strict", "doc_id, category", "", _GUESS_SQL, "g.doc_id = p.doc_id AND g.category = p.category"),
        ("high", "doc_id", "WHERE level = 3", f"{_GUESS_SQL} WHERE doc_id IN (SELECT doc_id FROM {_GOLD_SQL} WHERE level = 3)", "g.doc_id = p.doc_id"),
    )
)


def hallucination_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of fields without a gold value how many got one, of those with one how many got none, failed records counted in both."""
    rows = table(spark, sf_dir, "orders").selectExpr("if(o_orderkey % 5 = 0, null, o_orderpriority) AS gold", "if(o_orderkey % 7 = 0, null, o_orderpriority) AS got", "o_orderkey % 11 = 0 AS failed")
    return extraction.rates(rows.select(extraction.outcome(F.col("gold"), F.col("got"), F.col("failed")).alias("outcome"), F.col("gold").isNull().alias("empty")))


RATES_SQL = "SELECT round(count(*) FILTER (o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0) / CAST(count(*) FILTER (o_orderkey % 5 = 0) AS DOUBLE), 6) AS hallucinated, round(count(*) FILTER (o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0) / CAST(count(*) FILTER (o_orderkey % 5 <> 0) AS DOUBLE), 6) AS missed, round(count(*) FILTER (o_orderkey % 11 <> 0 AND ((o_orderkey % 5 = 0) = (o_orderkey % 7 = 0))) / CAST(count(*) AS DOUBLE), 6) AS accuracy FROM orders"

# --- retrieval and comparison ------------------------------------------------


def knn_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in one of four languages, of which two have references: the others ask again in Russian."""
    v = table(spark, sf_dir, "embeddings")
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.expr("element_at(array('ru', 'kk', 'en', 'de'), cast(vec_id div 100 % 4 + 1 as int))").alias("lang"))
    refs = v.select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("vector"), F.expr("if(vec_id % 2 = 0, 'ru', 'kk')").alias("lang"))
    return retrieval.nearest_with_fallback(queries, refs, 3).select("query_id", "rank", "ref_id", "lang", F.round("score", 5).alias("score"))


FALLBACK_SQL = "SELECT query_id, rank, ref_id, lang, round(score, 5) AS score FROM (SELECT q.vec_id AS query_id, r.vec_id AS ref_id, ql AS lang, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 12) DESC, r.vec_id) AS rank FROM (SELECT *, CASE WHEN (vec_id // 100) % 4 = 1 THEN 'kk' ELSE 'ru' END AS ql FROM embeddings WHERE vec_id % 100 = 0) q JOIN embeddings r ON ql = CASE WHEN r.vec_id % 2 = 0 THEN 'ru' ELSE 'kk' END) WHERE rank <= 3"


REFERENCE_PENALTY = "Сторона уплачивает пеню 0,1% за каждый день просрочки, но не более 10% суммы."


def compared_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between each line's penalty, in all wordings, and a reference of 0,1 % a day, 10 % at most."""
    rows = factory.clauses(spark, sf_dir, "penalty.daily_rate").select("v", "n", "p", F.lit("penalty").alias("category"), "text", F.lit(REFERENCE_PENALTY).alias("reference_text"))
    out = compare.with_differences(factory.once(rows)).select("v", "p", "lines", F.array_join("differences", " ").alias("differences"))
    return out.groupBy("v", "p", "differences").agg(F.sum("lines").alias("lines"))


_RATE = "CASE WHEN v < 2 THEN CASE WHEN p NOT IN (0, 1, 10) THEN 'Дневная пеня: 0,' || p || ' %, в образце 0,1 %.' END ELSE 'Дневная пеня: ' || n || ' %, в образце 0,1 %.' END"
_CAP = "CASE WHEN v <> 1 THEN 'Предел неустойки: не установлен, в образце 10 %.' END"
COMPARED_SQL = f"SELECT v, p, differences, count(*) AS lines FROM (SELECT v, p, concat_ws(' ', {_RATE}, {_CAP}) AS differences FROM (SELECT k % 5 AS v, n, p FROM (SELECT {factory.PARAMETERS_SQL} FROM lineitem))) GROUP BY ALL"

#: (category, clause, reference, SQL of what differs), {n} from 1 to 50: a wording to a line's number.
COMPARISONS: list[tuple[str, str, str, str]] = [
    ("penalty", "Поставщик уплачивает штраф {n}% цены партии.", "Пеня 0,1% за каждый день просрочки.", "'Штраф: ' || n || ' %, в образце не предусмотрен.'"),
    ("termination", "Арендодатель вправе расторгнуть договор, предупредив за {n} дней.", "Каждая из сторон вправе отказаться от договора, предупредив за 30 дней.", "concat_ws(' ', CASE WHEN n <> 30 THEN 'Уведомление: ' || n || ' дн., в образце 30 дн.' END, 'Кто может отказаться: одна сторона, в образце каждая сторона.')"),
    ("auto_renewal", "Срок продлевается в любое время, {n}.", "Стороны могут отказаться, предупредив за 30 дней.", "'Уведомление: не нужно, в образце 30 дн. Кто может отказаться: одна сторона, в образце каждая сторона.'"),
    ("payment", "Оплата производится в течение {n} дней.", "Оплата производится в течение 10 дней.", "CASE WHEN n <> 10 THEN 'Расчёты: ' || n || ' дн., в образце 10 дн.' ELSE '' END"),
    ("payment", "Покупатель вносит 100% цены.", "Покупатель вносит аванс 30% цены.", "'Аванс: вся сумма, в образце 30 %, прочее после исполнения.'"),
    ("unilateral_change", "Арендодатель вправе изменить ставку через {n} месяцев.", "Ставка изменяется по соглашению.", "'Изменение цены: одной стороной, в образце по соглашению.'"),
    ("liability", "Подрядчик возмещает упущенную выгоду сверх неустойки.", "Упущенная выгода возмещению не подлежит, неустойка засчитывается.", "'Упущенная выгода: взыскивается, в образце не взыскивается. Неустойка и убытки: складываются, в образце неустойка идёт в зачёт.'"),
    ("liability", "Арендодатель не несет ответственности за {n} часов.", "Стороны отвечают за убытки.", "'Ответственность: снята с одной стороны, в образце лежит на обеих.'"),
    ("acceptance", "Претензии заявляются в течение {n} дней.", "Претензии заявляются в течение 10 дней.", "CASE WHEN n < 10 THEN 'Проверка и претензии: ' || n || ' дн., в образце 10 дн.' ELSE '' END"),
    ("jurisdiction", "Споры рассматривает суд через {n} дней.", "Споры рассматривает суд по месту ответчика.", "''"),
]


def compared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between each line's clause and a reference, in every category that comparison knows, and one that it doesn't."""
    made = factory.worded(factory.lines(spark, sf_dir).withColumn("v", F.pmod(F.col("k") + F.col("n"), F.lit(len(COMPARISONS)))), [(text, category, reference, "", "") for category, text, reference, _ in COMPARISONS])
    rows = made.select("v", "n", F.col("contract_type").alias("category"), "text", F.col("lang").alias("reference_text"))
    return compare.with_differences(factory.once(rows)).groupBy("v", "n", F.array_join("differences", " ").alias("differences")).agg(F.sum("lines").alias("lines"))


TERMS_SQL = f"SELECT v, n, CASE {' '.join(f'WHEN v = {v} THEN {c[3]}' for v, c in enumerate(COMPARISONS))} END AS differences, count(*) AS lines FROM (SELECT (k + n) % {len(COMPARISONS)} AS v, n FROM (SELECT {factory.PARAMETERS_SQL} FROM lineitem)) GROUP BY ALL"


def quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote for each document, by its number: of its own words, of another one's, with a letter changed, in capitals and «quotes», too short, with signs of a pattern."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))
    own = F.array_join(F.slice(words, F.greatest(F.least(F.lit(3), F.size(words) - 5), F.lit(1)), 6), "  ")
    quote = (
        F.when(F.col("doc_id") % 6 == 1, F.concat(F.lit("zq"), own, F.lit(" zqz"))).when(F.col("doc_id") % 6 == 2, F.concat(F.lit("«"), F.translate(own, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("».")))
        .when(F.col("doc_id") % 6 == 3, "q").when(F.col("doc_id") % 6 == 4, F.concat(own, F.lit(" [a-z]+(.*)?$"))).when(F.col("doc_id") % 6 == 5, F.lit(None).cast("string")).otherwise(own)
    )
    return docs.where("text is not null").select("doc_id", "text", quote.alias("quote"))


def quote_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether and where each document's quote stands in it."""
    rows = quoted(spark, sf_dir)
    place = extraction.place_of(F.col("quote"), F.col("text"))
    return rows.select("doc_id", place.isNotNull().alias("found"), F.coalesce(extraction.grounded(F.col("quote"), F.col("text")), F.lit(False)).alias("grounded"))


_OWN = "array_to_string(list_slice(w, greatest(least(3, len(w) - 5), 1), greatest(least(3, len(w) - 5), 1) + 5), ' ')"
GROUNDING_SQL = (
    rf"""SELECT doc_id, doc_id % 6 IN (0, 2) AND length(regexp_replace({_OWN}, '^[ .,;:"''«»“”„]+|[ .,;:"''«»“”„]+$', '', 'g')) >= 3 AS found, doc_id % 6 IN (0, 2) AND length(regexp_replace({_OWN}, '^[\s.,;:''…-]+|[\s.,;:''…-]+$', '', 'g')) >= 3 AS grounded """
    r"FROM (SELECT doc_id, regexp_extract_all(text, '[^\s]+') AS w FROM documents WHERE text IS NOT NULL)"
)

# --- assessment --------------------------------------------------------------


def mock_reply(prompt: str) -> str:
    """A model that quotes the first words of the clause, and breaks each rule of acceptance now and then, by the prompt."""
    import zlib

    clause = prompt.rpartition("«")[2].rstrip("»")
    n = zlib.crc32(prompt.encode()) % 10
    if n == 0:
        return json.dumps({"refusal": True})
    a = {"is_risky": n != 1, "category": "payment" if n != 2 else "nonsense", "level": "high" if n % 2 else "low", "evidence_quote": "нет такой цитаты" if n == 3 else clause[:40], "explanation": "Проверка.", "safer_wording": None, "confidence": 0.2 if n == 4 else 0.9}
    return "```json\n" + json.dumps(a, ensure_ascii=False) + "\n```"


def llm_mock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of every contract on payment by advance, assessed by a mock: what became of them. Equal clauses are assessed once and counted."""
    keep = kept(spark)
    lines = factory.once(factory.clauses(spark, sf_dir, "payment.full_prepayment").select("party_role", "text", "lang"))
    clauses = lines.select("party_role", F.lit("1").alias("clause_id"), F.lit(None).cast("string").alias("section_title"), "text", "lang", "lines")
    answers, _ = assess.assessed(clauses, extraction.Mock(mock_reply), "mock", spark.createDataFrame([], assess.CACHE), keep)
    return assess.counters(assess.judged(answers), "lines")


def queries() -> dict[str, tuple]:
    return {
        "licence_gate": (licence_gate, LICENCE_SQL), "balance_audit": (balance_audit, AUDIT_SQL), "coverage_audit": (coverage_audit, COVERAGE_SQL), "exact_leak_planted": (exact_leak_planted, LEAK_SQL), "findings_dedupe": (findings_dedupe, DEDUPE_SQL),
        "analysis_reports": (analysis_reports, _reports_sql()), "prf_strict": (prf_strict, STRICT_SQL), "level_confusion": (level_confusion, CONFUSION_SQL), "metric_bundle": (metric_bundle, BUNDLE_SQL), "hallucination_rate": (hallucination_rate, RATES_SQL),
        "knn_fallback": (knn_fallback, FALLBACK_SQL), "compared_penalties": (compared_penalties, COMPARED_SQL), "compared_terms": (compared_terms, TERMS_SQL), "quote_grounding": (quote_grounding, GROUNDING_SQL),
        "llm_mock": (llm_mock, None),
    }
