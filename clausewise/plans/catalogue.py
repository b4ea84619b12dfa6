"""The library's queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewise.dims import TYPE_OF, lookup
from clausewise.functions import numbers, text
from clausewise.operators import extraction, findings, measures, parties, retrieval, rules, segment
from clausewise.plans import drafts, factory, fields, indexed, learning, papers, runs, screening, shapes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BY_NAME = {r.__name__: r for r in rules.RULES}
RULE_OF = {
    "penalty.daily_rate": "daily_rate", "penalty.fine": "single_fine", "auto_renewal": "auto_renewal", "liability.lost_profit": "lost_profit", "liability.exclusion": "exclusion", "force_majeure": "force_majeure", "jurisdiction": "jurisdiction",
    "termination.unilateral": "unilateral_exit", "termination.cannot_exit": "cannot_exit", "termination.early_fee": "early_fee", "termination.deposit_forfeit": "deposit", "unilateral_change": "change", "payment": "payment", "acceptance": "acceptance",
}


def rule(spark: SparkSession, sf_dir: str, rule_id: str) -> DataFrame:
    fn = BY_NAME[RULE_OF.get(rule_id) or RULE_OF[rule_id.split(".")[0]]]
    made = factory.once(factory.clauses(spark, sf_dir, rule_id).drop("k"))
    each = rules.hits(made, (fn,)).select("v", "n", "p", "lines", "party_role", F.explode("hits").alias("h"))
    mine = each.where((F.col("h.rule_id") == rule_id) & F.array_contains("h.against", F.col("party_role")))
    lines = mine.groupBy("v", "n", "p", F.col("h.level").alias("level")).agg(F.sum("lines").alias("lines"))
    return lines.groupBy("v", "level").agg(F.count("*").alias("clauses"), F.sum("lines").alias("lines"))


def counted(each: DataFrame, at: int) -> DataFrame:
    """Distinct rows (their own `lines` aside) with how many lines have them, in place `at`."""
    own = [c for c in each.columns if c != "lines"]
    return each.groupBy(*own).agg(F.sum("lines").alias("lines")).select(*own[:at], "lines", *own[at:])


# --- numbers, spans, parties -------------------------------------------------


def percent_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first daily rate and its place, the first cap, and the fines, of every line's penalty in all wordings."""
    made = factory.once(factory.clauses(spark, sf_dir, "penalty.daily_rate").select("v", "n", "p", "text"))
    s = made.select("v", "n", "p", "lines", numbers.percents(F.col("text")).alias("s"))
    at = lambda k: F.get(numbers.of_kind(F.col("s"), k), F.lit(0))
    return counted(s.select("v", "n", "p", "lines", at("daily")["value"].alias("rate"), at("daily")["start"].cast("long").alias("rate_start"), at("cap")["value"].alias("cap"), F.size(numbers.of_kind(F.col("s"), "fine")).cast("long").alias("fines")), 3)


def _rate_starts() -> str:
    """Where the number stands that is each wording's rate, by counting in the wordings."""
    return " ".join(f"WHEN v = {v} THEN {w[0].index('0,{p}') if '{p}' in w[0] else w[0].index('{n}')}" for v, w in enumerate(factory.WORDINGS["penalty.daily_rate"]))


PERCENT_SQL = f"SELECT v, n, p, count(*) AS lines, CASE WHEN v < 2 THEN CAST('0.' || p AS DOUBLE) ELSE CAST(n AS DOUBLE) END AS rate, CASE {_rate_starts()} END AS rate_start, CASE WHEN v = 1 THEN CAST(n AS DOUBLE) END AS cap, 0 AS fines FROM (SELECT k % 5 AS v, n, p FROM (SELECT {factory.PARAMETERS_SQL} FROM lineitem)) GROUP BY ALL"


PERCENT_WORDINGS = [*factory.WORDINGS["penalty.daily_rate"], factory.WORDINGS["penalty.fine"][0], factory.WORDINGS["penalty.fine"][2]]


def percent_spans_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all three kinds in every line's clause: uncapped and capped rates, both languages, fines."""
    made = factory.once(factory.worded(factory.lines(spark, sf_dir).withColumn("v", F.pmod("k", F.lit(len(PERCENT_WORDINGS)))), PERCENT_WORDINGS).select("v", "n", "p", "text"))
    s = made.select("v", "n", "p", "lines", numbers.percents(F.col("text")).alias("s"))
    of = lambda k: numbers.of_kind(F.col("s"), k)
    at = lambda k, f: F.get(of(k), F.lit(0))[f]
    found = s.select("v", "n", "p", "lines", at("daily", "value").alias("rate"), at("daily", "start").cast("long").alias("rate_start"), at("cap", "value").alias("cap"), at("fine", "value").alias("fine"), at("fine", "start").cast("long").alias("fine_start"), F.size(of("fine")).cast("long").alias("fines"))
    return counted(found, len(found.columns) - 1)


def percent_all_sql() -> str:
    start = [w[0].replace("0,{p}", "{n}", 1).index("{n}") for w in PERCENT_WORDINGS]
    places = " ".join(f"WHEN {v} THEN {x}" for v, x in enumerate(start))
    return (
        "SELECT v, n, p, CASE WHEN v < 2 THEN CAST('0.' || p AS DOUBLE) WHEN v < 5 THEN CAST(n AS DOUBLE) END AS rate, CASE WHEN v < 5 THEN x END AS rate_start, CASE WHEN v = 1 THEN CAST(n AS DOUBLE) END AS cap, "
        "CASE WHEN v >= 5 THEN CAST(n AS DOUBLE) END AS fine, CASE WHEN v >= 5 THEN x END AS fine_start, CASE WHEN v >= 5 THEN 1 ELSE 0 END AS fines, count(*) AS lines "
        f"FROM (SELECT n, p, k % {len(start)} AS v, CASE k % {len(start)} {places} END AS x FROM (SELECT {factory.PARAMETERS_SQL} FROM lineitem)) GROUP BY v, n, p, x"
    )


def duration_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = factory.lines(spark, sf_dir).select("n", "p")
    t = F.concat(F.lit("Срок — "), F.col("n").cast("string"), F.lit(" (прописью) календарных дней, уведомление за "), F.col("p").cast("string"), F.lit(" часов, отсрочка три месяца."))
    d = factory.once(made.withColumn("text", t)).withColumn("d", numbers.durations(F.col("text")))
    v = lambda i: F.get(F.col("d"), F.lit(i))["value"]
    each = d.select("n", "p", "lines", F.size("d").cast("long").alias("found"), v(0).alias("days"), F.round(v(1), 6).alias("hours_as_days"), v(2).alias("months_as_days"), F.size(numbers.notices(F.col("text"), F.col("d"))).cast("long").alias("notices"))
    return counted(each, 2)


DURATION_SQL = f"SELECT n, p, count(*) AS lines, 3 AS found, CAST(n AS DOUBLE) AS days, round(p / 24.0, 6) AS hours_as_days, CAST(90 AS DOUBLE) AS months_as_days, 1 AS notices FROM (SELECT {factory.PARAMETERS_SQL} FROM lineitem) GROUP BY n, p"


def party_payers(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ["Арендатор уплачивает Арендодателю сумму", "Арендодатель вправе взыскать с Арендатора сумму", "сумма, уплачиваемая Арендодателем за задержку", "Арендодатель направляет уведомление", "от Генерального арендатора получена сумма"]
    made = factory.lines(spark, sf_dir).select(F.pmod("k", F.lit(len(forms))).alias("v"), "n")
    t = F.concat(F.get(F.array(*map(F.lit, forms)), F.col("v")), F.lit(" "), F.col("n").cast("string"), F.lit("."))
    c = factory.once(made.select("*", t.alias("text"), F.lit("lease").alias("contract_type"), F.lit("ru").alias("lang"))).withColumn("mentions", parties.mentions())
    return counted(c.select("v", "n", "lines", F.size("mentions").cast("long").alias("mentions"), F.array_join(F.array_sort(parties.payers()), ",").alias("payers")), 2)


PAYERS_SQL = f"SELECT v, n, count(*) AS lines, CASE v WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 4 THEN 0 ELSE 1 END AS mentions, CASE v WHEN 0 THEN 'tenant' WHEN 1 THEN 'tenant' WHEN 2 THEN 'landlord' WHEN 3 THEN 'landlord' ELSE '' END AS payers FROM (SELECT k % 5 AS v, n FROM (SELECT {factory.PARAMETERS_SQL} FROM lineitem)) GROUP BY v, n"


# --- contracts ---------------------------------------------------------------


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contract for each order that has lines: title, preamble, a section of numbered clauses, a section on disputes (and on force majeure for even orders), requisites."""
    lines = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    p, n = F.round(F.col("l_discount") * 100).cast("int"), F.col("l_quantity").cast("int")
    rate = F.concat(F.lit(". За просрочку Арендатор уплачивает пеню 0,"), p.cast("string"), F.lit("% за каждый день."))
    term = F.concat(F.lit(". Арендодатель вправе расторгнуть Договор, предупредив за "), n.cast("string"), F.lit(" дней."))
    i = F.row_number().over(w)
    body = F.concat(F.lit("2."), i.cast("string"), F.when(F.col("l_returnflag") == "R", term).otherwise(rate))
    per = lines.select("l_orderkey", F.struct(i.alias("i"), body.alias("line")).alias("x")).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("body"))
    fm = F.when(F.col("l_orderkey") % 2 == 0, "3. ФОРС-МАЖОР\n3.1. Стороны освобождаются от ответственности при непреодолимой силе.\n").otherwise("")
    t = F.concat(F.lit("ДОГОВОР АРЕНДЫ № "), F.col("l_orderkey").cast("string"), F.lit("\nг. Алматы, 1 мая\n1. ПРЕДМЕТ ДОГОВОРА\n1.1. Арендодатель передает помещение.\n1.2. Помещение осмотрено.\n1.3. Срок указан в акте.\n2. ПЛАТА\n"), F.col("body"), F.lit("\n"), fm, F.lit("4. РЕКВИЗИТЫ СТОРОН\nАрендодатель:\nАрендатор:"))
    # few bytes that cost much to read: not to be coalesced into one task
    return per.select(F.col("l_orderkey").alias("doc_id"), t.alias("text")).repartition(3 * spark.sparkContext.defaultParallelism)


def requests(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(F.array(F.lit("tenant"), F.lit("landlord"))).alias("party_role"))


def segment_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = segment.clauses_by_form(contracts(spark, sf_dir))
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("clause", "heading", "preamble", "requisites")]
    return c.groupBy("doc_id").agg(*kinds, F.max("level").cast("long").alias("depth"), F.count_if(F.col("parent_id").isNotNull()).alias("children"))


SEGMENT_SQL = "SELECT l_orderkey AS doc_id, count(*) + 3 + CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 0 END AS clause, 2 + CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 0 END AS heading, 1 AS preamble, 1 AS requisites, 2 AS depth, count(*) + 3 + CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 0 END AS children FROM lineitem GROUP BY l_orderkey"


def doc_force_majeure_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = contracts(spark, sf_dir)
    found = findings.of_documents(learning.kept(spark)(segment.clauses_by_form(docs)), requests(docs))
    return found.where("rule_id = 'document.force_majeure_missing'").select("doc_id", "party_role", F.col("level").cast("long").alias("level"))


FM_SQL = "SELECT l_orderkey AS doc_id, unnest(['tenant', 'landlord']) AS party_role, 2 AS level FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) WHERE l_orderkey % 2 = 1 AND n + 3 >= 5"


def doc_liability_one_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = contracts(spark, sf_dir)
    found = findings.of_documents(learning.kept(spark)(segment.clauses_by_form(docs)), requests(docs))
    return found.where("rule_id = 'document.liability_one_sided'").select("doc_id", "party_role", F.element_at("details", "user_clauses").alias("clauses"))


NUMBERED_SQL = "SELECT l_orderkey, l_returnflag, CAST(round(l_discount * 100) AS INT) AS p, CAST(l_quantity AS INT) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem"
ONE_SIDED_SQL = f"SELECT l_orderkey AS doc_id, 'tenant' AS party_role, string_agg('2.' || i, ', ' ORDER BY i) AS clauses FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS m FROM ({NUMBERED_SQL})) WHERE l_returnflag <> 'R' AND m + 3 + CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE 0 END >= 5 GROUP BY l_orderkey"


def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = contracts(spark, sf_dir)
    found = findings.of_clauses(learning.kept(spark)(segment.clauses_by_form(docs)), requests(docs), (rules.daily_rate, rules.unilateral_exit))
    return findings.ordered(findings.dedupe(found)).select("doc_id", "party_role", "finding_ord", "clause_id", "category", F.col("level").cast("long").alias("level"))


ORDER_SQL = f"SELECT doc_id, party_role, row_number() OVER (PARTITION BY doc_id ORDER BY level DESC, i) AS finding_ord, '2.' || i AS clause_id, category, level FROM (SELECT l_orderkey AS doc_id, 'tenant' AS party_role, i, CASE WHEN l_returnflag = 'R' THEN 'termination' ELSE 'penalty' END AS category, CASE WHEN l_returnflag = 'R' THEN CASE WHEN n < 30 THEN 2 END WHEN p = 10 THEN 1 WHEN p >= 5 THEN 3 WHEN p >= 2 THEN 2 ELSE 1 END AS level FROM ({NUMBERED_SQL})) WHERE level IS NOT NULL"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the tenant: which clauses carry a daily penalty, at what level, with which quote."""
    docs = contracts(spark, sf_dir).withColumn("text", text.normalized(F.col("text")))
    asked = docs.select("doc_id", F.lit("tenant").alias("party_role"))
    found = findings.dedupe(findings.of_clauses(learning.kept(spark)(segment.clauses_by_form(docs)), asked, (rules.daily_rate,)))
    return found.select("doc_id", "clause_id", "level", F.col("evidence")[0]["quote"].alias("quote"))


FLAGSHIP_SQL = f"SELECT l_orderkey AS doc_id, '2.' || i AS clause_id, CASE WHEN p = 10 THEN 1 WHEN p >= 5 THEN 3 WHEN p >= 2 THEN 2 ELSE 1 END AS level, '0,' || p || '%' AS quote FROM ({NUMBERED_SQL}) WHERE l_returnflag <> 'R'"


# --- text --------------------------------------------------------------------


def normalize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.normalized(F.concat(F.lit("​  "), F.regexp_replace("text", " ", "  "), F.lit("\r\nстр. 3 из 9\r\nобяза-\nтельства\n\n\n\nend")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t).alias("h"))


NORMALIZE_SQL = r"SELECT doc_id, md5(regexp_replace(regexp_replace(list_aggregate(list_filter(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '\t', ' ', 'g'), ' {2,}', ' ', 'g'), ' ')), lambda x: NOT regexp_matches(x, '^([-–—]\s*\d{1,3}\s*[-–—]|\d{1,3}\s*(из|/)\s*\d{1,3})$')), 'string_agg', chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') || chr(10) || 'обязательства' || chr(10) || chr(10) || 'end' || chr(10)) AS h FROM documents"


def letter_share_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    share = text.letter_share(t, "äöüßÄÖÜ", r"\p{L}")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(share, 6).alias("share"), F.when((F.regexp_count(t, F.lit("[äöüßÄÖÜ]")) >= 2) & (share >= 0.02), "de").otherwise("other").alias("guess"))


SHARE_SQL = r"SELECT doc_id, round(s, 6) AS share, CASE WHEN k >= 2 AND s >= 0.02 THEN 'de' ELSE 'other' END AS guess FROM (SELECT doc_id, k, CASE WHEN a = 0 THEN 0.0 ELSE k / CAST(a AS DOUBLE) END AS s FROM (SELECT doc_id, length(regexp_replace(text, '[^äöüßÄÖÜ]', '', 'g')) AS k, length(regexp_replace(text, '[^\pL]', '', 'g')) AS a FROM documents))"

WORDS_BY_TYPE = {"en": [r"\bthe\b", r"\bof\b"], "de": [r"\bder\b", r"\bdie\b"], "fr": [r"\ble\b", r"\bque\b"]}


def type_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = text.type_scores(F.col("text"), None, WORDS_BY_TYPE)
    return table(spark, sf_dir, "documents").select("doc_id", *[v.cast("long").alias(k) for k, v in s.items()], text.best_type(s).alias("best"))


TYPE_SQL = "SELECT doc_id, en, de, fr, CASE WHEN greatest(en, de, fr) = 0 THEN NULL WHEN en = greatest(en, de, fr) THEN 'en' WHEN de = greatest(en, de, fr) THEN 'de' ELSE 'fr' END AS best FROM (SELECT doc_id, " + ", ".join(
    "len(list_filter(regexp_split_to_array(lower(substring(text, 1, 3000)), '[^\\pL\\pN_]+'), lambda x: x IN (" + ", ".join(repr(w[2:-2]) for w in ws) + f"))) AS {k}" for k, ws in WORDS_BY_TYPE.items()
) + " FROM documents)"


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("page_no", "text"))


def page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.page_starts(paged(spark, sf_dir)).select("doc_id", "page_no", F.col("start").cast("long").alias("start"))


PAGE_SQL = "SELECT doc_id, i - 1 AS page_no, coalesce(sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"


def clause_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = text.page_starts(paged(spark, sf_dir)).groupBy("doc_id").agg(F.array_sort(F.collect_list("start")).alias("starts"), F.sum(F.length("text") + 1).alias("n"))
    return pages.select("doc_id", text.page_of(F.col("starts"), (F.col("n") / 2).cast("int")).cast("long").alias("page"))


CLAUSE_PAGE_SQL = f"SELECT doc_id, count_if(start <= half) AS page FROM (SELECT *, CAST(floor(max(e) OVER (PARTITION BY doc_id) / 2) AS BIGINT) AS half FROM (SELECT p.doc_id, start, start + length(l) + 1 AS e FROM ({PAGE_SQL}) p JOIN (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page_no FROM documents) q ON p.doc_id = q.doc_id AND p.page_no = q.page_no)) GROUP BY doc_id"


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return text.without_repeated_lines(lines, share=0.05).groupBy("doc_id").agg(F.count("*").alias("kept"))


REPEATED_SQL = "WITH l AS (SELECT source AS doc_id, doc_id AS page_no, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT doc_id, trim(line, ' ') AS key, count(DISTINCT page_no) AS n FROM l WHERE trim(line, ' ') <> '' GROUP BY ALL), p AS (SELECT doc_id, count(DISTINCT page_no) AS pages FROM l GROUP BY doc_id), o AS (SELECT k.doc_id, key FROM k JOIN p USING (doc_id) WHERE pages >= 3 AND n >= greatest(3, floor(pages * 0.05 + 0.5)) AND length(key) <= 100) SELECT doc_id, count(*) AS kept FROM l WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = l.doc_id AND o.key = trim(l.line, ' ')) GROUP BY doc_id"


def wording_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy(F.md5(text.signature(F.col("text"))).alias("signature")).agg(F.count("*").alias("n"))


SIGNATURE_SQL = r"SELECT md5(trim(regexp_replace(lower(regexp_replace(text, '\d+([.,]\d+)?', '#', 'g')), '\s+', ' ', 'g'), ' ')) AS signature, count(*) AS n FROM conversations GROUP BY 1"


def wording_signature_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.md5(text.signature(F.col("text"))).alias("signature")).agg(F.count("*").alias("n"))


# --- masks, cache, JSON ----------------------------------------------


def pii_redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (turn is null) and conversations."""
    t, n = extraction.redacted(F.col("text"))
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), "doc_id", F.lit(None).cast("long").alias("turn"), "text")
    turns = table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("origin"), F.col("conv_id").alias("doc_id"), F.col("turn").cast("long").alias("turn"), "text")
    return docs.unionByName(turns).select("origin", "doc_id", "turn", n.cast("long").alias("masked"), F.length(t).cast("long").alias("chars"))


def cache_hit_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("key", extraction.cache_key(F.lit("m"), F.lit("v1"), F.col("role"), F.col("text")))
    kept = c.where("conv_id % 2 = 0").select("key").distinct().withColumn("hit", F.lit(True))
    return c.join(kept, "key", "left").groupBy("role", F.coalesce("hit", F.lit(False)).alias("hit")).agg(F.count("*").alias("calls"), F.count_distinct("key").alias("keys"))


CACHE_SQL = "WITH c AS (SELECT *, sha256('m' || chr(0) || 'v1' || chr(0) || role || chr(0) || text || chr(0)) AS key FROM conversations), k AS (SELECT DISTINCT key FROM c WHERE conv_id % 2 = 0) SELECT role, k.key IS NOT NULL AS hit, count(*) AS calls, count(DISTINCT c.key) AS keys FROM c LEFT JOIN k ON c.key = k.key GROUP BY ALL"


def json_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.lit("Here it is:\n```json\n"), F.coalesce("props", F.lit("{}")), F.lit("\n```\ndone"))
    return table(spark, sf_dir, "events").select("event_id", F.md5(extraction.recovered(reply)).alias("h"))


JSON_SQL = "SELECT event_id, md5(coalesce(props, '{}')) AS h FROM events"


# --- similarity --------------------------------------------------------------


def shingle_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    c = b.select((F.col("id") + 1000).alias("id"), F.concat("text", F.lit(" x1")).alias("text"))
    return retrieval.similar_texts(b, c, 0.8).select("left_id", "right_id", F.round("similarity", 6).alias("similarity"))


JACCARD_SQL = "WITH b AS (SELECT item_id AS id, text FROM benchmark), a AS (SELECT id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM b UNION ALL SELECT id + 1000, trim(regexp_replace(lower(text || ' x1'), '\\s+', ' ', 'g')) FROM b), s AS (SELECT id, list_distinct(list_transform(generate_series(1, greatest(length(t) - 4, 1)), lambda i: substring(t, i, 5))) AS s FROM a), p AS (SELECT l.id AS left_id, r.id AS right_id, len(list_intersect(l.s, r.s)) AS k, len(l.s) AS n, len(r.s) AS m FROM s l JOIN s r ON l.id < 1000 AND r.id >= 1000) SELECT left_id, right_id, round(k / CAST(n + m - k AS DOUBLE), 6) AS similarity FROM p WHERE k / CAST(n + m - k AS DOUBLE) >= 0.8"


def exact_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    def key(c):
        return F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))

    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    quotes = table(spark, sf_dir, "benchmark").select(key("text").alias("k")).distinct()
    return docs.select("doc_id", key("line").alias("k")).join(quotes, "k", "left_semi").groupBy("doc_id").agg(F.count("*").alias("lines"))


LEAK_SQL = "SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE lower(regexp_replace(trim(l, ' '), '\\s+', ' ', 'g')) IN (SELECT lower(regexp_replace(trim(text, ' '), '\\s+', ' ', 'g')) FROM benchmark) GROUP BY doc_id"


def knn(spark: SparkSession, sf_dir: str, same: bool) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")
    r = e.select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("vector"), "label")
    out = retrieval.nearest(q, r, 5, ["label"]) if same else retrieval.nearest(q.drop("label"), r.drop("label"), 5)
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "ref_id", F.round("score", 5).alias("score"))


def knn_sql(same: bool) -> str:
    return f"SELECT query_id, rank, ref_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id) AS rank FROM (SELECT q.vec_id AS query_id, r.vec_id AS ref_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS score FROM embeddings q JOIN embeddings r ON q.vec_id % 100 = 0 {'AND q.label = r.label' if same else ''})) WHERE rank <= 5"


def coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    wanted = d.select("lang").distinct().join(d.select("source").distinct(), F.lit(True))
    return retrieval.coverage_gaps(d.where("n_chars > 9000"), wanted, ["lang", "source"])


GAP_SQL = "SELECT lang, source FROM (SELECT DISTINCT lang FROM documents), (SELECT DISTINCT source FROM documents) EXCEPT SELECT lang, source FROM documents WHERE n_chars > 9000"


def balance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.balance(table(spark, sf_dir, "documents"), ["source"], "lang", ["de", "en", "es", "fr"])


BALANCE_SQL = "SELECT source, " + ", ".join(f"count_if(lang = '{x}') AS {x}" for x in ("de", "en", "es", "fr")) + " FROM documents GROUP BY source"


# --- measures ----------------------------------------------------------------


def gold_and_predicted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labels as gold, a rule on the text as prediction."""
    d = table(spark, sf_dir, "documents")
    gold = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    predicted = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").where(F.col("text").rlike(r"\*\*\*|\| |!!")).select("doc_id")
    return gold, predicted


PREDICTED_SQL = "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE regexp_matches(text, '\\*\\*\\*|\\| |!!')"
OUTCOME_SQL = f"SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, CAST(g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL AS INT) AS tp, CAST(g.doc_id IS NULL AS INT) AS fp, CAST(p.doc_id IS NULL AS INT) AS fn FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 0) g FULL JOIN (SELECT DISTINCT doc_id FROM ({PREDICTED_SQL})) p ON g.doc_id = p.doc_id"
PRF_SQL = "tp / nullif(CAST(tp + fp AS DOUBLE), 0) AS precision, tp / nullif(CAST(tp + fn AS DOUBLE), 0) AS recall, CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) WHEN tp + fp + fn > 0 THEN 0.0 END AS f1"


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def prf_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measures.scored(measures.outcomes(*gold_and_predicted(spark, sf_dir), ["doc_id"])))


def prf_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = measures.outcomes(*gold_and_predicted(spark, sf_dir), ["doc_id"]).join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return rounded(measures.scored(counts, ["lang", "source"]))


def slices_sql() -> str:
    sums = "CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn"
    j = f"(SELECT * FROM ({OUTCOME_SQL}) JOIN documents USING (doc_id))"
    parts = [f"SELECT 'all' AS slice, 'all' AS value, {sums} FROM {j}", *[f"SELECT '{c}', {c}, {sums} FROM {j} GROUP BY {c}" for c in ("lang", "source")]]
    return f"SELECT slice, value, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM (SELECT *, {PRF_SQL} FROM ({' UNION ALL '.join(parts)}))"


def clean_false_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, predicted = gold_and_predicted(spark, sf_dir)
    return measures.clean_false_alarms(table(spark, sf_dir, "labels"), gold, predicted)


ALARM_SQL = f"SELECT count(*) AS clean_docs, count(p.doc_id) AS false_alarms FROM (SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)) c LEFT JOIN ({PREDICTED_SQL}) p ON c.doc_id = p.doc_id"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (F.pmod(F.col("n_chars"), F.lit(997)) / 1000.0).alias("score"))
    return d.join(table(spark, sf_dir, "labels"), "doc_id").select("score", F.col("quality").alias("label"))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measures.best_threshold(scores(spark, sf_dir), 0.5))


SWEEP_SQL = f"WITH t AS (SELECT (n_chars % 997) / 1000.0 AS t, sum(quality) AS pos, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), r AS (SELECT t, sum(pos) OVER (ORDER BY t DESC) AS tp, sum(n) OVER (ORDER BY t DESC) AS n, sum(pos) OVER () AS a FROM t), m AS (SELECT t, {PRF_SQL} FROM (SELECT t, tp, n - tp AS fp, a - tp AS fn FROM r)) SELECT round(CAST(t AS DOUBLE), 6) AS threshold, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall FROM m WHERE precision >= 0.5 ORDER BY m.f1 DESC, t LIMIT 1"


def drawn(r: str, j: str, n: str) -> str:
    """SQL of both engines for the document that place j of resample r draws, with replacement: squares of a remainder, so each draw is alike but not in step with another."""
    square = f"(({r} * 104729 + {j} * 7919 + 13) % 2147483647)"
    for add in (f"{r} * 48271", f"{j} * 69621", f"{r} * 16807"):
        square = f"(({square} * {square} + {add} + 40692) % 2147483647)"
    return f"({square} % {n})"


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1000 resamples of the labelled documents, those without any finding among them."""
    found = measures.outcomes(*gold_and_predicted(spark, sf_dir), ["doc_id"])
    counts = table(spark, sf_dir, "labels").select("doc_id").distinct().join(found, "doc_id", "left").na.fill(0, ["tp", "fp", "fn"])
    pos = counts.withColumn("pos", F.row_number().over(Window.orderBy("doc_id")).cast("long") - 1).select("pos", "tp", "fp", "fn")
    n = counts.count()
    draws = spark.range(1000 * n).selectExpr(f"id div {max(n, 1)} AS resample", f"id % {max(n, 1)} AS j").selectExpr("resample", f"{drawn('resample', 'j', str(max(n, 1)))} AS pos")
    return measures.interval(pos, draws)


def bootstrap_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bounds by Poisson counts: one pass over the documents, nothing numbered or joined a thousand times."""
    found = measures.outcomes(*gold_and_predicted(spark, sf_dir), ["doc_id"])
    counts = table(spark, sf_dir, "labels").select("doc_id").distinct().join(found, "doc_id", "left")
    return measures.poisson_interval(counts)


BOOTSTRAP_SQL = (
    f"WITH c AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM (SELECT DISTINCT doc_id FROM labels) LEFT JOIN ({OUTCOME_SQL}) USING (doc_id)), "
    f"d AS (SELECT r, {drawn('r', 'j', 'n')} AS pos FROM (SELECT r, pos AS j, (SELECT count(*) FROM c) AS n FROM range(1000) t(r), c)), "
    "s AS (SELECT r, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM d JOIN c USING (pos) GROUP BY r), "
    "m AS (SELECT tp / nullif(CAST(tp + fp AS DOUBLE), 0) AS precision, tp / nullif(CAST(tp + fn AS DOUBLE), 0) AS recall FROM s), "
    "f AS (SELECT *, CASE WHEN precision > 0 AND recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m) "
    "SELECT " + ", ".join(f"round_even(quantile_cont({m}, {q}), 4) AS {m}_{name}" for m in ("precision", "recall", "f1") for q, name in ((0.025, "low"), (0.975, "high"))) + " FROM f"
)


def latest_run_per_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return e.withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "event_id", "event_type")


LATEST_SQL = "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def highlight_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 10).cast("int").alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity") % 15 + 1).cast("int").alias("end"))
    per = s.groupBy("l_orderkey").agg(findings.merged_spans(F.collect_list(F.struct("start", "end"))).alias("m"))
    return per.select("l_orderkey", F.size("m").cast("long").alias("marks"), F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("chars"))


HIGHLIGHT_SQL = "WITH s AS (SELECT l_orderkey, l_linenumber * 10 AS a, CAST(l_linenumber * 10 + CAST(l_quantity AS INT) % 15 + 1 AS INT) AS b FROM lineitem), p AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s), i AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM p), m AS (SELECT l_orderkey, g, min(a) AS a, max(b) AS b FROM i GROUP BY ALL) SELECT l_orderkey, count(*) AS marks, sum(b - a) AS chars FROM m GROUP BY l_orderkey"


def corpus_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").agg(F.array_sort(F.collect_list(F.struct("item_id", "text"))).alias("x"))  # a curated table of some hundred rows
    return b.select(F.substring(F.sha2(F.array_join(F.transform("x", lambda r: F.concat(r["item_id"].cast("string"), F.lit(":"), r["text"])), "\n"), 256), 1, 16).alias("hash"))


HASH_SQL = "SELECT substring(sha256(string_agg(item_id || ':' || text, chr(10) ORDER BY item_id)), 1, 16) AS hash FROM benchmark"


def extraction_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold: an order's priority and price; prediction: null, changed or right by the order's key."""
    k = F.col("o_orderkey") % 5
    o = table(spark, sf_dir, "orders").select(F.when(k != 3, F.col("o_orderpriority")).alias("g"), F.when(k != 1, F.when(k == 2, "X").otherwise(F.upper("o_orderpriority"))).alias("p"), (k == 4).alias("failed"))
    return o.groupBy(extraction.outcome(F.col("g"), F.col("p"), F.col("failed")).alias("outcome")).agg(F.count("*").alias("n"))


COMPARE_SQL = "SELECT CASE o_orderkey % 5 WHEN 4 THEN 'failed' WHEN 3 THEN 'hallucinated' WHEN 1 THEN 'missed' WHEN 2 THEN 'wrong' ELSE 'correct' END AS outcome, count(*) AS n FROM orders GROUP BY 1"


def cost_per_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("kind"), (F.col("o_orderkey") % 3).cast("string"), F.lit(":m")).alias("model"), F.length("o_orderpriority").alias("input"), F.lit(10).alias("output"))
    prices = spark.createDataFrame([("kind0:m", 1.0, 2.0), ("kind1:*", 3.0, 4.0), ("kind2:m", None, None), ("kind2:*", 9.0, 9.0)], "model string, in_price double, out_price double")
    return extraction.cost_per_100(o, prices)


COST_SQL = "SELECT 'kind' || (o_orderkey % 3) || ':m' AS model, round(100 * (avg(length(o_orderpriority)) * CASE any_value(o_orderkey % 3) WHEN 0 THEN 1.0 WHEN 1 THEN 3.0 END + 10 * CASE any_value(o_orderkey % 3) WHEN 0 THEN 2.0 WHEN 1 THEN 4.0 END) / 1e6, 6) AS cost_per_100 FROM orders GROUP BY 1"


def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*[F.round(F.percentile("value", q), 6).alias(n) for q, n in ((0.5, "p50"), (0.95, "p95"))])


LATENCY_SQL = "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type"


def html_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.sources import report

    docs = contracts(spark, sf_dir)
    clauses = learning.kept(spark)(segment.clauses_by_form(docs))  # asked for several times
    found = findings.ordered(findings.findings(clauses, requests(docs)))
    return report.html(found, clauses)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {f.__name__: f for f in PLAIN}
    out |= {"rule_" + r.replace(".", "_"): partial(rule, rule_id=r) for r in factory.WORDINGS}
    out["html_report"] = html_report
    out |= {name: query for name, (query, _) in more().items()}
    return out | {"knn_topk": partial(knn, same=False), "knn_filtered": partial(knn, same=True), "penalty_flagship": flagship}


def more() -> dict[str, tuple]:
    """Queries of other modules: name -> (query, its SQL or None)."""
    return shapes.QUERIES | learning.QUERIES | screening.queries() | fields.QUERIES | papers.QUERIES | drafts.QUERIES | indexed.queries() | runs.QUERIES


PLAIN = (
    percent_spans, percent_spans_all, duration_days, party_payers, segment_contracts, doc_force_majeure_missing, doc_liability_one_sided, report_order, normalize_lines, letter_share_language, type_scores, page_offsets, clause_page, repeated_lines,
    wording_signature, wording_signature_documents, pii_redaction_counts, cache_hit_miss, json_recover, shingle_jaccard, exact_leak, coverage_gap, balance_table, prf_detection, prf_slices, clean_false_alarms, threshold_sweep, bootstrap_ci, bootstrap_one_pass, latest_run_per_model,
    highlight_merge, corpus_hash, extraction_compare, cost_per_100, latency_quantiles,
)


def oracle_sql() -> dict[str, str]:
    prf_sql = f"SELECT tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM (SELECT *, {PRF_SQL} FROM (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM ({OUTCOME_SQL})))"
    return {
        "percent_spans": PERCENT_SQL, "percent_spans_all": percent_all_sql(), "duration_days": DURATION_SQL, "party_payers": PAYERS_SQL, "segment_contracts": SEGMENT_SQL, "doc_force_majeure_missing": FM_SQL, "doc_liability_one_sided": ONE_SIDED_SQL, "report_order": ORDER_SQL,
        "normalize_lines": NORMALIZE_SQL, "letter_share_language": SHARE_SQL, "type_scores": TYPE_SQL, "page_offsets": PAGE_SQL, "clause_page": CLAUSE_PAGE_SQL, "repeated_lines": REPEATED_SQL, "wording_signature": SIGNATURE_SQL, "wording_signature_documents": SIGNATURE_SQL.replace("FROM conversations", "FROM documents"),
        "cache_hit_miss": CACHE_SQL, "json_recover": JSON_SQL, "shingle_jaccard": JACCARD_SQL, "exact_leak": LEAK_SQL, "knn_topk": knn_sql(False), "knn_filtered": knn_sql(True), "coverage_gap": GAP_SQL, "balance_table": BALANCE_SQL,
        "prf_detection": prf_sql, "prf_slices": slices_sql(), "clean_false_alarms": ALARM_SQL, "threshold_sweep": SWEEP_SQL, "bootstrap_ci": BOOTSTRAP_SQL, "latest_run_per_model": LATEST_SQL, "highlight_merge": HIGHLIGHT_SQL, "corpus_hash": HASH_SQL,
        "extraction_compare": COMPARE_SQL, "cost_per_100": COST_SQL, "latency_quantiles": LATENCY_SQL, "penalty_flagship": FLAGSHIP_SQL,
        **{"rule_" + r.replace(".", "_"): factory.expected_sql(r) for r in factory.WORDINGS},
        **{name: sql for name, (_, sql) in more().items() if sql is not None},
    }


__all__ = ["TYPE_OF", "flagship", "lookup", "oracle_sql", "queries"]
