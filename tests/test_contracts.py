"""Contract analysis: examples by rule and role, spans against `re`, numbering, measures worked out by hand."""

from __future__ import annotations

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewise.functions import numbers, text
from clausewise.operators import extraction, findings, measures, retrieval, rules, segment
from clausewise.plans import catalogue, factory
from clausewise.sources import files

EXAMPLES = [
    ("За просрочку Арендатор уплачивает Арендодателю пеню 1% за каждый день просрочки.", "lease", "ru", [("penalty.daily_rate", 3, ["tenant"])]),
    ("Арендатор уплачивает пеню 0,1% за каждый день, но не более 10% суммы долга.", "lease", "ru", []),
    ("Покупатель выплачивает штраф в размере 40% цены товара.", "supply", "ru", [("penalty.fine", 3, ["buyer"])]),
    ("Арендодатель не несет ответственности за любые убытки.", "lease", "ru", [("liability.exclusion", 3, ["tenant"])]),
    ("Споры рассматриваются в суде по месту нахождения Арендодателя.", "lease", "ru", [("jurisdiction.counterparty_location", 1, ["tenant"])]),
    ("Жалға алушы әрбір кешіктірілген күн үшін 1% өсімпұл төлейді.", "lease", "kk", [("penalty.daily_rate", 3, ["tenant"])]),
    ("Стороны исполняют обязательства добросовестно.", "works", "ru", []),
]


def test_rules(spark):
    frame = spark.createDataFrame([e[:3] for e in EXAMPLES], "text string, contract_type string, lang string")
    got = {r["text"]: [(h["rule_id"], h["level"], h["against"]) for h in r["hits"]] for r in rules.hits(frame, (rules.daily_rate, rules.single_fine, rules.exclusion, rules.jurisdiction)).collect()}
    assert got == {e[0]: e[3] for e in EXAMPLES}


def test_spans_are_those_of_re(spark):
    texts = ["пеня 1% и 2,5 процента, 3 %", "", "%", "10%10%", "Ставка 7 (семь) процентов"]
    got = {r["text"]: [(s["start"], s["end"]) for s in r["s"]] for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", text.spans(F.col("text"), numbers.PERCENT).alias("s")).collect()}
    assert got == {t: [m.span() for m in re.finditer(numbers.PERCENT, t, re.I)] for t in texts}


NUMBERINGS = [(None, (1,), True), (None, (4,), False), ((1,), (1, 1), True), ((1, 2), (1, 3), True), ((1, 2), (2,), True), ((1, 2), (2, 3), False), ((1, 2), (1, 1), False), ((3,), (6,), False), ((1, 2), (1, 2), False), ((1,), (1, 2, 1), False), ((1, 1), (1, 1, 1), True), ((1, 9), (3,), True), ((2,), (3, 1), True), ((2,), (1,), False)]


def test_numbering(spark):
    df = spark.createDataFrame([(i, None if a is None else list(a), list(b)) for i, (a, b, _) in enumerate(NUMBERINGS)], "i int, last array<int>, new array<int>")
    got = {r["i"]: r["ok"] for r in df.select("i", segment.follows(F.col("last"), F.col("new")).alias("ok")).collect()}
    assert got == {i: ok for i, (_, _, ok) in enumerate(NUMBERINGS)}


def test_segments(spark):
    text = "ДОГОВОР АРЕНДЫ\n№ 15\nг. Алматы\n1. ПРЕДМЕТ\n1.1. Арендодатель передает\n15 (пятнадцать) помещений, см. п.\n5.3 акта.\n1.2. Срок:\n- год;\n2. РЕКВИЗИТЫ СТОРОН\nАрендатор"
    s = segment.segmented(spark.createDataFrame([(text,)], "text string")).first()
    assert s["__title"] == "ДОГОВОР АРЕНДЫ № 15"
    assert [(c["id"], c["kind"]) for c in s["__clauses"]] == [("preamble", "preamble"), ("1", "heading"), ("1.1", "clause"), ("1.2", "clause"), ("2", "requisites")]
    assert s["__clauses"][2]["text"] == "Арендодатель передает 15 (пятнадцать) помещений, см. п. 5.3 акта."


def test_measures(spark):
    gold = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "doc_id int, clause string")
    got = measures.scored(measures.outcomes(gold, spark.createDataFrame([(1, "a"), (1, None), (3, "c")], "doc_id int, clause string"), ["doc_id", "clause"])).first()
    assert (got["tp"], got["fp"], got["fn"]) == (2, 1, 1) and got["f1"] == pytest.approx(2 / 3)
    none = measures.scored(measures.outcomes(gold, gold.limit(0), ["doc_id", "clause"])).first()
    assert none["precision"] is None and none["recall"] == 0 and none["f1"] == 0


def against_sql(spark, sf_dir, name):
    got = catalogue.queries()[name](spark, sf_dir)
    with duckdb.connect() as db:
        for t in ("conversations", "documents", "lineitem"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = db.sql(f"SELECT {', '.join(got.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    return rows


def test_percent_spans_of_all_wordings(spark, sf_dir):
    rows = against_sql(spark, sf_dir, "percent_spans_all")
    assert {r[0] for r in rows} == set(range(7)) and sum(r[-2] for r in rows) > 0
    assert sum(r[-1] for r in rows) == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()


def test_a_clause_for_each_line(spark, sf_dir):
    assert factory.clauses(spark, sf_dir, "penalty.fine").count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    for name in ("percent_spans", "duration_days", "party_payers", "rule_penalty_daily_rate"):
        against_sql(spark, sf_dir, name)


def test_masks_and_signatures_of_whole_tables(spark, sf_dir):
    rows = against_sql(spark, sf_dir, "wording_signature_documents")
    docs, turns = (spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("documents", "conversations"))
    assert sum(r[1] for r in rows) == docs
    masked = catalogue.pii_redaction_counts(spark, sf_dir).groupBy("origin").count()
    assert {r["origin"]: r["count"] for r in masked.collect()} == {"documents": docs, "conversations": turns}


def test_bootstrap(spark, sf_dir):
    """Bounds as by SQL, near those of the reference's formula on NumPy's draws, and apart."""
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    got = catalogue.bootstrap_ci(spark, sf_dir).first().asDict()
    with duckdb.connect() as db:
        for t in ("documents", "labels"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = db.sql(catalogue.oracle_sql()["bootstrap_ci"])
        assert got == pytest.approx(dict(zip(want.columns, want.fetchall()[0], strict=True)))
        counts = np.array(db.sql(f"SELECT coalesce(tp, 0), coalesce(fp, 0), coalesce(fn, 0) FROM labels LEFT JOIN ({catalogue.OUTCOME_SQL}) USING (doc_id) ORDER BY doc_id").fetchall())
    tp, fp, fn = counts[measures.resamples(len(counts))].sum(axis=1).T
    for name, of in (("precision", tp + fp), ("recall", tp + fn)):
        low, high = np.quantile(tp[of > 0] / of[of > 0], [0.025, 0.975])
        assert got[f"{name}_low"] == pytest.approx(low, abs=0.03) and got[f"{name}_high"] == pytest.approx(high, abs=0.03)
    assert 0 < got["recall_low"] < got["recall_high"] and 0 < got["f1_low"] < got["f1_high"]
    frame = spark.createDataFrame([(i, *map(int, c)) for i, c in enumerate(counts)], "pos long, tp int, fp int, fn int")
    draws = spark.createDataFrame([(r, int(i)) for r, row in enumerate(measures.resamples(len(counts), 50)) for i in row], "resample long, pos long")
    tp, fp, fn = counts[measures.resamples(len(counts), 50)].sum(axis=1).T
    assert measures.interval(frame, draws).first()["precision_low"] == pytest.approx(np.quantile(tp / (tp + fp), 0.025), abs=6e-5)


def test_similar_texts_and_json(spark):
    a = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "nothing alike")], "id int, text string")
    assert [tuple(r)[:2] for r in retrieval.similar_texts(a, a.selectExpr("id + 10 as id", "text")).collect()] in ([(1, 11), (2, 12)], [(2, 12), (1, 11)])
    replies = ['```json\n{"a": 1}\n```', "no object", 'text {"a": {"b": 2}} more']
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(replies)], "i int, t string").orderBy("i").select(extraction.recovered(F.col("t"))).collect()]
    assert got == ['{"a": 1}', None, '{"a": {"b": 2}}']


def test_files():
    assert files.plain("Договор".encode("cp1251")) == ("Договор", ["not UTF-8: read as cp1251"])
    assert files.load(b"x", "docx")[0] is None and files.load(b"x", None) == (None, None, ["unsupported format"])


def test_lines_of_equal_words_are_worked_out_once(spark, sf_dir, monkeypatch):
    given, real = [], catalogue.rules.hits
    monkeypatch.setattr(catalogue.rules, "hits", lambda made, chosen: given.append(made) or real(made, chosen))
    catalogue.rule(spark, sf_dir, "payment.deferral")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert given[0].count() == given[0].select("v", "n", "p", "text").distinct().count() < lines
    assert given[0].agg({"lines": "sum"}).first()[0] == lines


def test_clauses_of_equal_words_are_worked_out_once(spark, monkeypatch):
    given, real = [], rules.hits
    monkeypatch.setattr(findings.rules, "hits", lambda made, chosen: given.append(made) or real(made, chosen))
    said, none = EXAMPLES[0][0], "За просрочку пеня не уплачивается."
    made = [(d, str(i), i, t, lang, "clause") for d in range(20) for i, (t, lang) in enumerate([(said, "ru"), (none, "ru"), (said, None)])]
    clauses = spark.createDataFrame(made, "doc_id long, clause_id string, clause_ord int, text string, lang string, kind string")
    asked = spark.createDataFrame([(d, r) for d in range(20) for r in ("tenant", "landlord", "nobody")], "doc_id long, party_role string")
    got = findings.of_clauses(clauses, asked, (rules.daily_rate,)).where("clause_id = '0'").select("doc_id", "party_role", "clause_ord", "level", F.col("evidence")[0]["quote"]).collect()
    assert sorted(map(tuple, got)) == [(d, "tenant", 0, 3, "1%") for d in range(20)]
    assert given[0].count() == 3


def test_equal_contracts_are_segmented_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, None if i == 9 else f"ДОГОВОР\n1. Предмет\n1.1. Раз {i % 2}.\n") for i in range(10)], "doc_id long, text string")
    whole = {c: sorted(map(str, getattr(segment, f)(docs).select(c).collect())) for f, c in (("clauses", "text"), ("clauses", "doc_id"))}
    spoken = sorted(map(str, segment.document_language(segment.clauses(docs)).collect()))
    given, real = [], segment.clauses
    monkeypatch.setattr(segment, "clauses", lambda d: given.append(d) or real(d))
    assert {c: sorted(map(str, segment.clauses_once(docs).select(c).collect())) for c in whole} == whole
    assert sorted(map(str, segment.languages_once(docs).collect())) == spoken
    assert [d.count() for d in given] == [3, 3, 3]


def test_contracts_of_one_form_are_segmented_once(spark, monkeypatch):
    """Numbers that nobody reads don't make another form; all that is read does."""
    body = "ДОГОВОР № {a}\nг. Алматы, {a} мая\n1. Предмет\n1.1. Арендатор уплачивает Арендодателю {a}0% за каждый день, всего {b} раз.\n2. Цена {b}\nПриложение № 1 к договору {b}, которое составлено сторонами в двух экземплярах.\n1. Спецификация {a}.\n"
    texts = [body.format(a=i % 5 + 1, b=i // 10 + 1) for i in range(20)] + [body.format(a=12, b=1), "", None]
    texts += [body.format(a=3, b=1).replace("1.1.", n) for n in ("1.2.", "1.5.", "п. 1.1.")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = lambda d: sorted(map(str, d.collect()))
    whole, read = own(segment.clauses(docs)), own(segment.segmented(docs).drop("text"))
    given, real = [], segment.segmented
    monkeypatch.setattr(segment, "segmented", lambda d: given.append(d) or real(d))
    assert own(segment.clauses_by_form(docs)) == whole
    clauses = F.transform("__clauses", lambda c: c.dropFields("lang"))
    assert own(segment.segmented_by_form(docs).select("doc_id", "__title", clauses.alias("__clauses"), "__warnings")) == read
    one = [f"ДОГОВОР № {i}\n1. Предмет\n1.1. Арендатор уплачивает Арендодателю {i + 3}% за каждый день просрочки.\n" for i in range(10, 30)]
    segment.clauses_by_form(spark.createDataFrame(list(enumerate(one)), "doc_id long, text string"))
    assert given[-1].count() == 1
