"""Replies of a model: what is wrong with each, and what is asked again."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from clausewise.operators import extraction
from clausewise.plans import fields
from clausewise.plans.learning import kept


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(fields.REPLIES)], "id int, reply string")
    return {r["id"]: r for r in extraction.checked(rows).collect()}


@pytest.mark.parametrize("i", range(len(fields.REPLIES)))
def test_faults(found, i):
    assert "; ".join(found[i]["faults"]) == fields.REPLIES[i][1]


def test_records_are_typed(found):
    r = found[0]["record"]
    assert (r["term_months"], r["auto_renewal"], r["price_amount"], str(r["contract_date"])) == (12, False, 1000.5, "2024-03-01")
    assert [p["role"] for p in r["parties"]] == ["landlord", "tenant"] and r["parties"][1]["bin"] is None
    lenient = found[3]["record"]
    assert (lenient["term_months"], lenient["auto_renewal"], lenient["price_amount"], lenient["payment_deadline_days"]) == (24, True, 7.0, 10)


def test_edges(spark):
    twice = fields.patched()[:-1] + ', "city": "Астана"}'
    many = fields.patched(**{f"k{i}": 1 for i in range(20)})
    rows = spark.createDataFrame([(0, None), (1, ""), (2, twice), (3, many), (4, "[1, 2]"), (5, fields.patched(term_months=True)), (6, fields.patched(term_months=10**12))], "faults int, reply string").withColumnRenamed("faults", "id")
    got = {r["id"]: r["faults"] for r in extraction.checked(rows).collect()}
    assert got[0] == got[1] == got[2] == got[4] == ["json"]
    assert len(got[3]) == extraction.MOST_FAULTS and got[3][0] == "k0: unknown"
    assert got[5] == [] and got[6] == ["term_months: not a int"]


def test_only_broken_replies_are_asked_again(spark):
    asked = spark.sparkContext.accumulator(0)

    def model(prompt: str) -> str:
        asked.add(1)
        if prompt.startswith("down"):
            raise ConnectionError("no")
        if prompt.startswith("bad") and "\n" not in prompt:
            return fields.patched(contract_date="1999-01-01")
        if prompt.startswith("hopeless"):
            return "no json"
        assert not prompt.startswith("bad") or "contract_date: out of years" in prompt
        return fields.patched()

    texts = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "hopeless"), (4, "down")], "doc_id long, prompt string")
    out = {r["doc_id"]: r for r in extraction.extract(texts, extraction.Mock(model), kept(spark)).collect()}
    assert {k: (r["status"], r["attempts"]) for k, r in out.items()} == {1: ("ok_first_try", 1), 2: ("ok_after_retry", 2), 3: ("failed", 2), 4: ("backend_error", 1)}
    assert asked.value == 6 and out[3]["record"] is None and out[2]["record"]["city"] == "Алматы"
    json.dumps(out[2]["record"].asDict(recursive=True), default=str)


def test_batch_totals_and_parties(spark):
    t = extraction.batch_totals(spark.createDataFrame([("ok_first_try", 10, 2), ("failed", 5, 1), ("ok_after_retry", None, 3)], "status string, input_tokens long, output_tokens long")).first()
    assert tuple(t) == (3, 2, 15, 6)
    said = extraction.disputed(spark.createDataFrame([(1, "city", "a", "wrong", "X"), (1, "city", "b", "correct", "Y"), (2, "city", "a", "correct", "Z")], "doc_id long, field string, model string, outcome string, value string"), ["a", "b"]).collect()
    assert len(said) == 1 and said[0]["said"][0]["value"] == "X"
    draft = spark.createDataFrame([(1, "Алматы", 3), (2, None, 4)], "doc_id long, city string, term int")
    fixed = extraction.overridden(draft, spark.createDataFrame([(1, "term", "12"), (2, "city", "Астана"), (1, "city", None)], "doc_id long, field string, value string"), ["city", "term"])
    assert sorted(map(tuple, fixed.collect())) == [(1, None, 12), (2, "Астана", 4)]
    known = extraction.oracle({"p": "{}"}, broken_every=1)
    assert known.complete("p") == "not json" and known.complete("p\nnot json") == "{}" and known.complete("other") == ""
    assert spark.range(1).select(extraction.folded(F.lit("«Ёж»  И"))).first()[0] == "'еж' и"
