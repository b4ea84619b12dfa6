"""Gold records, prices, runs, excerpts, samples, intervals of one pass, routing: small cases with values."""

from __future__ import annotations

import json

import numpy as np
import pytest

from clausewise.operators import analyzer, learned, measures, retrieval
from clausewise.plans import catalogue
from clausewise.sources import corpus, files


def test_one_pass_intervals(spark, sf_dir):
    """Near bounds by whole draws; the same however rows are dealt; undefined ones are null."""
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    got, want = (q(spark, sf_dir).first().asDict() for q in (catalogue.bootstrap_one_pass, catalogue.bootstrap_ci))
    assert list(got) == list(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=0.03)
    rng = np.random.default_rng(3)
    rows = [tuple(map(int, r)) for r in rng.integers(0, 3, (300, 3))] + [(None, 1, 0)]
    c = spark.createDataFrame(rows, "tp int, fp int, fn int")
    one, other = (measures.poisson_interval(d, times=400).first() for d in (c.coalesce(1), c.repartition(7)))
    assert one == other
    counts = np.array([[x or 0 for x in r] for r in rows])
    tp, fp, _ = counts[measures.resamples(len(counts), 4000)].sum(axis=1).T
    for q, name in ((0.025, "low"), (0.975, "high")):
        assert one[f"precision_{name}"] == pytest.approx(np.quantile(tp / (tp + fp), q), abs=0.01)
    none = measures.poisson_interval(c.limit(0)).first()
    assert none["precision_low"] is None and none["f1_low"] in (None, 0.0)
    sums = measures.resampled(c.limit(0), ["tp"], times=3).collect()
    assert all(r["n"] == 0 and r["tp"] == 0 for r in sums)
    # sums of m equal rows have the mean and the variance of m single draws
    equal = measures.resampled(spark.createDataFrame([(2.0,)] * 50, "v double"), ["v"], times=3000).toPandas()["v"]
    assert equal.mean() == pytest.approx(100, abs=1.5) and equal.var() == pytest.approx(200, rel=0.15)


def test_gold_prices_and_runs(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Договор № 1", encoding="utf-8")
    (tmp_path / "gold.jsonl").write_text("\n".join(json.dumps({"doc_id": d, "path": f"x/{s}.txt", "labels": {"city": c}}) for d, s, c in (("1", "a", "Алматы"), ("2", "absent", None))), encoding="utf-8")
    got = corpus.load_gold(spark, str(tmp_path / "gold.jsonl"), str(tmp_path / "*.txt"), "city string").collect()
    assert [(r["doc_id"], r["labels"]["city"], r["text"]) for r in got] == [("1", "Алматы", "Договор № 1")]
    (tmp_path / "prices.yaml").write_text("models:\n  small: {input: 0.1, output: 0.4}\n  local:*: {input: null, output: 0}\n  note: free\n", encoding="utf-8")
    prices = {r["model"]: (r["in_price"], r["out_price"]) for r in corpus.load_pricing(spark, str(tmp_path / "prices.yaml")).collect()}
    assert prices == {"small": (0.1, 0.4), "local:*": (None, 0.0)}
    run = spark.createDataFrame([("r2", "m", "dev", "v1", "abc", 4, (0.5,))], "run_id string, model string, split string, prompt_version string, git_commit string, workers int, metrics struct<f1:double>")
    errors = spark.createDataFrame([("d1", "fn")], "doc_id string, kind string")
    for _ in range(2):
        corpus.write_run(run, errors, str(tmp_path / "out"))
    back = corpus.load_runs(spark, str(tmp_path / "out" / "run"), "f1 double").collect()
    assert [(r["run_id"], r["metrics"]["f1"], r["workers"]) for r in back] == [("r2", 0.5, 4)]
    assert spark.read.json(str(tmp_path / "out" / "errors")).count() == 1
    table = corpus.markdown(spark.createDataFrame([("a|b", None), ("c", 2)], "name string, n int"))
    assert table == "| name | n |\n| - | - |\n| a\\|b |  |\n| c | 2 |"


def test_excerpts_lines_and_samples(spark):
    errors = spark.createDataFrame([("1", "fp", "x" * 300), ("3", "fn", "коротко"), ("2", "fn", "y" * 220)], "doc_id string, kind string, text string")
    got = [(r["kind"], r["doc_id"], r["n"], r["excerpt"]) for r in corpus.error_excerpts(errors).collect()]
    assert got == [("fn", "2", 2, "y" * 220), ("fn", "3", 2, "коротко"), ("fp", "1", 1, "x" * 219 + "…")]
    lines = spark.createDataFrame([("Оплата в\nтечение дня.\nНовая строка\n\n 2. Пункт ",), (None,), ("",)], "text string")
    assert [r[0] for r in lines.select(corpus.unwrapped(lines["text"])).collect()] == ["Оплата в течение дня.\nНовая строка\n2. Пункт", None, ""]
    rows = spark.createDataFrame([(g, i) for g, n in (("a", 30), ("b", 2), (None, 4)) for i in range(n)], "g string, i int")
    one, other = (sorted(map(tuple, corpus.sampled(d, "g", 3).collect()), key=str) for d in (rows.coalesce(1), rows.repartition(5)))
    assert one == other and [sum(r[0] == g for r in one) for g in ("a", "b", None)] == [3, 2, 3]
    assert one != sorted(map(tuple, corpus.sampled(rows, "g", 3, seed=8).collect()), key=str)


def test_coverage_routing_and_filters(spark):
    gold = spark.createDataFrame([("d", "1.1"), ("d", "1.1"), ("d", "9"), ("d", None)], "doc_id string, clause string")
    clauses = spark.createDataFrame([("d", "1.1"), ("d", "2")], "doc_id string, clause_id string")
    assert tuple(measures.coverage(gold, clauses).first()) == (1, 2)
    route = spark.createDataFrame([("1", True), ("2", False), ("3", True)], "clause_id string, routed boolean")
    assert tuple(learned.routing_counts(route).first()) == (3, 2) and tuple(learned.routing_counts(route.limit(0)).first()) == (0, 0)
    refs = spark.createDataFrame([(1, "ru", "lease"), (2, "kk", "lease"), (3, None, "supply")], "id int, lang string, type string")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(retrieval.matching(refs)) == ids(retrieval.matching(refs, lang=None)) == [1, 2, 3]
    assert ids(retrieval.matching(refs, lang="ru", type="lease")) == [1] and ids(retrieval.matching(refs, lang="ru", type="supply")) == []
    roles = spark.createDataFrame([("lease",), ("supply",), ("works",), ("loan",)], "t string")
    assert [r[0] for r in roles.select(analyzer.default_role(roles["t"])).collect()] == ["tenant", "buyer", "customer", None]
    found = spark.createDataFrame([("d", 1, 3), ("d", 2, 3), ("d", 3, 3), ("d", 4, 3), ("e", 1, 2)], "doc_id string, finding_ord int, level int")
    assert sorted((r["doc_id"], r["finding_ord"]) for r in analyzer.top(found).collect()) == [("d", 1), ("d", 2), ("d", 3)]


def test_pages_and_plain_texts(spark):
    class Split:
        """Pages divided by form feeds; a class of the function's own, so workers get it whole."""

        name = "split"

        def pages(self, data: bytes, kind: str) -> list[str]:
            return data.decode().split("\f") if data else []

    rows = spark.createDataFrame([("a", "pdf", b"one\ftwo"), ("b", "image", b"")], "doc_id string, source_format string, content binary")
    assert sorted(map(tuple, files.paged(rows, Split()).collect()), key=str) == [("a", 0, "one"), ("a", 1, "two"), ("b", None, None)]
    got = files.parse_text(spark.createDataFrame([("a", "Догово́р  аренды\r\n\r\n\r\n\r\nконец")], "doc_id string, text string")).first()
    assert got["source_format"] == "txt" and got["warnings"] == [] and got["text"].endswith("\n\nконец\n")
