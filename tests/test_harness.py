from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from clausewise.operators import harness
from clausewise.operators.harness import Detector, Runs

DOCS = "doc_id string, contract_type string, language string, origin string"
FOUND = "doc_id string, clause string, category string, level int"
CLAUSES = "doc_id string, clause_id string, text string, lang string, kind string, clause_ord int, section_title string"
KEYS = ("detection", "strict", "document", "high", "level", "clean", "coverage")


def made(seed):
    """Documents, gold, predictions (some of them twice, some of unknown documents) and clauses."""
    rng = random.Random(seed)
    docs = [(f"d{i}", rng.choice(["lease", "works"]), rng.choice(["ru", "kk"]), rng.choice(["a", None])) for i in range(12)]

    def some(n, ids):
        return [(rng.choice(ids), rng.choice(["1.1", "1.2", "1.10", None]), rng.choice(["penalty", "payment"]), rng.randint(1, 3)) for _ in range(n)]

    ids = [d[0] for d in docs]
    gold = some(14, ids[:7])
    predicted = some(25, [*ids[:10], "unknown"]) + gold[:4]
    clauses = [(d, c, f"text of {c}", "ru", "clause", i, None) for d in ids for i, c in enumerate(["1.1", "1.2"])]
    return docs, gold, predicted, clauses


def brute(docs, gold, predicted, clauses):
    """measure -> (tp, fp, fn, documents that have such rows, documents with an fp), by sets."""
    ids = {d[0] for d in docs}
    predicted = [p for p in predicted if p[0] in ids]
    top = lambda rows: {k: max(r[3] for r in rows if r[:3] == k) for k in {r[:3] for r in rows}}
    g, p = top(gold), top(predicted)
    cut = lambda keys, own: {k for k in keys if (k[1] is None) == own}
    two = lambda keys: {k[:2] for k in cut(keys, False)}
    highs = {k[:2] for k, v in g.items() if v == 3 and k[1] is not None}
    hits = {m: (a & b, b - a, a - b) for m, a, b in (("detection", two(g), two(p)), ("strict", cut(g, False), cut(p, False)), ("document", cut(g, True), cut(p, True)))}
    hits["high"] = (highs & two(p), set(), highs - two(p))
    both = cut(g, False) & cut(p, False)
    hits["level"] = ({k for k in both if p[k] == g[k]}, {k for k in both if p[k] > g[k]}, {k for k in both if p[k] < g[k]})
    read = {(c[0], c[1]) for c in clauses}
    hits["coverage"] = (two(g) & read, set(), two(g) - read)
    clean = ids - {k[0] for k in g}
    alarms = [x for x in predicted if x[0] in clean]
    out = {m: (*map(len, s), len(ids) if m in ("detection", "high", "coverage") else len({k[0] for x in s for k in x}), len({k[0] for k in s[1]})) for m, s in hits.items()}
    out["clean"] = (0, len(alarms), 0, len(clean), len({a[0] for a in alarms}))
    return {m: v for m, v in out.items() if v[3]}


def detects(spark, rows):
    """A detector that finds these."""
    found = [(d, "tenant", c, lev, cat, "s", "r", 0.51239) for d, c, cat, lev in rows]
    frame = spark.createDataFrame(found, "doc_id string, party_role string, clause_id string, level int, category string, source string, rule_id string, confidence double")
    return Detector("given", lambda clauses, requests: frame, {"rows": len(rows)})


def frames(spark, docs, gold, clauses):
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(gold, FOUND), spark.createDataFrame(clauses, CLAUSES)


def told(runs, *by):
    return {(r["run_id"], *[r[b] for b in by], r["measure"]): (r["tp"], r["fp"], r["fn"], r["docs"], r["alarmed"]) for r in runs.measured(*by).collect()}


def test_counts_are_those_of_sets(spark, tmp_path):
    runs = Runs(spark, str(tmp_path))
    assert runs.runs().count() == 0 and runs.counts().count() == 0 and told(runs) == {}
    want = {}
    for seed in (1, 2):
        docs, gold, predicted, clauses = made(seed)
        d, g, c = frames(spark, docs, gold, clauses)
        run = runs.add(detects(spark, predicted), f"split{seed}", d, g, c, d)
        want |= {(run, m): v for m, v in brute(docs, gold, predicted, clauses).items()}
        for by, place in (("language", 2), ("origin", 3)):
            for value in {x[place] for x in docs}:
                ids = {x[0] for x in docs if x[place] == value}
                part = brute([x for x in docs if x[0] in ids], [x for x in gold if x[0] in ids], predicted, clauses)
                assert {k[2]: v for k, v in told(runs, by).items() if k[:2] == (run, value)} == part
        for category in ("penalty", "payment"):
            own = brute(docs, [x for x in gold if x[2] == category], [x for x in predicted if x[2] == category], clauses)
            mine = {k[2]: v[:3] for k, v in told(runs, "category").items() if k[:2] == (run, category)}
            assert mine == {m: v[:3] for m, v in own.items() if m in ("strict", "document", "level")}
    assert told(runs) == want


def test_a_run_that_is_asked_for_again_or_was_killed_is_there_once(spark, tmp_path):
    docs, gold, predicted, clauses = made(3)
    d, g, c = frames(spark, docs, gold, clauses)
    runs, by = Runs(spark, str(tmp_path)), detects(spark, predicted)
    first = runs.add(by, "dev", d, g, c, d)
    before = told(runs)
    assert runs.add(by, "dev", d.orderBy(F.desc("doc_id")), g.orderBy("level"), c, d) == first  # order is nothing
    assert told(runs) == before and runs.runs().count() == 1
    broken = Detector("given", lambda clauses, requests: by.detect(clauses, requests).withColumn("confidence", F.raise_error(F.lit("killed")).cast("double")), {"rows": 0})
    with pytest.raises(Exception, match="killed"):
        runs.add(broken, "dev", d, g, c, d)
    (tmp_path / "counts" / "run_id=0123456789012345").mkdir(parents=True)  # left by a run that never ended; its id looks like a number
    spark.createDataFrame([("d0", "lease", "ru", "a", "detection", None, 1, 0, 0)], harness.COUNTS).write.mode("overwrite").parquet(str(tmp_path / "counts" / "run_id=0123456789012345"))
    assert told(runs) == before
    again = Detector("given", by.detect, {"rows": 0})
    ids = {first, runs.add(again, "dev", d, g, c, d), runs.add(by, "test", d, g, c, d), runs.add(by, "dev", d, g.where("level < 3"), c, d), runs.add(by, "dev", d, g, c.withColumn("text", F.lit("other")), d)}
    assert len(ids) == 5 == runs.runs().count()  # config, split, labels and texts each make another run


def test_summary_table_errors_and_intervals_come_from_the_tables(spark, tmp_path):
    docs, gold, predicted, clauses = made(4)
    d, g, c = frames(spark, docs, gold, clauses)
    runs = Runs(spark, str(tmp_path))
    ids = [runs.add(x, "dev", d, g, c, d.withColumn("party_role", F.lit("tenant"))) for x in (detects(spark, predicted), harness.detector("null"))]
    again = Runs(spark, str(tmp_path))
    one, none = again.summary().collect()
    b = brute(docs, gold, predicted, clauses)
    assert (one["detector"], none["detector"]) == ("given", "null")
    assert one["precision"] == b["detection"][0] / (b["detection"][0] + b["detection"][1]) and one["alarms_per_clean"] == b["clean"][1] / b["clean"][3] and one["coverage"] == b["coverage"][0] / (b["coverage"][0] + b["coverage"][2])
    assert (none["precision"], none["recall"], none["f1"], none["alarms_per_clean"], none["level_accuracy"]) == (None, 0.0, 0.0, 0.0, None)
    low, high = again.intervals(ids[0], times=300).select("f1_low", "f1_high").first()
    assert low < one["f1"] < high
    text = again.table(times=300).split("\n")
    assert len(text) == 4 and f"{one['f1']:.2f} [{low:.2f}–" in text[2] and "| — | 0.00 |" in text[3]
    keys = lambda rows: {x[:3] for x in rows if x[0] != "unknown"}
    want = sorted([("false alarm", k[2], k[0], k[1]) for k in keys(predicted) - keys(gold)] + [("missed", k[2], k[0], k[1]) for k in keys(gold) - keys(predicted)], key=str)
    got = again.errors(ids[0], c, most=2, chars=8).collect()
    for kind, category in {x[:2] for x in want}:
        every = [x for x in want if x[:2] == (kind, category)]
        mine = [r for r in got if (r["kind"], r["category"]) == (kind, category)]
        first = sorted(every, key=lambda x: (x[2], x[3] is not None, x[3] or ""))[:2]
        assert [(r["doc_id"], r["clause"]) for r in mine] == [x[2:] for x in first] and all(r["n"] == len(every) for r in mine)
    assert {r["excerpt"] for r in got} <= {None, "text of…"}


def test_edges(spark, tmp_path):
    docs, gold, predicted, clauses = made(5)
    d, g, c = frames(spark, docs, gold, clauses)
    empty = lambda x: x.where("false")
    assert harness.counts(empty(d), g, g, c).count() == 0
    bare = harness.counts(d, empty(g), empty(g), empty(c)).groupBy("measure").agg(F.count("*").alias("n"), *[F.sum(x).alias(x) for x in ("tp", "fp", "fn")]).collect()
    assert {tuple(r) for r in bare} == {(m, 12, 0, 0, 0) for m in ("detection", "high", "coverage", "clean")}
    with pytest.raises(ValueError, match="no detector 'x'"):
        harness.detector("x")
    once, twice = harness.dataset_hash(d, g), harness.dataset_hash(d, g.unionByName(g.limit(1)))
    assert once == harness.dataset_hash(d.repartition(5), g.repartition(3)) != twice
    assert len({harness.dataset_hash(d, g.withColumn("clause", F.lit(x))) for x in (None, "", "null")}) == 3
    assert set(itertools.chain(*[brute(*made(s)) for s in range(4)])) == set(KEYS)


def test_query_at_its_smallest(spark, tmp_path, sf_dir):
    from clausewise.plans.runs import ran

    runs = ran(spark, sf_dir, str(tmp_path), ("null", "daily"))
    m = {(r["detector"], r["measure"]): r for r in runs.measured().join(runs.runs().select("run_id", "detector"), "run_id").collect()}
    assert m["daily", "detection"]["precision"] == 1.0 and 0 < m["daily", "detection"]["recall"] < 1 and m["null", "detection"]["tp"] == 0
    assert m["daily", "detection"]["fn"] + m["daily", "detection"]["tp"] == m["null", "detection"]["fn"]
