from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewise.operators.cells import BATCH_BYTES, Cells, bounded_batches, ceilings
from clausewise.plans import indexed

SCHEMA = "id long, vector array<double>, kind string"


def brute(asked, refs, k, same=False):
    """(query_id, rank, ref_id) by meeting all."""
    out = []
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    fit = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)
    for q, v, kind in asked:
        if not fit(v):
            continue
        scored = sorted((-round(float(unit(v) @ unit(w)), 10), r) for r, w, other in refs if fit(w) and (not same or (kind is not None and kind == other)))
        out += [(q, i, r) for i, (_, r) in enumerate(scored[:k], 1)]
    return sorted(out)


def answers(index, asked, k, **more):
    return sorted((r["query_id"], r["rank"], r["ref_id"]) for r in index.nearest(asked.withColumnRenamed("id", "query_id"), k, **more).collect())


def clustered(n, groups, seed, size=16):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, size))
    return [(i, (middles[i % groups] + rng.normal(scale=0.05, size=size)).tolist(), "ab"[i % 2]) for i in range(n)]


@pytest.mark.parametrize("same", [False, True])
def test_cells_find_what_meeting_all_finds(spark, same):
    refs = clustered(3000, 40, 1)
    asked = clustered(60, 40, 1)[:50] + [(90, np.random.default_rng(2).normal(size=16).tolist(), "a")]
    index = Cells.build(spark.createDataFrame(refs, SCHEMA).withColumnRenamed("id", "ref_id"), ["kind"] if same else None)
    a = spark.createDataFrame(asked, SCHEMA)
    assert answers(index, a, 7, rows=200) == brute(asked, refs, 7, same)
    seen = index.shares(a.withColumnRenamed("id", "query_id"), 7, rows=200).collect()
    assert {r["query_id"] for r in seen} == {q for q, _, _ in asked}
    assert all(r["indexed"] == (1500 if same else 3000) for r in seen)
    inside = [r["looked_at"] / r["indexed"] for r in seen if r["query_id"] != 90]
    assert sum(inside) / len(inside) < 0.1  # a query among clusters opens its own and little else


def test_odd_vectors_ties_and_one_vector_of_many_rows(spark):
    one = [1.0, 2.0, 0.0]
    refs = [(i, one, "a") for i in range(400)] + [(400 + i, [float(np.cos(i)), float(np.sin(i)), 0.1 * (i % 7)], "b") for i in range(300)]
    refs += [(900, [0.0, 0.0, 0.0], "a"), (901, None, "a"), (902, [1.0, None, 2.0], "a"), (903, [1.0, float("nan"), 2.0], "a"), (904, [], "b"), (905, [float("inf"), 1.0, 1.0], None), (906, one, None)]
    asked = [(1, one, "a"), (2, [0.0, 0.0, 0.0], "a"), (3, None, "a"), (4, [-1.0, -2.0, 0.0], "b"), (5, one, None), (6, [1.0, float("nan"), 0.0], "a"), (7, [0.0, 0.0, 1.0], "b")]
    r, a = spark.createDataFrame(refs, SCHEMA).withColumnRenamed("id", "ref_id"), spark.createDataFrame(asked, SCHEMA)
    for same in (None, ["kind"]):
        index = Cells.build(r, same)
        assert answers(index, a, 5, rows=50) == brute(asked, refs, 5, bool(same))
        # the 400 equal rows lie in one cell and are dealt to blocks; equal scores go to smaller ids
        assert [x for x in answers(index, a, 3) if x[0] == 1] == [(1, 1, 0), (1, 2, 1), (1, 3, 2)]
    few = Cells.build(r.where("ref_id < 3"), None, cells=50)
    assert answers(few, a.where("id = 1"), 9) == [(1, 1, 0), (1, 2, 1), (1, 3, 2)]  # fewer than k


def test_empty_sides(spark):
    r = spark.createDataFrame(clustered(30, 3, 5), SCHEMA).withColumnRenamed("id", "ref_id")
    a = spark.createDataFrame(clustered(4, 3, 6), SCHEMA)
    assert answers(Cells.build(r.where("false")), a, 3) == []
    assert answers(Cells.build(r), a.where("false"), 3) == []
    assert answers(Cells.build(r.where("ref_id < 0"), ["kind"]), a, 3) == []


def test_an_index_that_was_saved_answers_the_same(spark, tmp_path):
    refs, asked = clustered(500, 10, 3), clustered(20, 10, 4)
    index = Cells.build(spark.createDataFrame(refs, SCHEMA).withColumnRenamed("id", "ref_id").withColumn("title", F.lit("x")), ["kind"])
    index.save(str(tmp_path / "index"))
    again = Cells.load(spark, str(tmp_path / "index"))
    a = spark.createDataFrame(asked, SCHEMA)
    assert again.same == ["kind"] and "title" in again.rows.columns
    assert answers(again, a, 4) == answers(index, a, 4) == brute(asked, refs, 4, True)


def test_ceilings_hold():
    rng = np.random.default_rng(8)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    members, queries, centre = unit(rng.normal(size=(200, 5))), unit(rng.normal(size=(50, 5))), rng.normal(size=(1, 5)) * 0.3
    away = np.linalg.norm(members - centre, axis=1)
    top = ceilings(queries, centre, away.min()[None], away.max()[None])
    assert ((queries @ members.T).max(axis=1) <= top[:, 0] + 1e-9).all()


def test_queries_of_cells(spark, sf_dir):
    from clausewise.plans.catalogue import knn

    for name, (query, _) in indexed.queries().items():
        got = sorted(map(tuple, query(spark, sf_dir).collect()))
        assert got == sorted(map(tuple, knn(spark, sf_dir, name.endswith("filtered")).collect())) and got


def test_workers_get_bounded_batches(spark):
    """Rows for workers are blocks of vectors: a batch is bounded by its bytes; a smaller bound of the session's own stays."""
    name, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        rng = np.random.default_rng(3)
        rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(60)]
        index = Cells.build(spark.createDataFrame(rows, "ref_id long, vector array<double>"), cells=4)
        asked = spark.createDataFrame(rows[:9], "query_id long, vector array<double>")
        found = index.nearest(asked, 3, rows=4)
        assert int(spark.conf.get(name).rstrip("b")) <= BATCH_BYTES
        best = {}
        for i, v in rows[:9]:
            score = {j: round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 9) for j, w in rows}
            best[i] = sorted(score, key=lambda j: (-score[j], j))[:3]
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["ref_id"])
        assert got == best
        spark.conf.set(name, "1000")
        bounded_batches(spark)
        assert spark.conf.get(name).rstrip("b") == "1000"
    finally:
        spark.conf.set(name, before)
