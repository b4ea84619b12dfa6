"""Contracts that arrive as files are taken in once, whatever is killed when."""

from __future__ import annotations

import pytest

from clausewise.streaming import inbox

TEXT = "ДОГОВОР ПОСТАВКИ\n1. Предмет\n1.1. Поставщик поставляет товар номер {}.\n"


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def run(spark, tmp_path, **more):
    q = inbox.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), files=2, once=True, **more)
    q.awaitTermination()


def test_each_contract_once(spark, tmp_path):
    for i in range(5):
        put(tmp_path / "in", f"{i}.txt", TEXT.format(i))
    put(tmp_path / "in", "copy.txt", TEXT.format(3))
    put(tmp_path / "in", "empty.txt", "")
    died = []

    def dies(df, n, out):
        inbox.taken(df, n, out)
        if n == 1:  # all is written, but the batch isn't known to be done
            died.append(n)
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        run(spark, tmp_path, take=dies)
    assert died == [1]
    run(spark, tmp_path)
    contracts = spark.read.parquet(str(tmp_path / "out/contracts"))
    clauses = spark.read.parquet(str(tmp_path / "out/clauses"))
    assert contracts.count() == contracts.select("doc_id").distinct().count() == 5
    assert sorted(r["text"] for r in clauses.where("level = 2").collect()) == [f"Поставщик поставляет товар номер {i}." for i in range(5)]
    put(tmp_path / "in", "late.txt", TEXT.format(9))
    put(tmp_path / "in", "again.txt", TEXT.format(0))
    run(spark, tmp_path)
    assert spark.read.parquet(str(tmp_path / "out/contracts")).count() == 6
    assert spark.read.parquet(str(tmp_path / "out/clauses")).where("level = 2").count() == 6
