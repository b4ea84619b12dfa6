"""Drafts of fields: precedence, numbers in words beside digits, and empty or odd texts."""

from __future__ import annotations

import datetime

from clausewise.operators import draft


def drafts(spark, *texts, kind="lease"):
    rows = [(i, kind, t) for i, t in enumerate(texts)]
    return draft.drafted(spark.createDataFrame(rows, "doc_id int, contract_type string, text string")).orderBy("doc_id").collect()


def test_edges(spark):
    none, empty, blank, head = drafts(spark, None, "", " \n\n ", "\n" * 7 + "№ 5 г. Алматы 1 мая 2024")
    for r in (none, empty, blank, head):
        assert r["auto_renewal"] is False and r["parties"] == [] and not any(r["lines"].values())
        assert all(r[f] is None for f in (*draft.RULES, "contract_number", "contract_date", "city", "dispute_forum", "price_period"))
    assert draft.drafted(spark.createDataFrame([], "doc_id int, contract_type string, text string")).count() == 0


def test_precedence(spark):
    r, other, same, differ, far = drafts(
        spark,
        "Договор № 7-а, «31» декабря 2024 года\nАктау қ. г. Орал\n1.1. Цена 5 (пять) тенге, затем 9 тенге ежемесячно.\n1.2. За просрочку оплаты начисляется штраф 9%.\n1.3. За просрочку оплаты пеня 0,2%.\n1.4. За просрочку оплаты пеня 7%, не более 3%.\n1.5. Споры в арбитраже по месту нахождения в суде.",
        "2024 жылғы 3 мамыр, 4 мая 2023",
        "1. Предупредив за 10 дней. 2. Уведомив за 10 (десять) календарных дней.",
        "1.1 Расторгнуть за 10 дней; 1.2 Уведомив за 11 дней",
        "1. Срок действия 99999999999 месяцев. 2. Срок действия 2 месяца",
    )
    assert (r["contract_number"], r["contract_date"], r["city"]) == ("7-а", datetime.date(2024, 12, 31), "Орал")
    assert (r["price_amount"], r["price_period"], r["dispute_forum"]) == (5.0, "monthly", "foreign_arbitration")
    assert (r["payment_penalty_rate_percent_per_day"], r["payment_penalty_cap_percent"]) == (0.2, None) and len(r["lines"]["price_amount"]) == 1
    assert other["contract_date"] == datetime.date(2023, 5, 4)  # the Russian form goes first
    assert same["termination_notice_days"] == 10 and differ["termination_notice_days"] is None and len(differ["lines"]["termination_notice_days"]) == 2
    assert far["term_months"] is None
    assert drafts(spark, "Срок действия 12 месяцев", kind="supply")[0]["term_months"] is None


def test_lines_go_on(spark):
    [r] = drafts(spark, "Арендатор: ТОО «Дом», БИН 123456789012, г. Актобе\r\n1.1. Договор считается\nпродленным на год.\nа) уведомив за 5 дней", kind="lease")
    assert r["auto_renewal"] and r["lines"]["auto_renewal"] == ["1.1. Договор считается продленным на год."]
    assert r["termination_notice_days"] == 5
    assert [tuple(p) for p in r["parties"]] == [("tenant", "ТОО «Дом»", "123456789012")]


def test_rules_share_the_sentences_that_they_look_for(spark):
    rows = spark.createDataFrame([(1, "lease", "1.1. Срок.")], "doc_id int, contract_type string, text string")
    said = draft.drafted(rows)._jdf.queryExecution().analyzed().toString()
    assert said.count(draft.RULES["payment_penalty_rate_percent_per_day"].lines) == 1
