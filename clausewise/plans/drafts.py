"""Contracts made of orders whose fields are known from parameters, to draft fields of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.operators import draft
from clausewise.plans import factory

#: Parameters of an order's contract, in SQL of both engines.
PARAMETERS = {"k": "CAST(o_orderkey AS BIGINT)", "n": "CAST(o_orderkey % 50 + 1 AS INT)", "d": "CAST(o_orderkey % 28 + 1 AS INT)", "q": "CAST(o_orderkey % 9 + 1 AS INT)", "p": "CAST(o_orderkey % 90 + 10 AS INT)", "b": "lpad(CAST(o_orderkey AS VARCHAR(20)), 12, '7')"}
#: (type, text, its fields in SQL; a field that isn't named is null).
CONTRACTS: list[tuple[str, str, dict[str, str]]] = [
    (
        "lease",
        "ДОГОВОР АРЕНДЫ № A-{k}\nг. Алматы, «{d}» марта 2024 г.\nАрендодатель: ТОО «Кров {k}», БИН {b}, г. Алматы\nАрендатор: ИП Лавка\n1.1. Срок действия договора {n} (прописью) месяцев.\n1.2. Договор считается продленным,\nесли стороны не возражают.\n"
        "2.1. Арендная плата {p} 000,5 тенге в месяц.\n2.2. Арендатор вносит оплату в течение {n} календарных дней.\n3.1. За просрочку внесения арендной платы Арендатор уплачивает пеню 0,{q}% за день, но не более {n}%.\n4.1. Споры решаются в суде по месту нахождения Арендодателя.\n5.1. Арендодатель вправе отказаться от Договора, предупредив за {n} дней.\n",
        {"contract_number": "'A-' || k", "contract_date": "'2024-03-' || lpad(CAST(d AS VARCHAR), 2, '0')", "city": "'Алматы'", "term_months": "n", "auto_renewal": "true", "price_amount": "p * 1000 + 0.5", "price_period": "'monthly'", "payment_deadline_days": "n",
         "payment_penalty_rate_percent_per_day": "q / 10.0", "payment_penalty_cap_percent": "n", "dispute_forum": "'counterparty_location_court'", "termination_notice_days": "n", "parties": "'landlord|ТОО «Кров ' || k || '»|' || b || ';tenant|ИП Лавка|-'"},
    ),
    (
        "supply",
        "ДОГОВОР ПОСТАВКИ\nг. Астана 05 мая 2023 года\nПоставщик: АО Бета, БИН {b}\nПокупатель: ТОО «Гамма {k}», БИН {b}\n1.1. Цена договора составляет {p}00 тенге. 1.2. Покупатель оплачивает товар в течение {n} (прописью) банковских дней.\n1.3. Срок поставки 5 месяцев.\n2.1. Споры передаются в арбитраж.\n3.1. Покупатель вправе расторгнуть договор без предварительного уведомления.\n",
        {"contract_date": "'2023-05-05'", "city": "'Астана'", "price_amount": "p * 100", "price_period": "'total'", "payment_deadline_days": "n", "dispute_forum": "'foreign_arbitration'", "termination_notice_days": "0", "parties": "'supplier|АО Бета|' || b || ';buyer|ТОО «Гамма ' || k || '»|' || b"},
    ),
    (
        "works",
        "ДОГОВОР ПОДРЯДА №P-{k}, от 31 февраля 2025\nПодрядчик: ТОО Мост\nЗаказчик: ТОО Дом, БИН {b}, г. Шымкент\n1.1. Споры рассматривает суд МФЦА, не арбитраж.\n1.2. Заказчик вправе расторгнуть договор, предупредив за {n} дней.\n1.3. Подрядчик вправе расторгнуть договор, уведомив за 1{n} дней.\n",
        {"contract_number": "'P-' || k", "city": "'Шымкент'", "dispute_forum": "'aifc_court'", "parties": "'contractor|ТОО Мост|-;customer|ТОО Дом|' || b"},
    ),
    (
        "lease",
        "ЖАЛҒА АЛУ ШАРТЫ № {k}\nАлматы қ., 2024 жылғы {d} мамыр\nЖалға беруші: ЖШС Қала, БСН {b}\nЖалға алушы: ЖК Дүкен, Семей қ., Абай\n1.1. Шарт {n} ай бойы әрекет етеді.\n1.2. Шарт автоматты түрде ұзартылады.\n1.3. Жалдау ақысы айына {p}000 теңге.\n"
        "1.4. Кешіктірген үшін жалдау ақысын төлеу бойынша 0,{q}% өсімпұл төленеді, бірақ {n}%-ынан аспайды.\n1.5. Даулар сот тәртібімен шешіледі.\n1.6. Тарап {n} күнтізбелік күн бұрын ескертеді.\n",
        {"contract_number": "CAST(k AS VARCHAR)", "contract_date": "'2024-05-' || lpad(CAST(d AS VARCHAR), 2, '0')", "city": "'Алматы'", "term_months": "n", "auto_renewal": "true", "price_amount": "p * 1000", "price_period": "'monthly'",
         "payment_penalty_rate_percent_per_day": "q / 10.0", "payment_penalty_cap_percent": "n", "dispute_forum": "'kz_courts'", "termination_notice_days": "n", "parties": "'landlord|ЖШС Қала|' || b || ';tenant|ЖК Дүкен|-'"},
    ),
]
TYPES = {"contract_number": "VARCHAR", "contract_date": "VARCHAR", "city": "VARCHAR", "term_months": "BIGINT", "auto_renewal": "BOOLEAN", "price_amount": "DOUBLE", "price_period": "VARCHAR", "payment_deadline_days": "BIGINT", "payment_penalty_rate_percent_per_day": "DOUBLE", "payment_penalty_cap_percent": "DOUBLE", "dispute_forum": "VARCHAR", "termination_notice_days": "BIGINT", "parties": "VARCHAR"}


def field_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of every order's contract, drafted by patterns."""
    o = factory.dealt(spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*[f"{v} AS {n}" for n, v in PARAMETERS.items()]))
    pick = lambda at: F.element_at(F.array(*[F.lit(c[at]) for c in CONTRACTS]), (F.col("k") % len(CONTRACTS) + 1).cast("int"))
    text = pick(1)
    for name in PARAMETERS:
        text = F.replace(text, F.lit("{" + name + "}"), F.col(name).cast("string"))
    got = draft.drafted(o.select(F.col("k").alias("doc_id"), pick(0).alias("contract_type"), text.alias("text")))
    sides = F.array_join(F.transform("parties", lambda x: F.concat_ws("|", x["role"], x["name"], F.coalesce(x["bin"], F.lit("-")))), ";")
    typed = {"BIGINT": "long", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}
    return got.withColumn("parties", sides).select("doc_id", "contract_type", *[F.col(f).cast(typed[t]).alias(f) for f, t in TYPES.items()])


def _case(field: str) -> str:
    rest = "false" if field == "auto_renewal" else "NULL"
    return f"CAST(CASE k % {len(CONTRACTS)} " + " ".join(f"WHEN {i} THEN {f.get(field, rest)}" for i, (_, _, f) in enumerate(CONTRACTS)) + f" END AS {TYPES[field]}) AS {field}"


DRAFTS_SQL = f"SELECT k AS doc_id, CASE k % {len(CONTRACTS)} " + " ".join(f"WHEN {i} THEN '{t}'" for i, (t, _, _) in enumerate(CONTRACTS)) + f" END AS contract_type, {', '.join(map(_case, TYPES))} FROM (SELECT {', '.join(f'{v} AS {n}' for n, v in PARAMETERS.items())} FROM orders)"

QUERIES = {"field_drafts": (field_drafts, DRAFTS_SQL)}
