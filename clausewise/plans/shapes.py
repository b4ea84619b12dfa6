"""Contracts of several shapes, a shape to an order, with what their clauses must be: articles, Kazakh sections, an appendix, unnumbered headings, numbers that occur again, no numbers at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.operators import segment
from clausewise.plans import factory

ROW = ("clause_id", "number", "level", "parent_id", "section_id", "section_title", "kind", "text")
#: shape -> (text, clauses in order); {k} is a number of the order.
SHAPES: list[tuple[str, list[tuple]]] = [
    (
        "ДОГОВОР ПОСТАВКИ № {k}\nг. Алматы\nСтатья 1. Предмет\n1. Поставщик поставляет {k} единиц.\n2. Покупатель оплачивает\n{k} единиц.\nСтатья 2.\nЦена\nЦена твердая.\n1. Цена указана в спецификации.\n",
        [
            ("preamble", None, 0, None, None, None, "preamble", "г. Алматы"),
            ("1", "Статья 1.", 1, None, "1", "Предмет", "heading", "Предмет"),
            ("1.1", "1.", 2, "1", "1", "Предмет", "clause", "Поставщик поставляет {k} единиц."),
            ("1.2", "2.", 2, "1", "1", "Предмет", "clause", "Покупатель оплачивает {k} единиц."),
            ("2", "Статья 2.", 1, None, "2", "Цена", "heading", "Цена"),
            ("2.0", None, 2, "2", "2", "Цена", "clause", "Цена твердая."),
            ("2.1", "1.", 2, "2", "2", "Цена", "clause", "Цена указана в спецификации."),
        ],
    ),
    (
        "ШАРТ\n1-бап. Жалпы ережелер\n1. Тараптар {k} бойынша келісті.\n2-бап. Төлем\n1. Төлем {k} күн ішінде жүргізіледі.\n",
        [
            ("1", "1-бап.", 1, None, "1", "Жалпы ережелер", "heading", "Жалпы ережелер"),
            ("1.1", "1.", 2, "1", "1", "Жалпы ережелер", "clause", "Тараптар {k} бойынша келісті."),
            ("2", "2-бап.", 1, None, "2", "Төлем", "heading", "Төлем"),
            ("2.1", "1.", 2, "2", "2", "Төлем", "clause", "Төлем {k} күн ішінде жүргізіледі."),
        ],
    ),
    (
        "ДОГОВОР\n1. Предмет\n1.1. Текст {k}.\n1.2. Перечень:\nа) первое;\nб) второе.\n1.2.1. Глубже.\nПриложение № 2\n1. Спецификация {k}.\nРЕКВИЗИТЫ СТОРОН\nАдрес {k}\n",
        [
            ("1", "1.", 1, None, "1", "Предмет", "heading", "Предмет"),
            ("1.1", "1.1.", 2, "1", "1", "Предмет", "clause", "Текст {k}."),
            ("1.2", "1.2.", 2, "1", "1", "Предмет", "clause", "Перечень:\nа) первое;\nб) второе."),
            ("1.2.1", "1.2.1.", 3, "1.2", "1", "Предмет", "clause", "Глубже."),
            ("прил2", None, 0, None, None, None, "heading", "Приложение № 2"),
            ("прил2.1", "1.", 1, None, "прил2.1", "Приложение № 2", "clause", "Спецификация {k}."),
            ("req", None, 1, None, None, None, "requisites", "РЕКВИЗИТЫ СТОРОН Адрес {k}"),
        ],
    ),
    (
        "ДОГОВОР ПОДРЯДА\nПреамбула {k}.\n1. Подрядчик выполняет работы по заданию заказчика номер {k}.\nПРОЧИЕ УСЛОВИЯ\nАбзац {k}.\n2. Заказчик уплачивает цену работ в порядке, указанном в п.\n2.7 приложения {k}.\n3. ФОРС-МАЖОР\nСтороны освобождаются.\n",
        [
            ("preamble", None, 0, None, None, None, "preamble", "Преамбула {k}."),
            ("1", "1.", 1, None, "1", None, "clause", "Подрядчик выполняет работы по заданию заказчика номер {k}."),
            ("h1", None, 0, None, None, None, "heading", "ПРОЧИЕ УСЛОВИЯ"),
            ("p2", None, 1, None, None, "ПРОЧИЕ УСЛОВИЯ", "clause", "Абзац {k}."),
            ("2", "2.", 1, None, "2", "ПРОЧИЕ УСЛОВИЯ", "clause", "Заказчик уплачивает цену работ в порядке, указанном в п. 2.7 приложения {k}."),
            ("3", "3.", 1, None, "3", "ФОРС-МАЖОР", "clause", "Стороны освобождаются."),
        ],
    ),
    (
        "ДОГОВОР\n1. Предмет\n1.1. Раз {k}.\nПриложение № 1\n1. Снова {k}.\nПриложение № 1\n1. Ещё {k}.\n",
        [
            ("1", "1.", 1, None, "1", "Предмет", "heading", "Предмет"),
            ("1.1", "1.1.", 2, "1", "1", "Предмет", "clause", "Раз {k}."),
            ("прил1", None, 0, None, None, None, "heading", "Приложение № 1"),
            ("прил1.1", "1.", 1, None, "прил1.1", "Приложение № 1", "clause", "Снова {k}."),
            ("прил1~2", None, 0, None, None, None, "heading", "Приложение № 1"),
            ("прил1.1~2", "1.", 1, None, "прил1.1", "Приложение № 1", "clause", "Ещё {k}."),
        ],
    ),
    ("Первый абзац\nо {k} вещах.\n\nВторой абзац.\n", [("p1", None, 1, None, None, None, "clause", "Первый абзац о {k} вещах."), ("p2", None, 1, None, None, None, "clause", "Второй абзац.")]),
]


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS doc_id", f"cast(o_orderkey % {len(SHAPES)} as int) AS shape", "cast(o_orderkey % 89 + 10 as string) AS k")
    texts = F.array(*[F.lit(t) for t, _ in SHAPES])
    return factory.dealt(orders).select("doc_id", F.replace(texts[F.col("shape")], F.lit("{k}"), F.col("k")).alias("text"))


def segment_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of every clause."""
    c = segment.clauses_once(contracts(spark, sf_dir))
    return c.select("doc_id", F.col("clause_ord").cast("long").alias("clause_ord"), *[F.col(f).cast("long").alias(f) if f == "level" else F.col(f) for f in ROW])


def _sql(value: object) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


SHAPES_SQL = (
    "SELECT o_orderkey AS doc_id, clause_ord, clause_id, number, level, parent_id, section_id, section_title, kind, replace(text, '{k}', CAST(o_orderkey % 89 + 10 AS VARCHAR)) AS text FROM orders JOIN (VALUES "
    + ", ".join("(" + ", ".join(map(_sql, (s, i, *c))) + ")" for s, (_, clauses) in enumerate(SHAPES) for i, c in enumerate(clauses))
    + f") AS t(shape, clause_ord, {', '.join(ROW)}) ON shape = o_orderkey % {len(SHAPES)}"
)


def document_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each contract by its clauses."""
    return segment.languages_once(contracts(spark, sf_dir))


LANGUAGES_SQL = f"SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % {len(SHAPES)} = 1 THEN 'kk' ELSE 'ru' END AS language FROM orders"

QUERIES = {"segment_shapes": (segment_shapes, SHAPES_SQL), "document_languages": (document_languages, LANGUAGES_SQL)}
