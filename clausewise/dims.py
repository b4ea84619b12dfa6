"""Small fixed tables: roles, categories, levels, lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The parties of each type of contract (who drafts it, the other side).
TYPES = {"lease": ("landlord", "tenant"), "supply": ("supplier", "buyer"), "works": ("contractor", "customer")}
CATEGORIES = ("penalty", "auto_renewal", "liability", "force_majeure", "jurisdiction", "termination", "unilateral_change", "payment", "acceptance")
LEVELS = {1: "low", 2: "medium", 3: "high"}

# Role nouns and their case endings.
_SOFT = {"ь": "nom", "я": "gen", "ю": "dat", "ем": "ins", "е": "prep"}
_HARD = {"": "nom", "а": "gen", "у": "dat", "ом": "ins", "е": "prep"}
_FRONT = {"": "nom", "нің": "gen", "ге": "dat", "ні": "acc", "ден": "abl", "мен": "ins", "де": "loc"}
_BACK = {"": "nom", "ның": "gen", "ға": "dat", "ны": "acc", "дан": "abl", "мен": "ins", "да": "loc"}
_R = {"": "nom", "дің": "gen", "ге": "dat", "ді": "acc", "ден": "abl", "мен": "ins", "де": "loc"}
STEMS = {
    "ru": {
        "landlord": [("арендодател", _SOFT), ("наймодател", _SOFT)],
        "tenant": [("арендатор", _HARD), ("нанимател", _SOFT)],
        "supplier": [("поставщик", _HARD)],
        "buyer": [("покупател", _SOFT)],
        "contractor": [("подрядчик", _HARD), ("исполнител", _SOFT)],
        "customer": [("заказчик", _HARD)],
    },
    "kk": {
        "landlord": [(r"жалға\s+беруші", _FRONT)],
        "tenant": [(r"жалға\s+алушы", _BACK)],
        "supplier": [(r"жеткізуші", _FRONT), (r"өнім\s+беруші", _FRONT)],
        "buyer": [(r"сатып\s+алушы", _BACK)],
        "contractor": [(r"мердігер", _R), (r"орындаушы", _BACK)],
        "customer": [(r"тапсырыс\s+беруші", _FRONT)],
    },
}
TYPE_OF = {r: t for t, rs in TYPES.items() for r in rs}
OTHER = {r: rs[1 - i] for rs in TYPES.values() for i, r in enumerate(rs)}


def roles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, TYPE_OF[r], OTHER[r], "drafting" if TYPES[TYPE_OF[r]][0] == r else "other") for r in OTHER], "role string, contract_type string, counterparty string, side string")


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def counterparty(role: Column) -> Column:
    return lookup(OTHER, role)


def level_name(rank: Column) -> Column:
    return lookup(LEVELS, rank)


# What a reader is shown of categories, levels, types and roles.
CATEGORY_TITLES = {
    "penalty": "Неустойка и штрафы", "auto_renewal": "Автопродление", "liability": "Ответственность и убытки", "force_majeure": "Форс-мажор", "jurisdiction": "Где решаются споры",
    "termination": "Расторжение и выход из договора", "unilateral_change": "Одностороннее изменение условий", "payment": "Условия оплаты", "acceptance": "Приёмка и претензии",
}
CATEGORY_ABOUT = {
    "penalty": "размер пени и штрафов, которые платит сторона, и есть ли у них потолок",
    "auto_renewal": "продлевается ли договор сам и как от этого отказаться",
    "liability": "за что и в каком объёме сторона отвечает деньгами",
    "force_majeure": "что будет при обстоятельствах, от сторон не зависящих",
    "jurisdiction": "в каком суде и по какому праву решаются споры",
    "termination": "кто и на каких условиях может выйти из договора",
    "unilateral_change": "может ли одна сторона менять цену или условия без согласия другой",
    "payment": "когда и сколько платят, риск не получить деньги или товар",
    "acceptance": "как принимается результат и сколько времени на претензии",
}
LEVEL_TITLES = {1: "Низкий риск", 2: "Средний риск", 3: "Высокий риск"}
LEVEL_ADVICE = {
    3: "Не подписывать в таком виде: добиться изменения или показать юристу.",
    2: "Обсудить с контрагентом: условие хуже обычной практики.",
    1: "Знать и помнить: условие распространено, но не нейтрально.",
}
TYPE_TITLES = {"lease": "Аренда", "supply": "Поставка", "works": "Подряд / услуги"}
ROLE_TITLES = {"landlord": "Арендодатель", "tenant": "Арендатор", "supplier": "Поставщик", "buyer": "Покупатель", "contractor": "Подрядчик / исполнитель", "customer": "Заказчик"}
DEFAULT_ROLE = {"lease": "tenant", "supply": "buyer", "works": "customer"}
LEGAL = {
    "penalty_reduction": "ст. 297 ГК РК — суд вправе уменьшить чрезмерно высокую неустойку",
    "penalty_definition": "ст. 293 ГК РК — понятие неустойки",
    "force_majeure": "п. 2 ст. 359 ГК РК — освобождение предпринимателя от ответственности при непреодолимой силе",
    "adhesion": "ст. 389 ГК РК — договор присоединения и явно обременительные условия",
    "unilateral_refusal": "ст. 404 ГК РК — односторонний отказ от договора и предупреждение не позднее чем за месяц",
}
