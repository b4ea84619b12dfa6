"""A first draft of a contract's fields by patterns, for a reader to correct: a table of rules, each field a column.

A rule says which sentences may hold a field and how its value is written there; of the sentences that fit
the first place counts. The sentences are kept beside the values, as evidence (`lines`).

Defined results: null and empty texts have null fields, no renewal and no parties; a date that isn't in the
calendar is null; a number too large for its field is null.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.dims import lookup

# Months as contracts write them, sides as they are introduced, and how fields are worded.
MONTHS = {
    "ru": ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"),
    "kk": ("қаңтар", "ақпан", "наурыз", "сәуір", "мамыр", "маусым", "шілде", "тамыз", "қыркүйек", "қазан", "қараша", "желтоқсан"),
}
SIDES = {"Арендодатель": "landlord", "Арендатор": "tenant", "Поставщик": "supplier", "Покупатель": "buyer", "Подрядчик": "contractor", "Заказчик": "customer", "Жалға беруші": "landlord", "Жалға алушы": "tenant"}
_CAPITAL = "А-ЯЁӘҒҚҢӨҰҮҺІ"
_SPELT = r"\s*(?:\([^)]*\)\s*)?"
NUMBER = r"№\s*([^\s,]+)"
DATES = {"ru": (rf"[«\"]?(\d{{1,2}})[»\"]?\s+({'|'.join(MONTHS['ru'])})\s+(\d{{4}})", (3, 2, 1)), "kk": (rf"(\d{{4}})\s+жылғы\s+(\d{{1,2}})\s+({'|'.join(MONTHS['kk'])})", (1, 3, 2))}
CITIES = (r"г\.\s*([А-ЯЁ][\w-]+)", rf"([{_CAPITAL}][\w-]+)\s+қ\.")
SIDE = rf"^({'|'.join(SIDES)}):\s*(.+?)(?:,\s*(?:БИН|ИИН|БСН|ЖСН)\s*(\d{{12}}))?(?:,\s*(?:г\.|[{_CAPITAL}]\w+\s+қ\.).*)?$"
MONTHLY = r"в месяц|ежемесячн|айына|ай сайын"
FORUMS = ((r"(?U)МФЦА", "aifc_court"), (r"(?iuU)арбитраж", "foreign_arbitration"), (r"(?U)по месту нахождения", "counterparty_location_court"), (r"(?U)в суде|судебном порядке|сот тәртібімен", "kz_courts"))
WITHOUT_NOTICE = r"без предварительного уведомления|ескертпей"
RENEWED = r"считается продлен|считается пролонгир|автоматическ\w+ (про)?длен|пролонгируется|ұзартылды деп есептеледі|автоматты"


@dataclass(frozen=True)
class Rule:
    """lines: what a sentence says that may hold the field, and what else it must say; values: patterns of which one group is the value; first: of the first sentence only."""

    lines: str
    values: str
    also: str | None = None
    first: bool = False


RULES = {
    "term_months": Rule(r"срок действия|в течение \d+ \([^)]*\) месяц|бойы әрекет|месяц|ай бойы", rf"(\d+){_SPELT}(?:месяц|ай)"),
    "price_amount": Rule(r"тенге|теңге|₸", rf"(\d[\d ]*(?:,\d+)?){_SPELT}(?:тенге|теңге|₸)"),
    "payment_deadline_days": Rule(r"оплачивает|оплат\w+ в течение", rf"в течение\s*(\d+){_SPELT}(?:календарных|рабочих|банковских)?\s*дн", also="оплат|Покупатель|Заказчик"),
    "payment_penalty_rate_percent_per_day": Rule(r"(просрочк|кешіктір|нарушение сроков).*(оплат|арендной платы|задолженност|ақысын төлеу)|(оплат|арендн).*просрочк", r"(\d+(?:,\d+)?)\s*%", also=r"пен[юя]|неустойк|өсімпұл", first=True),
    "payment_penalty_cap_percent": Rule(r"(просрочк|кешіктір|нарушение сроков).*(оплат|арендной платы|задолженност|ақысын төлеу)|(оплат|арендн).*просрочк", r"не более\s*(\d+(?:,\d+)?)\s*%|(\d+(?:,\d+)?)\s*%-ынан аспайды", also=r"пен[юя]|неустойк|өсімпұл", first=True),
    "termination_notice_days": Rule(r"отказаться от (исполнения )?Договора|расторг|ескерт|бұзуға|предупредив|уведомив|прекращени", rf"за\s*(\d+){_SPELT}(?:календарных|рабочих)?\s*дн|(\d+){_SPELT}күнтізбелік"),
}
#: Lines of the head, where number, date and city are looked for.
HEAD = 6


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of a pattern's first match, null without one."""
    return F.nullif(F.regexp_extract(text, "(?U)" + pattern, group), F.lit(""))


def number(said: Column) -> Column:
    return F.regexp_replace(F.replace(said, F.lit(","), F.lit(".")), " ", "").try_cast("double")


def sentences(text: Column) -> Column:
    """Numbered points and lines; a line that begins in lower case goes on from the one before."""
    body = F.regexp_replace(F.regexp_replace(text, r"(?U)\s*\n\s*(?=(?![а-я]\))[а-яёәғқңөұүһі])", " "), "[  ]+", " ")
    return F.filter(F.transform(F.split(body, r"(?U)(?<=[.;])\s+(?=\d+\.\d*\s|[а-я]\))|\n"), lambda x: F.trim(x)), lambda x: x != "")


def date(head: Column) -> Column:
    def of(lang: str) -> Column:
        pattern, (year, month, day) = DATES[lang]
        at = F.array_position(F.array(*map(F.lit, MONTHS[lang])), found(head, pattern, month))
        return F.concat_ws("-", found(head, pattern, year), F.lpad(at.cast("string"), 2, "0"), F.lpad(found(head, pattern, day), 2, "0"))

    return F.coalesce(*[F.when(head.rlike("(?U)" + DATES[lang][0]), of(lang)) for lang in DATES]).try_cast("date")


def parties(text: Column) -> Column:
    def of(line: Column) -> Column:
        role = lookup(SIDES, F.regexp_extract(line, "(?U)" + SIDE, 1))
        name = F.regexp_replace(F.trim(F.regexp_extract(line, "(?U)" + SIDE, 2)), ",+$", "")
        return F.struct(role.alias("role"), name.alias("name"), found(line, SIDE, 3).alias("bin"))

    return F.coalesce(F.transform(F.filter(F.split(text, "\r?\n"), lambda x: x.rlike("(?U)" + SIDE)), of), F.array().cast("array<struct<role:string,name:string,bin:string>>"))


def drafted(contracts: DataFrame) -> DataFrame:
    """contracts (doc_id, contract_type, text): doc_id, a column for each field, parties, and lines (field -> sentences)."""
    said = contracts.select("doc_id", "contract_type", "text", sentences(F.col("text")).alias("s"), F.array_join(F.slice(F.split("text", "\n"), 1, HEAD), "\n").alias("head"))

    def lines(r: Rule) -> Column:
        fit = F.filter("s", lambda x: (x.rlike("(?U)" + r.also) if r.also else F.lit(True)) & x.rlike("(?iuU)" + r.lines))
        return F.coalesce(F.slice(fit, 1, 1) if r.first else fit, F.array().cast("array<string>"))

    # rules that look for the same sentences share them
    same: dict[str, str] = {f: next(g for g, o in RULES.items() if (o.lines, o.also, o.first) == (r.lines, r.also, r.first)) for f, r in RULES.items()}
    # a one-row generator, so that the sentences of a rule are looked for once
    picked = said.select("*", F.explode(F.array(F.struct(*[lines(RULES[f]).alias(f) for f in dict.fromkeys(same.values())], F.filter("s", lambda x: x.rlike("(?iuU)" + RENEWED)).alias("auto_renewal")))).alias("l"))

    def value(f: str) -> Column:
        hit = F.array_join(F.col(f"l.{same[f]}"), " ")
        groups = RULES[f].values.count("(") - RULES[f].values.count("(?:") - RULES[f].values.count(r"\(")
        return F.coalesce(*[found(hit, RULES[f].values, g + 1) for g in range(groups)])

    notices = F.flatten(F.transform("l.termination_notice_days", lambda x: F.regexp_extract_all(x, F.lit("(?U)" + RULES["termination_notice_days"].values), F.lit(0))))
    days = F.array_distinct(F.transform(notices, lambda x: F.regexp_extract(x, r"(\d+)", 1)))
    body = F.array_join("s", "\n")
    amount = number(value("price_amount"))
    fields = {
        "contract_type": F.col("contract_type"), "contract_number": found(F.col("head"), NUMBER), "contract_date": date(F.col("head")), "city": F.coalesce(*[found(F.col("head"), c) for c in CITIES]),
        "term_months": F.when(F.col("contract_type") == "lease", value("term_months").try_cast("int")), "auto_renewal": F.coalesce(F.size("l.auto_renewal") > 0, F.lit(False)),
        "price_amount": amount, "price_period": F.when(amount.isNotNull(), F.when(F.array_join("l.price_amount", " ").rlike("(?U)" + MONTHLY), "monthly").otherwise("total")),
        "payment_deadline_days": value("payment_deadline_days").try_cast("int"), **{f: number(value(f)) for f in ("payment_penalty_rate_percent_per_day", "payment_penalty_cap_percent")},
        "dispute_forum": reduce(lambda out, pf: F.when(body.rlike(pf[0]), pf[1]).otherwise(out), reversed(FORUMS), F.lit(None).cast("string")),
        "termination_notice_days": F.when(body.rlike("(?U)" + WITHOUT_NOTICE), 0).when(F.size(days) == 1, F.get(days, F.lit(0)).try_cast("int")),
    }
    return picked.select("doc_id", *[c.alias(f) for f, c in fields.items()], parties(F.col("text")).alias("parties"), F.map_from_arrays(F.array(*map(F.lit, [*RULES, "auto_renewal"])), F.array(*[F.coalesce(F.col(f"l.{f}"), F.array().cast("array<string>")) for f in [*same.values(), "auto_renewal"]])).alias("lines"))
