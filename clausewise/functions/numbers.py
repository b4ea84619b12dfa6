"""Numbers of a clause as arrays of spans: penalty percentages, durations, notices, terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewise.functions.text import after, before, has, spans

VALUES = "array<struct<value:double,start:int,end:int>>"

# Numbers as words, and adjectives of months.
WORDS = {
    "одного": 1, "одной": 1, "один": 1, "одну": 1, "одна": 1, "двух": 2, "два": 2, "две": 2, "трех": 3, "трёх": 3, "три": 3, "четырех": 4, "четыре": 4, "пяти": 5, "пять": 5,
    "шести": 6, "шесть": 6, "семи": 7, "семь": 7, "десяти": 10, "десять": 10, "четырнадцати": 14, "пятнадцати": 15, "двадцати": 20, "тридцати": 30, "тридцать": 30,
    "шестидесяти": 60, "шестьдесят": 60, "девяноста": 90, "девяносто": 90, "бір": 1, "екі": 2, "үш": 3, "бес": 5, "алты": 6, "он": 10, "отыз": 30,
}
MONTH_ADJECTIVES = {"одномесячн": 1, "месячн": 1, "двухмесячн": 2, "трехмесячн": 3, "трёхмесячн": 3, "шестимесячн": 6}

# Patterns of penalties and terms.
PENALTY = r"(?:пен[яиюе]\b|пени\b|неустойк|штраф|өсімпұл|тұрақсыздық\s+айыб|айыппұл|айыпт)"
PER_DAY = (
    r"(?:за\s+каждый\s+(?:календарный\s+|рабочий\s+)?день|в\s+день\b|за\s+каждые\s+сутки|ежедневно|каждый\s+день\s+(?:задержки|просрочки)|за\s+каждый\s+день"
    r"|әрбір\s+(?:кешіктірілген\s+)?күн\w*\s+үшін|кешіктірілген\s+әрбір\s+күн|әрбір\s+күнге|күніне)"
)
CAP_BEFORE = (
    r"(?:не\s+более|не\s+свыше|не\s+может\s+превышать|не\s+превыша\w*|не\s+должен\s+превышать|ограничен\w*|но\s+в\s+общей\s+сложности\s+не\s+более|максимум|не\s+больше)\s*(?:чем\s+)?[^.;%]{0,40}$"
)
CAP_AFTER = r"^[^.;]{0,15}(?:аспайды|артық\s+емес|аспауға|аспайтын|шегінде)"
CAP_WORDS = r"(?:не\s+более|не\s+свыше|не\s+может\s+превышать)[^.;]{0,40}сумм"
PERCENT = r"\d+(?:[.,]\d+)?\s*(?:\([^)]{1,40}\)\s*)?(?:%|процент\w*|пайыз\w*)"
_ANY = "|".join(sorted(WORDS, key=len, reverse=True))
_PAREN = r"(?:\s*\([^)]{1,40}\))?"
DAYS = rf"(?<![\w,.])(?:\d+|{_ANY}){_PAREN}\s*(?:календарн\w*|рабоч\w*|банковск\w*|күнтізбелік|жұмыс|банктік)?\s*(?:дн(?:я|ей|и)\b|день\b|сут\w*|час\w*|күн\w*|сағат\w*)"
MONTHS = rf"(?:(?<![\w,.])(?:\d+|{_ANY}){_PAREN}\s*(?:месяц\w*|ай\b|айға|айды|айдан)|(?:(?<=за\s)|(?<=через\s))(?:месяц|ай)(?!\w))"
TERM_PREFIX = r"(?:за|не\s+(?:позднее|менее)\s+(?:чем\s+)?за|в\s+течение|не\s+позднее|по\s+истечении|через|кемінде|ішінде)\s*$"


def number(token: Column) -> Column:
    """A number or number word as a double, null if neither."""
    words = F.create_map(*[F.lit(x) for kv in WORDS.items() for x in kv])
    return F.coalesce(F.try_element_at(words, F.lower(token)).cast("double"), F.regexp_replace(token, ",", ".").try_cast("double"))


def leading(hit: Column) -> Column:
    return number(F.regexp_extract(hit, r"(?iuU)^(\d+(?:[.,]\d+)?|\w+)", 1))


def _valued(found: Column, value) -> Column:
    return F.transform(found, lambda s: F.struct(value(s).cast("double").alias("value"), s["start"].alias("start"), s["end"].alias("end")))


def percents(text: Column) -> Column:
    """Each percentage with its kind: cap, daily or fine; none without a penalty word."""
    daily = has(text, PER_DAY)

    def kind(s: Column) -> Column:
        around = F.concat(before(text, s["start"], 120), F.substring(text, s["start"] + 1, s["end"] - s["start"] + 120))
        cap = has(before(text, s["start"], 60), CAP_BEFORE) | has(after(text, s["end"], 25), CAP_AFTER)
        return F.when(cap, "cap").when(daily & has(around, PER_DAY), "daily").otherwise("fine")

    found = F.transform(spans(text, PERCENT), lambda s: F.struct(leading(s["hit"]).alias("value"), s["start"].alias("start"), s["end"].alias("end"), kind(s).alias("kind")))
    return F.when(has(text, PENALTY), found).otherwise(F.array().cast("array<struct<value:double,start:int,end:int,kind:string>>"))


def of_kind(found: Column, kind: str) -> Column:
    return F.transform(F.filter(found, lambda s: s["kind"] == kind), lambda s: F.struct(s["value"].alias("value"), s["start"].alias("start"), s["end"].alias("end")))


def durations(text: Column) -> Column:
    """Terms in days, in order of place; hours are parts of days, a month is 30."""
    days = _valued(spans(text, DAYS), lambda s: F.when(has(s["hit"], r"(?:час\w*|сағат\w*)$"), leading(s["hit"]) / 24).otherwise(leading(s["hit"])))
    months = _valued(spans(text, MONTHS), lambda s: F.lit(30.0) * F.when(has(s["hit"], r"^(?:месяц|ай)"), F.lit(1.0)).otherwise(leading(s["hit"])))
    return F.array_sort(F.concat(days, months), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))


def notices(text: Column, found: Column) -> Column:
    return F.filter(found, lambda s: has(before(text, s["start"], 30), r"(?:\bза|чем\s+за)\s*$") | has(after(text, s["end"], 12), r"^\s*бұрын"))


def terms(text: Column, found: Column) -> Column:
    return F.filter(found, lambda s: has(before(text, s["start"], 30), TERM_PREFIX) | has(after(text, s["end"], 10), r"^\s*ішінде"))


def extreme(found: Column, largest: bool) -> Column:
    """The span of the largest (or smallest) value, the first of equals; null without any."""
    best = F.array_max(F.transform(found, lambda s: s["value"])) if largest else F.array_min(F.transform(found, lambda s: s["value"]))
    return F.get(F.filter(found, lambda s: s["value"] == best), F.lit(0))


def months_amount(text: Column, found: Column) -> Column:
    """A payment counted in months."""
    kk = F.regexp_extract(text, r"(?iuU)(бір|екі|үш|алты|\d+)\s+айлық", 1)
    stems = "|".join(sorted(MONTH_ADJECTIVES, key=len, reverse=True))
    first = F.get(spans(text, rf"(?:{stems})\w*"), F.lit(0))
    stem = F.lower(F.regexp_extract(first["hit"], rf"(?iuU)^({stems})", 1))
    base = F.try_element_at(F.create_map(*[F.lit(x) for kv in MONTH_ADJECTIVES.items() for x in kv]), stem).cast("double")
    split = has(before(text, first["start"], 10), r"(?:двух|трех|трёх|шести)\s*$") & (base == 1)
    whole = F.get(F.filter(found, lambda s: (s["value"] >= 30) & (s["value"] % 30 == 0)), F.lit(0))["value"] / 30
    return F.when(F.length(kk) > 0, number(kk)).when(base.isNotNull(), F.when(~split, base)).otherwise(whole)
