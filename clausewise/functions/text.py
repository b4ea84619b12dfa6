"""Text columns: spans of a pattern, windows, normalisation, language, contract type."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Python's `re` is Unicode for both \\w and case; Java's needs these flags.
FLAGS = "(?iuU)"
SPAN = "array<struct<start:int,end:int,hit:string>>"

# Letters of the Kazakh alphabet that Russian lacks; thresholds of a document and a clause.
KAZAKH = "әғқңөұүһіӘҒҚҢӨҰҮҺІ"
DOCUMENT_SHARE, CLAUSE_SHARE = 0.02, 0.03
LOWER = "а-яёәғқңөұүһіa-z"

# Words that speak for a type of contract, in order of precedence.
TYPE_WORDS = {
    "lease": [r"аренд", r"имущественн\w*\s+найм", r"наймодател", r"нанимател", r"жалға", r"жалдау"],
    "supply": [r"поставк", r"поставщик", r"жеткіз", r"өнім\s+беруш"],
    "works": [r"подряд", r"оказани\w*\s+услуг", r"исполнител", r"мердігер", r"қызмет\w*\s+көрсет", r"орындаушы"],
}


def has(text: Column, pattern: str) -> Column:
    return text.rlike(FLAGS + pattern)


def spans(text: Column, pattern: str) -> Column:
    """Offsets (0-based, half-open, in code points) of a pattern's matches; the pattern never matches nothing."""
    hits = F.regexp_extract_all(text, F.lit(FLAGS + pattern), F.lit(0))
    # a pattern of replace is compiled once, one of split for every row: hits become one sign, at which the text is split
    gaps = F.split(F.regexp_replace(F.translate(text, "\uffff", "\ufffe"), FLAGS + pattern, "\uffff"), "\uffff", -1)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit")))).alias("out"))

    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
    none = F.lit(None).cast(SPAN)
    empty = F.array().cast(SPAN)
    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.isNull(), none).when(F.size(hits) <= 0, empty).otherwise(found)


def before(text: Column, start: Column, n: int) -> Column:
    return F.substring(text, F.greatest(start - n, F.lit(0)) + 1, F.least(F.lit(n), start))


def after(text: Column, end: Column, n: int) -> Column:
    return F.substring(text, end + 1, F.lit(n))


def nfc(text: Column) -> Column:
    """Canonical composition, which Spark has no function for."""

    @F.pandas_udf("string")
    def composed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return composed(text)


PAGE_LINE = r"^(?:(?:стр(?:аница)?|бет)\.?\s*\d+(?:\s*(?:из|/)\s*\d+)?|[-–—]\s*\d{1,3}\s*[-–—]|\d{1,3}\s*(?:из|/)\s*\d{1,3}|\d{1,3}\s*[-‐]\s*бет)$"


def normalized(text: Column, compose: bool = True) -> Column:
    """Composed, invisible characters gone, words broken over lines joined, page numbers dropped, lines trimmed."""
    t = nfc(text) if compose else text
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[\u200B-\u200D\u2060\uFEFF\u00AD]", "")
    t = F.regexp_replace(t, "[    \t]", " ")
    t = F.regexp_replace(t, f"([{LOWER}])-\n([{LOWER}])", "$1$2")
    lines = F.transform(F.split(t, "\n", -1), lambda x: F.trim(F.regexp_replace(x, " {2,}", " ")))
    t = F.array_join(F.filter(lines, lambda x: ~has(x, PAGE_LINE)), "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return F.when(t == "", "").otherwise(F.concat(t, F.lit("\n")))


def letter_share(text: Column, special: str, alphabet: str = r"[Ѐ-ӿ&&\p{L}]") -> Column:
    """Share of some letters among an alphabet's, 0 without any."""
    return F.coalesce(F.try_divide(F.regexp_count(text, F.lit(f"[{special}]")).cast("double"), F.regexp_count(text, F.lit(alphabet))), F.lit(0.0))


def language(text: Column, least: float = DOCUMENT_SHARE) -> Column:
    many = F.regexp_count(text, F.lit(f"[{KAZAKH}]")) >= 2
    return F.when(many & (letter_share(text, KAZAKH) >= least), "kk").otherwise("ru")


def type_scores(text: Column, title: Column | None = None, words: dict[str, list[str]] = TYPE_WORDS) -> dict[str, Column]:
    """Words of each type in the first 3,000 characters, and five times those in the title."""
    head = F.substring(text, 1, 3000)

    def count(where: Column, patterns: list[str]) -> Column:
        return sum((F.regexp_count(where, F.lit(FLAGS + p)) for p in patterns), F.lit(0))

    return {k: count(head, ps) + (5 * F.coalesce(count(title, ps), F.lit(0)) if title is not None else 0) for k, ps in words.items()}


def best_type(scores: dict[str, Column]) -> Column:
    """The type of the highest score, the first of equals; null at zero."""
    top = F.greatest(*scores.values())
    out = F.when(top <= 0, F.lit(None).cast("string"))
    for k, s in scores.items():
        out = out.when(s == top, k)
    return out


def without_repeated_lines(lines: DataFrame, share: float = 0.5) -> DataFrame:
    """lines: (doc_id, page_no, line_no, line). Drops headers and footers: short lines on most pages of a document of three pages or more."""
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page_no").alias("pages"))
    on = lines.withColumn("key", F.trim("line")).where("key <> ''").groupBy("doc_id", "key").agg(F.count_distinct("page_no").alias("n"))
    often = on.join(pages, "doc_id").where((F.col("pages") >= 3) & (F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("pages") * share + 0.5))) & (F.length("key") <= 100)).select("doc_id", "key")
    return lines.withColumn("key", F.trim("line")).join(often, ["doc_id", "key"], "left_anti").drop("key")


def page_starts(pages: DataFrame) -> DataFrame:
    """pages: (doc_id, page_no, text). Adds where each page starts in the text of pages joined by a newline."""
    w = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("int"))


def page_of(starts: Column, offset: Column) -> Column:
    return F.size(F.filter(starts, lambda p: p <= offset))


def signature(text: Column) -> Column:
    """A wording without its numbers."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, r"\d+(?:[.,]\d+)?", "#")), r"\s+", " "))
