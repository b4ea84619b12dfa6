"""A whole analysis: documents and roles to reports of one row each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.dims import DEFAULT_ROLE, ROLE_TITLES, TYPE_OF, TYPE_TITLES, lookup
from clausewise.functions.text import best_type, type_scores
from clausewise.operators import findings, segment
from clausewise.operators.compare import compared
from clausewise.operators.explain import DISCLAIMER, explained

VERSION = "1"


def default_role(contract_type: Column) -> Column:
    """The side that a small business mostly takes."""
    return lookup(DEFAULT_ROLE, contract_type)


def parsed(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text) without their text, with title, warnings and the detected contract type, and their clauses as an array."""
    s = segment.segmented_by_form(documents.withColumn("__head", F.substring("text", 1, 3000))).withColumnsRenamed({"__title": "title", "__warnings": "warnings"})
    return s.withColumn("detected_type", best_type(type_scores(F.col("__head"), F.col("title")))).drop("__head")


def warnings(detected: Column, role: Column, analysable: Column, no_model: bool) -> Column:
    """What the reader is warned of, beside what reading the document said."""
    expected = lookup(TYPE_OF, role)
    mismatch = F.concat(F.lit("Похоже, это договор типа «"), lookup(TYPE_TITLES, detected), F.lit("», а выбрана роль «"), lookup(ROLE_TITLES, role), F.lit("». Проверьте, что роль указана верно."))
    return F.array_compact(
        F.array(
            F.when(detected != expected, mismatch),
            F.when(analysable == 0, "В документе не найдено ни одного пункта договора для анализа."),
            F.lit("Проверка языковой моделью выключена: показаны только условия, распознанные правилами.") if no_model else F.lit(None).cast("string"),
        )
    )


def reports(documents: DataFrame, requests: DataFrame, keep, detect: Callable[[DataFrame, DataFrame], DataFrame] = findings.findings, references: DataFrame | None = None, detector: str = "rules", no_model: bool = False) -> DataFrame:
    """documents (doc_id, text), requests (doc_id, party_role): a report a request.

    keep() writes clauses and findings and reads them back: several parts of a report need them. The
    contract's type is that of the role, whatever the text looks like. Files say little of how large rows
    are in memory (a contract's words repeat), so what is read back is never sent to all through the driver.
    """
    read = keep(parsed(documents.select("doc_id", "text")))  # segmented once
    clauses = segment.of_segmented(read, ["doc_id"])
    found = keep(explained(findings.ordered(detect(clauses, requests))))
    if references is not None:
        found = with_comparison(found, clauses, references)
    counts = clauses.groupBy("doc_id").agg(F.count("*").alias("clauses_total"), F.count_if(findings.analysable()).alias("clauses_analysed"))
    texts = F.transform("__clauses", lambda c: F.struct(c["id"].alias("clause_id"), c["text"].alias("clause_text")))
    whole = read.select("doc_id", "title", "warnings", "detected_type", texts.alias("texts")).hint("merge")
    seen = whole.join(segment.document_language(clauses), "doc_id", "left").join(counts.hint("merge"), "doc_id", "left")
    card = [c for c in found.columns if c not in ("doc_id", "party_role")]
    own = found.groupBy("doc_id", "party_role").agg(
        F.array_sort(F.collect_list(F.struct("finding_ord", *[F.map_entries(c).alias(c) if c == "details" else F.col(c) for c in card if c != "finding_ord"]))).alias("findings"),
        F.collect_set("clause_id").alias("ids"),
        *[F.count_if(F.col("level") == k).alias(n) for k, n in ((3, "high"), (2, "medium"), (1, "low"))],
    )
    r = requests.join(seen.hint("merge"), "doc_id").join(own.hint("merge"), ["doc_id", "party_role"], "left")
    quoted = F.when(F.col("ids").isNotNull(), F.map_from_entries(F.filter("texts", lambda t: F.array_contains("ids", t["clause_id"]) & t["clause_text"].isNotNull())))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("clauses_total", "clauses_analysed", "high", "medium", "low")}
    told = F.concat(F.col("warnings"), warnings(F.col("detected_type"), F.col("party_role"), zero["clauses_analysed"], no_model))
    return r.select(
        "doc_id", "title", lookup(TYPE_OF, F.col("party_role")).alias("contract_type"), "party_role", F.coalesce("language", F.lit("ru")).alias("language"), F.lit(detector).alias("detector"), F.lit(VERSION).alias("pipeline_version"),
        *[c.alias(n) for n, c in zero.items()], verdict(zero["high"], zero["medium"], zero["low"]).alias("verdict"), told.alias("warnings"), "findings", quoted.alias("clause_texts"), F.lit(DISCLAIMER).alias("disclaimer"),
    )


def verdict(high: Column, medium: Column, low: Column) -> Column:
    return F.when(high > 0, "Подписывать в таком виде не стоит").when(medium > 0, "Есть что обсудить до подписания").when(low > 0, "Существенных рисков не найдено, есть что знать").otherwise("Рискованных условий не найдено")


def with_comparison(found: DataFrame, clauses: DataFrame, references: DataFrame) -> DataFrame:
    """Findings with comparison: references of the same kind and what differs."""
    key = F.concat_ws("|", F.col("doc_id").cast("string"), "party_role", F.col("finding_ord").cast("string"))
    own = found.withColumn("finding_id", key)
    texts = clauses.select("doc_id", "clause_id", "text", "lang").hint("merge")
    asked = own.join(texts, ["doc_id", "clause_id"], "left").select("finding_id", lookup(TYPE_OF, F.col("party_role")).alias("contract_type"), "category", F.coalesce("lang", F.lit("ru")).alias("lang"), "party_role", F.coalesce("text", F.lit("")).alias("text"), F.col("clause_id").isNull().alias("whole"))
    return own.join(compared(asked, references), "finding_id", "left").drop("finding_id")


def top(found: DataFrame, n: int = 3) -> DataFrame:
    """The first n findings of the highest level of each request."""
    return found.where((F.col("level") == 3)).where(F.col("finding_ord") <= n)


def json(report: DataFrame) -> DataFrame:
    """(doc_id, party_role, json)."""
    return report.select("doc_id", "party_role", F.to_json(F.struct("*")).alias("json"))
