"""Clauses assessed by a language model behind an interface: prompt, cache, reply, and which replies become findings.

A reply is a JSON object (is_risky, category, level, evidence_quote, explanation, safer_wording,
confidence), or {"refusal": true}. Each prompt is asked once: equal prompts are one call, and what the
cache has is none. Answers and refusals go to the cache, errors don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.dims import CATEGORIES, CATEGORY_TITLES, LEVELS, ROLE_TITLES, TYPE_OF, TYPE_TITLES, counterparty, lookup
from clausewise.operators.extraction import Backend, cache_key, called, place_of, recovered, redacted

SYSTEM = "Ты помогаешь малому бизнесу читать договоры. Оцени один пункт с точки зрения пользователя и ответь одним объектом JSON с ключами is_risky, category, level, evidence_quote, explanation, safer_wording, confidence. Цитата берётся из пункта дословно."
VERSION = "clause_1"
LEAST_CONFIDENCE = 0.5
ASSESSMENT = "is_risky boolean, category string, level string, evidence_quote string, explanation string, safer_wording string, confidence double, refusal boolean"
CACHE = "key string, model string, prompt_version string, payload string"


def message(references: Column | None = None) -> Column:
    """The prompt of a clause (clause_id, text, section_title, party_role); names and numbers of persons are masked."""
    role, other = F.col("party_role"), counterparty(F.col("party_role"))
    kind = lookup(TYPE_OF, role)
    text, _ = redacted(F.col("text"))
    lines = [
        F.concat(F.lit("Тип договора: "), lookup(TYPE_TITLES, kind), F.lit(" ("), kind, F.lit(").")),
        F.concat(F.lit("Роль пользователя: "), lookup(ROLE_TITLES, role), F.lit(" ("), role, F.lit("). Контрагент: "), lookup(ROLE_TITLES, other), F.lit(" ("), other, F.lit(").")),
        F.concat(F.lit("Раздел договора: "), F.col("section_title")),
        F.lit(""),
        F.concat(F.lit("Пункт "), F.col("clause_id"), F.lit(":")),
        F.concat(F.lit("«"), text, F.lit("»")),
    ]
    if references is not None:
        some = F.size(references) > 0
        lines += [F.when(some, ""), F.when(some, "Как похожие условия обычно звучат на рынке (нейтральные эталоны):")]
        lines += [F.when(some, F.array_join(F.transform(references, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". «"), r, F.lit("»"))), "\n"))]
    return F.concat_ws("\n", *lines)


def assessed(clauses: DataFrame, backend: Backend, model: str, cache: DataFrame, keep, references: str | None = None, calls: int | None = None) -> tuple[DataFrame, DataFrame]:
    """clauses with assessment, cached, error; and the rows that the cache gains. keep() writes rows and reads them back, so that no call is made twice.

    calls: how many calls may run at once (as many partitions), if the model's owner sets a limit.
    """
    asked = clauses.withColumn("prompt", message(F.col(references) if references else None))
    asked = asked.withColumn("key", cache_key(F.lit(model), F.lit(VERSION), F.lit(SYSTEM), F.col("prompt")))
    known = cache.groupBy("key").agg(F.max("payload").alias("payload"))
    misses = asked.select("key", "prompt").distinct().join(known, "key", "left_anti")
    replies = keep(called(misses.repartition(calls) if calls else misses, backend))
    fresh = replies.select("key", recovered(F.col("reply")).alias("payload"), "error")
    gained = fresh.where("error is null and payload is not null").select("key", F.lit(model).alias("model"), F.lit(VERSION).alias("prompt_version"), "payload")
    answers = known.select("key", "payload", F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached")).unionByName(fresh.withColumn("cached", F.lit(False)))
    return asked.join(answers, "key", "left").withColumn("assessment", F.from_json("payload", ASSESSMENT)), gained


def disposition() -> Column:
    """What becomes of an assessment; `accepted` is a finding."""
    a = F.col("assessment")
    return (
        F.when(F.col("error").isNotNull(), "error")
        .when(a.isNull() | F.coalesce(a["refusal"], F.lit(False)), "refusal")
        .when(~F.coalesce(a["is_risky"], F.lit(False)), "not_risky")
        .when(~F.coalesce(a["category"].isin(*CATEGORIES) & a["level"].isin(*LEVELS.values()), F.lit(False)), "rejected_invalid")
        .when(F.coalesce(F.least(F.greatest(a["confidence"], F.lit(0.0)), F.lit(1.0)), F.lit(0.0)) < LEAST_CONFIDENCE, "low_confidence")
        .when(F.col("place").isNull(), "rejected_ungrounded")
        .otherwise("accepted")
    )


def judged(answers: DataFrame) -> DataFrame:
    """Assessed clauses with the place of their quote, and their disposition."""
    return answers.withColumn("place", place_of(F.col("assessment.evidence_quote"), F.col("text"))).withColumn("disposition", disposition())


def findings_of(answers: DataFrame, model: str) -> DataFrame:
    ranks = {n: k for k, n in LEVELS.items()}
    a = F.col("assessment")
    details = {"model": F.lit(model), "prompt_version": F.lit(VERSION), "cached": F.col("cached").cast("string"), "explanation": F.concat(F.trim(a["explanation"]), F.lit(" (Оценка языковой модели по цитате из пункта.)")), "safer_wording": a["safer_wording"]}
    known = F.map_filter(F.create_map(*[x for k, v in details.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    ok = answers.where("disposition = 'accepted'")
    return ok.select(
        "doc_id", "party_role", "clause_id", "clause_ord", F.lit(0).alias("hit_ord"), F.lit(None).cast("string").alias("rule_id"), a["category"].alias("category"), lookup(ranks, a["level"]).alias("level"), F.lit("llm").alias("source"),
        F.bround(F.least(F.greatest(a["confidence"], F.lit(0.0)), F.lit(1.0)), 3).alias("confidence"), F.array("place").alias("evidence"), known.alias("details"),
    )


def counters(answers: DataFrame, stands_for: str | None = None) -> DataFrame:
    """How many assessments met which end, and how many came from the cache. stands_for: a column that says for how many equal clauses a row stands."""
    n = F.lit(1).cast("long") if stands_for is None else F.col(stands_for)
    return answers.groupBy("disposition").agg(F.sum(n).alias("clauses"), F.sum(F.when(F.col("cached"), n).otherwise(0)).alias("cached"))


__all__ = ["CATEGORY_TITLES", "assessed", "counters", "disposition", "findings_of", "judged", "message"]
