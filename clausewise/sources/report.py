"""HTML reports: a verdict, the findings in order, and clause texts with the evidence marked."""

from __future__ import annotations

from collections.abc import Iterator
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.operators.explain import DISCLAIMER, told
from clausewise.operators.findings import merged_spans


def marked(text: str, spans) -> str:
    out, at = [], 0
    for s in spans:
        out += [escape(text[at : s["start"]]), "<mark>", escape(text[s["start"] : s["end"]]), "</mark>"]
        at = s["end"]
    return "".join([*out, escape(text[at:])])


NAMES = {3: "high", 2: "medium", 1: "low"}


def card(f) -> str:
    """A finding: what, why, the clause with its evidence marked, and what to do."""
    told = [f"<p>{escape(f[k])}</p>" for k in ("explanation", "advice") if f[k]]
    told += [f"<p class={k}>{escape(f[k])}</p>" for k in ("safer_wording", "legal_basis") if f[k]]
    quote = f"<blockquote>{marked(f['clause_text'], f['spans'])}</blockquote>" if f["clause_text"] else ""
    where = f" ({escape(f['clause_id'])})" if f["clause_id"] else ""
    return f"<section id=\"f{f['finding_ord']}\"><h2>{escape(f['title'] or f['rule_id'])}{where}: {NAMES[f['level']]}</h2>{quote}{''.join(told)}</section>"


def html(found: DataFrame, clauses: DataFrame) -> DataFrame:
    """found: findings with finding_ord. (doc_id, party_role, html): the counts, the three first findings of the highest level, then all.

    Findings move as they are and are explained where they have come together. Clauses read from files may
    be far larger in memory, so they are never sent to all through the driver.
    """
    texts = clauses.select("doc_id", "clause_id", F.col("text").alias("clause_text")).hint("merge")
    cards = found.withColumn("spans", merged_spans(F.col("evidence"))).join(texts, ["doc_id", "clause_id"], "left")
    moved = F.struct("finding_ord", "level", "rule_id", "category", "source", "confidence", F.map_entries("details").alias("details"), "clause_id", "clause_text", "spans")
    all_ = cards.groupBy("doc_id", "party_role").agg(F.array_sort(F.collect_list(moved)).alias("f"))

    def shown(x: Column) -> Column:
        texts = told(lambda c: F.map_from_entries(x["details"]) if c == "details" else x[c])
        return F.struct(*[x[c].alias(c) for c in ("finding_ord", "level", "rule_id")], *texts, *[x[c].alias(c) for c in ("clause_id", "clause_text", "spans")])

    per = all_.select("doc_id", "party_role", F.transform("f", shown).alias("f"))

    @F.pandas_udf("string")
    def page(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for roles, all_ in it:
            out = []
            for role, own in zip(roles, all_, strict=True):
                counts = ", ".join(f"{sum(f['level'] == k for f in own)} {n}" for k, n in NAMES.items())
                first = "".join(f"<li><a href=\"#f{f['finding_ord']}\">{escape(f['title'] or f['rule_id'])}</a></li>" for f in [f for f in own if f["level"] == 3][:3])
                out.append(f"<!DOCTYPE html><meta charset=utf-8><h1>Risks for {escape(role)}</h1><p>{counts}</p>{'<ol>' + first + '</ol>' if first else ''}{''.join(map(card, own))}<footer>{escape(DISCLAIMER)}</footer>")
            yield pd.Series(out, dtype=object)

    return per.select("doc_id", "party_role", page("party_role", "f").alias("html"))
