"""Findings for a party: clause hits and document checks, one of a kind, in report order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.dims import TYPE_OF, counterparty, level_name, lookup
from clausewise.functions import numbers
from clausewise.functions.text import has
from clausewise.operators import parties, rules

LEAST_CLAUSES = 5
def analysable() -> Column:
    return (F.col("kind") == "clause") & (F.trim("text") != "")


def wording() -> Column:
    """128 bits that stand for what rules read of a clause: its text and language, and the contract's type."""
    return F.unhex(F.md5(F.concat_ws("\0", F.coalesce("contract_type", F.lit("\1")), F.coalesce("lang", F.lit("\1")), "text")))


def wordings(clauses: DataFrame) -> DataFrame:
    """Different wordings (text, lang, contract_type) of clauses, dealt to all cores: what clauses say in the same words is worked out once."""
    tasks = 3 * clauses.sparkSession.sparkContext.defaultParallelism
    return clauses.select("text", "lang", "contract_type").distinct().repartition(tasks)


def of_clauses(clauses: DataFrame, requests: DataFrame, chosen=rules.RULES) -> DataFrame:
    """clauses (doc_id, clause_id, clause_ord, text, lang, kind) for requests (doc_id, party_role): a row for each hit against the role.

    Clauses are read twice, for their wordings and for where these stand, so they had better be written before. Their files say little
    of their size in memory, so they are never sent to all.
    """
    asked = requests.withColumn("contract_type", lookup(TYPE_OF, F.col("party_role"))).where("contract_type is not null")
    usable = clauses.where(analysable()).hint("merge")
    types = asked.select("doc_id", "contract_type").distinct()
    found = rules.hits(wordings(usable.join(types, "doc_id")), chosen).select(wording().alias("wording"), "text", F.posexplode("hits").alias("hit_ord", "h"))
    quotes = F.transform("h.evidence", lambda s: F.struct(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]).alias("quote"), s["start"].alias("start"), s["end"].alias("end")))
    hits = found.select("wording", "hit_ord", "h.rule_id", "h.category", "h.level", F.lit("rule").alias("source"), F.lit(0.95).alias("confidence"), quotes.alias("evidence"), "h.details", "h.against")
    mine = usable.join(asked, "doc_id").select("doc_id", "party_role", "clause_id", "clause_ord", wording().alias("wording"))
    return mine.join(hits, "wording").where(F.array_contains("against", F.col("party_role"))).drop("wording", "against")


def dedupe(findings: DataFrame) -> DataFrame:
    """One finding of a document, role, clause and category: of the highest level, the first of equals. A null clause is a clause of its own."""
    w = Window.partitionBy("doc_id", "party_role", "clause_id", "category").orderBy(F.desc("level"), "hit_ord")
    return findings.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def of_documents(clauses: DataFrame, requests: DataFrame) -> DataFrame:
    """Checks of whole documents: force majeure missing, liability on one side only. Clauses are read three times (`of_clauses`)."""
    asked = requests.withColumn("contract_type", lookup(TYPE_OF, F.col("party_role")))
    usable = analysable()
    fm = has(F.col("text"), rules.FORCE_MAJEURE) | F.coalesce(has(F.col("section_title"), rules.FORCE_MAJEURE), F.lit(False))
    per = clauses.groupBy("doc_id").agg(F.count_if(usable).alias("n"), F.bool_or(fm).alias("fm")).where(F.col("n") >= LEAST_CLAUSES)
    missing = per.where("not fm").join(asked, "doc_id").select("doc_id", "party_role", F.lit("document.force_majeure_missing").alias("rule_id"), F.lit("force_majeure").alias("category"), F.lit(0.9).alias("confidence"), F.lit(None).cast("map<string,string>").alias("details"))
    t = F.col("text")
    money = (has(t, numbers.PENALTY) | has(t, rules.DAMAGES)) & ~has(t, rules.FORCE_MAJEURE) & ~has(t, rules.TERMINATION_CONTEXT) & ~has(t, rules.NOT_LIABLE_RU) & ~has(t, rules.NOT_LIABLE_KK)
    each = clauses.where(usable).hint("merge").join(asked, "doc_id")
    said = rules.held(wordings(each).where(money), mentions=parties.mentions(), mutual=parties.mutual())
    said = rules.held(said, payers=parties.payers()).select(wording().alias("wording"), "mutual", "payers")
    view = each.select("doc_id", "party_role", "clause_id", "clause_ord", wording().alias("wording")).join(said, "wording")
    me, other = F.array_contains("payers", F.col("party_role")), F.array_contains("payers", counterparty(F.col("party_role")))
    none = (F.size("payers") == 0) & F.col("mutual")
    sides = view.groupBy("doc_id", "party_role").agg(F.bool_or(me | none).alias("me"), F.bool_or(other | none).alias("other"), F.array_sort(F.collect_list(F.when(me, F.struct("clause_ord", "clause_id")))).alias("ids"))
    ids = F.array_join(F.transform("ids", lambda x: x["clause_id"]), ", ")
    uneven = sides.where("me and not other").join(per.select("doc_id"), "doc_id").select("doc_id", "party_role", F.lit("document.liability_one_sided").alias("rule_id"), F.lit("liability").alias("category"), F.lit(0.8).alias("confidence"), F.create_map(F.lit("user_clauses"), ids).alias("details"))
    both = missing.unionByName(uneven)
    return both.select("doc_id", "party_role", F.lit(None).cast("string").alias("clause_id"), F.lit(None).cast("int").alias("clause_ord"), F.lit(0).alias("hit_ord"), "rule_id", "category", F.lit(2).alias("level"), F.lit("document_rule").alias("source"), "confidence", F.expr("cast(array() as array<struct<quote:string,start:int,end:int>>)").alias("evidence"), "details")


def findings(clauses: DataFrame, requests: DataFrame) -> DataFrame:
    return dedupe(of_clauses(clauses, requests).unionByName(of_documents(clauses, requests)))


def ordered(found: DataFrame) -> DataFrame:
    """found with finding_ord: by level, a document's own findings first, then by clause."""
    w = Window.partitionBy("doc_id", "party_role").orderBy(F.desc("level"), F.col("clause_ord").isNotNull(), "clause_ord", "hit_ord", "category")
    return found.withColumn("finding_ord", F.row_number().over(w))


def verdict(found: DataFrame) -> DataFrame:
    """Counts by level for each document and role."""
    return found.groupBy("doc_id", "party_role").agg(*[F.count_if(F.col("level") == k).alias(n) for k, n in ((3, "high"), (2, "medium"), (1, "low"))])


def merged_spans(evidence: Column) -> Column:
    """Spans in order, overlapping and touching ones joined."""
    order = F.array_sort(F.transform(evidence, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = last.isNotNull() & (s["start"] <= last["end"])
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(order, F.array().cast("array<struct<start:int,end:int>>"), step)


__all__ = ["dedupe", "findings", "level_name", "merged_spans", "of_clauses", "of_documents", "ordered", "verdict"]
