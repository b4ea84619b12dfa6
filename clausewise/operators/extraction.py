"""Field extraction: recovering JSON, checking it, comparing with gold, and the calls to a model behind an interface."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

class Field(NamedTuple):
    """What a field of a record may hold: its type, bounds (least excluded if `above`), the values to choose from, whether null is allowed."""

    type: str
    least: float | None = None
    most: float | None = None
    above: bool = False
    choice: tuple[str, ...] = ()
    nullable: bool = True


# The fields of a record, their choices and bounds, in order; parties come fifth.
ROLES = ("landlord", "tenant", "supplier", "buyer", "contractor", "customer")
FIELDS = {
    "contract_type": Field("string", choice=("lease", "supply", "works"), nullable=False), "contract_number": Field("string"), "contract_date": Field("date"), "city": Field("string"), "term_months": Field("int", 1, 600), "auto_renewal": Field("boolean", nullable=False),
    "price_amount": Field("double", 0, above=True), "price_period": Field("string", choice=("monthly", "total")), "payment_deadline_days": Field("int", 0, 365), "payment_penalty_rate_percent_per_day": Field("double", 0, 100),
    "payment_penalty_cap_percent": Field("double", 0, 1000), "dispute_forum": Field("string", choice=("kz_courts", "counterparty_location_court", "aifc_court", "foreign_arbitration")), "termination_notice_days": Field("int", 0, 365),
}
PARTY = {"role": Field("string", choice=ROLES, nullable=False), "name": Field("string", nullable=False), "bin": Field("string")}
YEARS = (2000, 2100)
PARTIES = 2
#: Faults that are reported.
MOST_FAULTS = 12


def recovered(reply: Column) -> Column:
    """The JSON object in a reply: from its first brace to its last, fences gone; null without one."""
    t = F.regexp_replace(reply, r"(?m)^\s*```\w*\s*$", "")
    a, z = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
    return F.when((a > 0) & (z > a) & t.contains("}"), F.substring(t, a, z - a + 1))


def raw_of(of: Column, key: str) -> Column:
    """The raw value of a key as a variant; null if the key is missing, a variant of type VOID if it is null."""
    return F.try_variant_get(of, f"$['{key}']", "variant")


def kind_of(raw: Column) -> Column:
    """NULL for a missing key, else VOID, BOOLEAN, BIGINT, DECIMAL, DOUBLE, STRING, OBJECT, ARRAY."""
    return F.regexp_extract(F.schema_of_variant(raw), r"^(\w+)", 1)


def typed(raw: Column, type_: str) -> Column:
    """A raw value as a type; null unless it is of it. Numbers and truth values may also be written as strings, whole numbers as 12.0, truth values as 0 and 1."""
    kind = kind_of(raw)
    said = F.trim(F.try_variant_get(raw, "$", "string"))
    plain = kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN")
    number = F.when(kind == "BOOLEAN", F.try_variant_get(raw, "$", "boolean").cast("double")).when(plain | ((kind == "STRING") & said.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")), said.try_cast("double"))
    if type_ == "string":
        return F.when(kind == "STRING", F.try_variant_get(raw, "$", "string"))
    if type_ == "double":
        return number
    if type_ == "int":
        return F.when((number == F.floor(number)) & (F.abs(number) < 2.0**31) & ~((kind == "STRING") & said.rlike("[eE]")), number.cast("int"))
    if type_ == "date":
        return F.when((kind == "STRING") & said.rlike(r"^\d{4}-\d{2}-\d{2}(T00:00(:00)?)?$"), F.substring(said, 1, 10).try_cast("date"))
    word = F.lower(said)
    return F.when(word.isin("true", "t", "yes", "y", "on", "1", "1.0"), True).when(word.isin("false", "f", "no", "n", "off", "0", "0.0"), False)


def broken(path: Column, raw: Column, value: Column, field: Field, required: bool = True) -> Column:
    """What is wrong with a field (path: what), null if nothing is."""
    say = lambda what: F.concat(path, F.lit(f": {what}"))
    out = F.when(raw.isNull(), say("missing") if required else F.lit(None))
    out = out.when(kind_of(raw) == "VOID", F.lit(None) if field.nullable else say("null"))
    out = out.when(value.isNull(), say(f"not a {field.type}"))
    if field.choice:
        out = out.when(~value.isin(*field.choice), say("not one of its choices"))
    if field.least is not None:
        out = out.when((value <= field.least) if field.above else (value < field.least), say("too small"))
    if field.most is not None:
        out = out.when(value > field.most, say("too large"))
    if field.type == "date":
        out = out.when(~F.year(value).between(*YEARS), say("out of years"))
    return out


def keys_of(raw: Column) -> Column:
    return F.coalesce(F.map_keys(F.try_variant_get(raw, "$", "map<string,variant>")), F.array().cast("array<string>"))


def checked(rows: DataFrame) -> DataFrame:
    """rows (reply) with json, record (typed; of use without faults only) and faults, at most the first twelve, in the order of the fields.

    A raw value's own type is looked at before it is cast, so "abc" is no number, "1 мая" no date and an
    unknown key no detail. A key that occurs twice makes the whole reply no JSON.
    """
    own = list(rows.columns)
    parsed = rows.withColumn("json", recovered(F.col("reply"))).withColumn("__v", F.try_parse_json("json"))
    raws = parsed.select("*", F.explode(F.array(F.struct(*[raw_of(F.col("__v"), f).alias(f) for f in [*FIELDS, "parties"]], keys_of(F.col("__v")).alias("__keys")))).alias("__raw"))
    raw = lambda f: F.col("__raw").getField(f)
    party = lambda p: F.struct(*[typed(raw_of(p, f), spec.type).alias(f) for f, spec in PARTY.items()])
    listed = F.when(kind_of(raw("parties")) == "ARRAY", F.try_variant_get(raw("parties"), "$", "array<variant>"))
    valued = raws.select("*", F.explode(F.array(F.struct(*[typed(raw(f), spec.type).alias(f) for f, spec in FIELDS.items()], F.transform(listed, party).alias("parties")))).alias("record"))
    record = F.col("record")

    def of_party(p: Column, i: Column) -> Column:
        at = lambda f: F.concat(F.lit("parties."), i.cast("string"), F.lit(f".{f}"))
        value = {f: typed(raw_of(p, f), spec.type) for f, spec in PARTY.items()}
        found = [broken(at(f), raw_of(p, f), value[f], spec, required=f != "bin") for f, spec in PARTY.items()]
        found[1] = F.coalesce(found[1], F.when(F.length(value["name"]) < 2, F.concat(at("name"), F.lit(": too short"))))
        found[2] = F.coalesce(found[2], F.when(~value["bin"].rlike(r"^\d{12}$"), F.concat(at("bin"), F.lit(": not twelve digits"))))
        unknown = F.transform(F.array_except(keys_of(p), F.array(*map(F.lit, PARTY))), lambda k: F.concat(F.lit("parties."), i.cast("string"), F.lit("."), k, F.lit(": unknown")))
        return F.when(kind_of(p) == "OBJECT", F.concat(F.array_compact(F.array(*found)), F.array_sort(unknown))).otherwise(F.array(F.concat(F.lit("parties."), i.cast("string"), F.lit(": not an object"))))

    checks = [broken(F.lit(f), raw(f), record[f], spec) for f, spec in FIELDS.items()]
    at = list(FIELDS).index("price_period")
    checks[at] = F.coalesce(checks[at], F.when(record["price_period"].isNotNull() & record["price_amount"].isNull(), "price_period: without amount"))
    each = F.flatten(F.transform(listed, of_party))
    of_list = F.when(raw("parties").isNull(), F.array(F.lit("parties: missing"))).when(listed.isNull(), F.array(F.lit("parties: not a list"))).otherwise(
        F.concat(each, F.when(F.size(listed) != PARTIES, F.array(F.lit("parties: not two"))).when((F.size(each) == 0) & (record["parties"][0]["role"] == record["parties"][1]["role"]), F.array(F.lit("parties: one role"))).otherwise(F.array().cast("array<string>")))
    )
    unknown = F.transform(F.array_sort(F.array_except(raw("__keys"), F.array(*map(F.lit, [*FIELDS, "parties"])))), lambda k: F.concat(k, F.lit(": unknown")))
    before_, after_ = (F.array_compact(F.array(*part)) for part in (checks[:4], checks[4:]))
    found = F.when(F.col("__v").isNull(), F.array(F.lit("json"))).otherwise(F.slice(F.concat(before_, of_list, after_, unknown), 1, MOST_FAULTS))
    return valued.select(*own, "json", record, found.alias("faults"))


class Backend(Protocol):
    """A model: prompts in, replies out. Raises ConnectionError where the model can't be reached."""

    def complete(self, prompt: str) -> str: ...


@dataclass
class Mock:
    """Replies by a function; for tests and dry runs."""

    reply: Callable[[str], str]

    def complete(self, prompt: str) -> str:
        return self.reply(prompt)


def called(rows: DataFrame, backend: Backend, prompt: str = "prompt") -> DataFrame:
    """rows with reply and error. Calls run by partition; write the result before reading it twice, or the calls run twice."""

    @F.pandas_udf("reply string, error string")
    def call(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in it:
            out = []
            for p in prompts:
                try:
                    out.append((backend.complete(p), None))
                except ConnectionError as e:
                    out.append((None, str(e)))
            yield pd.DataFrame(out, columns=["reply", "error"])

    return rows.withColumn("__c", call(prompt)).select(*rows.columns, "__c.reply", "__c.error")


def extract(texts: DataFrame, backend: Backend, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """texts (doc_id, prompt): record, status and attempts. One retry with what was wrong. keep() writes a pass and reads it back."""
    first = keep(checked(called(texts.select("doc_id", "prompt"), backend)))
    down, good = F.col("error").isNotNull(), F.size("faults") == 0
    again = first.where(~down & ~good).withColumn("prompt", F.concat_ws("\n", "prompt", "reply", F.array_join("faults", "; "))).select("doc_id", "prompt")
    second = keep(checked(called(again, backend)))
    status = lambda ok: F.when(F.col("error").isNotNull(), "backend_error").when(F.size("faults") == 0, ok).otherwise("failed")
    a = first.where(down | good).select("doc_id", F.when(good, F.col("record")).alias("record"), status("ok_first_try").alias("status"), F.lit(1).alias("attempts"))
    b = second.select("doc_id", F.when(good, F.col("record")).alias("record"), status("ok_after_retry").alias("status"), F.lit(2).alias("attempts"))
    return a.unionByName(b)


def cache_key(model: Column, version: Column, system: Column, user: Column) -> Column:
    return F.sha2(F.concat(*[x for c in (model, version, system, user) for x in (c, F.lit("\0"))]), 256)


def party_name(name: Column) -> Column:
    """A name without its legal form, quotes and punctuation."""
    t = F.regexp_replace(F.lower(name), r"(?iuU)\b(?:тоо|ао|ип|ооо|зао|жшс|ақ|жк|llp|llc|jsc)\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?U)[^\w\s]", " "), r"\s+", " "))


def outcome(gold: Column, got: Column, failed: Column, kind: str = "string") -> Column:
    same = F.abs(gold - got) <= 1e-9 if kind == "double" else F.lower(F.trim(gold)) == F.lower(F.trim(got)) if kind == "string" else gold == got
    return F.when(failed, "failed").when(gold.isNull() & got.isNull(), "correct").when(gold.isNull(), "hallucinated").when(got.isNull(), "missed").when(same, "correct").otherwise("wrong")


def rates(outcomes: DataFrame) -> DataFrame:
    """outcomes (outcome, empty: gold has no value): shares of hallucinated, missed and right fields; failed records stay in all denominators."""
    n = {c: F.count_if(x).cast("double") for c, x in (("empty", F.col("empty")), ("full", ~F.col("empty")), ("all", F.lit(True)))}
    share = {"hallucinated": ("hallucinated", "empty"), "missed": ("missed", "full"), "accuracy": ("correct", "all")}
    return outcomes.agg(*[F.round(F.try_divide(F.count_if(F.col("outcome") == o), n[d]), 6).alias(k) for k, (o, d) in share.items()])


def same_parties(gold: Column, got: Column) -> Column:
    """Whether parties agree as sets of role, normalised name and number."""
    def key(ps: Column) -> Column:
        return F.array_sort(F.array_distinct(F.transform(ps, lambda p: F.concat_ws("|", p["role"], party_name(p["name"]), F.coalesce(p["bin"], F.lit(""))))))

    return key(gold) == key(got)


def batch_totals(results: DataFrame) -> DataFrame:
    """results (status, input_tokens, output_tokens): how many, how many valid, and tokens."""
    return results.agg(F.count("*").alias("count"), F.count_if(F.col("status").startswith("ok")).alias("ok"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))


def disputed(outcomes: DataFrame, models: list[str]) -> DataFrame:
    """outcomes (doc_id, field, model, outcome, value): fields that one of the strong models got wrong, with what each said."""
    wrong = outcomes.where(F.col("model").isin(*models) & (F.col("outcome") != "correct"))
    return wrong.groupBy("doc_id", "field").agg(F.array_sort(F.collect_list(F.struct("model", "outcome", "value"))).alias("said"))


def overridden(draft: DataFrame, overrides: DataFrame, fields: list[str]) -> DataFrame:
    """Draft records with the values that a reader has set (doc_id, field, value) in their place."""
    set_ = overrides.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("value")))).alias("__set"))
    def value(f: str) -> Column:
        said = F.try_element_at("__set", F.lit(f))
        return F.when(said.isNotNull(), said["value"].cast(dict(draft.dtypes)[f])).otherwise(F.col(f)).alias(f)

    return draft.join(set_, "doc_id", "left").select(*[value(c) if c in fields else F.col(c) for c in draft.columns])


def oracle(records: dict[str, str], broken_every: int = 4) -> Mock:
    """A model that knows the answer to each prompt, and breaks every n-th first reply (by its hash); a prompt with a retry gets the answer."""
    import zlib

    def reply(prompt: str) -> str:
        known = next((a for p, a in records.items() if prompt.startswith(p)), "")
        first = prompt in records
        return "not json" if first and zlib.crc32(prompt.encode()) % broken_every == 0 else known

    return Mock(reply)


# What is masked, in this order: three forms of a person's name, accounts, identifiers, mail, telephones.
_UP, _LOW = "А-ЯЁӘҒҚҢӨҰҮҺІ", "а-яёәғқңөұүһі"
_FAMILY = rf"[{_UP}][{_LOW}]+(?:-[{_UP}][{_LOW}]+)?"
_INITIALS = rf"[{_UP}]\.\s?[{_UP}]\.?"
_PATRONYMIC = rf"[{_UP}][{_LOW}]+(?:ович|евич|ич|овна|евна|ична|инична|ұлы|улы|қызы|кызы)"
MASKS = (
    (rf"(?<![{_UP}{_LOW}]){_FAMILY}\s+{_INITIALS}(?![{_LOW}])", "[ФИО]"),
    (rf"(?<![{_UP}{_LOW}.]){_INITIALS}\s?{_FAMILY}(?![{_LOW}])", "[ФИО]"),
    (rf"{_FAMILY}\s+[{_UP}][{_LOW}]+\s+{_PATRONYMIC}(?![{_LOW}])", "[ФИО]"),
    (r"\bKZ\d{2}(?:\s?[A-Z0-9]{4}){4}\b", "[IBAN]"),
    (r"(?<!\d)\d{12}(?!\d)", "[ИИН/БИН]"),
    (r"[\w.+-]+@[\w-]+\.[\w.-]+", "[EMAIL]"),
    (r"(?<!\d)(?:\+7|8)[\s(-]*\d{3}[\s)-]*\d{3}[\s-]*\d{2}[\s-]*\d{2}(?!\d)", "[ТЕЛЕФОН]"),
)


def redacted(text: Column) -> tuple[Column, Column]:
    """The text with names and identifiers masked, and how many there were; each pattern sees what those before it left."""
    n = F.lit(0)
    for pattern, mask in MASKS:
        n = n + F.regexp_count(text, F.lit("(?U)" + pattern))
        text = F.regexp_replace(text, "(?U)" + pattern, mask)
    return text, n


def folded(text: Column) -> Column:
    t = F.regexp_replace(F.lower(text), "[«»“”„\"']", "'")
    return F.trim(F.regexp_replace(F.translate(t, "ё", "е"), r"\s+", " "))


def grounded(quote: Column, text: Column) -> Column:
    """Whether a quote of three characters or more stands in a text, quotes, case and white space aside."""
    q = F.regexp_replace(folded(quote), r"^[\s.,;:'…-]+|[\s.,;:'…-]+$", "")
    return (F.length(q) >= 3) & (F.instr(folded(text), q) > 0)


def place_of(quote: Column, text: Column) -> Column:
    """Where a quote stands in a text (quote, start, end in code points), found by a pattern made of its words; null if nowhere, or under three characters."""
    q = F.regexp_replace(F.regexp_replace(quote, r"(?U)\s+", " "), r"""^[ .,;:"'«»“”„]+|[ .,;:"'«»“”„]+$""", "")
    escaped = F.regexp_replace(q, r"([\\^$.|?*+()\[\]{}-])", r"\\$1")
    loose = F.regexp_replace(F.regexp_replace(F.regexp_replace(escaped, '["«»“”„]', '["«»“”„]'), "[ёеЁЕ]", "[её]"), " ", r"\\s+")
    pattern = F.concat(F.lit("(?iuU)"), loose)
    start = F.regexp_instr(text, pattern) - 1
    hit = F.regexp_substr(text, pattern)
    return F.when((F.length(q) >= 3) & (start >= 0), F.struct(hit.alias("quote"), start.alias("start"), (start + F.length(hit)).alias("end")))


def cost_per_100(tokens: DataFrame, pricing: DataFrame) -> DataFrame:
    """tokens (model, input, output by document), pricing (model, in_price, out_price per million): cost of 100 documents; `kind:*` prices a kind's models that have no row."""
    per = tokens.groupBy("model").agg(F.avg("input").alias("i"), F.avg("output").alias("o"))
    exact = pricing.select("model", F.struct("in_price", "out_price").alias("exact"))
    wild = pricing.where("model like '%:*'").select(F.col("model").alias("any"), F.struct("in_price", "out_price").alias("wild"))
    j = per.join(exact, "model", "left").withColumn("any", F.concat(F.substring_index("model", ":", 1), F.lit(":*"))).join(wild, "any", "left")
    price = F.when(F.col("exact").isNotNull(), F.col("exact")).otherwise(F.col("wild"))
    return j.select("model", F.round(100 * (F.col("i") * price["in_price"] + F.col("o") * price["out_price"]) / 1e6, 6).alias("cost_per_100"))
