"""Queries of field extraction: replies with one thing broken, by the order's key, and a model that mends what it is told."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.operators import extraction
from clausewise.plans.learning import kept

RECORD = {
    "contract_type": "lease", "contract_number": "A-{k}", "contract_date": "2024-03-01", "city": "Алматы",
    "parties": [{"role": "landlord", "name": "ТОО «А{k}»", "bin": "123456789012"}, {"role": "tenant", "name": "ИП Б", "bin": None}],
    "term_months": 12, "auto_renewal": False, "price_amount": 1000.5, "price_period": "monthly", "payment_deadline_days": 30, "payment_penalty_rate_percent_per_day": 0.1,
    "payment_penalty_cap_percent": 10, "dispute_forum": "kz_courts", "termination_notice_days": None,
}


def patched(drop: str | None = None, party: dict | None = None, **patch: object) -> str:
    """The record with some fields other, one gone, or its first party's fields other."""
    record = {k: v for k, v in (RECORD | patch).items() if k != drop}
    if party is not None:
        record["parties"] = [RECORD["parties"][0] | party, RECORD["parties"][1]]
    return json.dumps(record, ensure_ascii=False)


TENANT = RECORD["parties"][1]
#: reply -> faults: a good one, or one broken in one way (two, where one follows from the other).
REPLIES: list[tuple[str, str]] = [
    (patched(), ""),
    ("Вот ответ:\n```json\n" + patched() + "\n```", ""),
    (patched(term_months="abc"), "term_months: not a int"),
    (patched(term_months="24", auto_renewal="true", price_amount=7, payment_deadline_days=10.0), ""),
    (patched(term_months=12.5), "term_months: not a int"),
    (patched(term_months=601), "term_months: too large"),
    (patched(term_months=0), "term_months: too small"),
    (patched(contract_date="1 мая"), "contract_date: not a date"),
    (patched(contract_date="2024-02-30"), "contract_date: not a date"),
    (patched(contract_date="1999-01-01"), "contract_date: out of years"),
    (patched(contract_type="loan"), "contract_type: not one of its choices"),
    (patched(contract_type=None), "contract_type: null"),
    (patched(contract_number=17), "contract_number: not a string"),
    (patched(auto_renewal=None), "auto_renewal: null"),
    (patched(auto_renewal="maybe"), "auto_renewal: not a boolean"),
    (patched(drop="city"), "city: missing"),
    (patched(city=None, contract_number=None, price_period=None, price_amount=None), ""),
    (patched(price_amount=0), "price_amount: too small"),
    (patched(price_amount=None), "price_period: without amount"),
    (patched(price_period="weekly"), "price_period: not one of its choices"),
    (patched(payment_deadline_days=366), "payment_deadline_days: too large"),
    (patched(payment_penalty_rate_percent_per_day=250), "payment_penalty_rate_percent_per_day: too large"),
    (patched(payment_penalty_cap_percent=-1), "payment_penalty_cap_percent: too small"),
    (patched(dispute_forum="moon"), "dispute_forum: not one of its choices"),
    (patched(termination_notice_days=[30]), "termination_notice_days: not a int"),
    (patched(colour="red"), "colour: unknown"),
    (patched(party={"role": "lender"}), "parties.0.role: not one of its choices"),
    (patched(party={"name": "А"}), "parties.0.name: too short"),
    (patched(party={"bin": "123"}), "parties.0.bin: not twelve digits"),
    (patched(party={"phone": "1"}), "parties.0.phone: unknown"),
    (patched(party={"role": "tenant"}), "parties: one role"),
    (patched(parties=[TENANT]), "parties: not two"),
    (patched(parties="А и Б"), "parties: not a list"),
    (patched(parties=["А", TENANT]), "parties.0: not an object"),
    (patched(drop="parties"), "parties: missing"),
    (patched(contract_type=1, auto_renewal=[], city=5), "contract_type: not a string; city: not a string; auto_renewal: not a boolean"),
    ("{}", "; ".join(f"{f}: missing" for f in [*list(extraction.FIELDS)[:4], "parties", *list(extraction.FIELDS)[4:]][: extraction.MOST_FAULTS])),
    ("нет данных", "json"),
    ('{"contract_type": }', "json"),
]


def reply_of(key: Column) -> Column:
    return F.replace(F.array(*[F.lit(r) for r, _ in REPLIES])[(key % len(REPLIES)).cast("int")], F.lit("{k}"), key.cast("string"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"))
    return orders.withColumn("reply", reply_of(F.col("doc_id")))


def schema_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faults of a reply for each order, and the number that a valid one holds."""
    c = extraction.checked(replies(spark, sf_dir))
    return c.select("doc_id", F.array_join("faults", "; ").alias("faults"), F.when(F.size("faults") == 0, F.col("record.term_months").cast("long")).alias("term_months"))


_CASES = " ".join(f"WHEN {i} THEN '{said}'" for i, (_, said) in enumerate(REPLIES))
_GOOD = [i for i, (_, said) in enumerate(REPLIES) if not said]
_LENIENT = next(i for i, (r, _) in enumerate(REPLIES) if '"24"' in r)
FAULTS_SQL = f"SELECT doc_id, faults, CASE WHEN faults = '' THEN CASE WHEN doc_id % {len(REPLIES)} = {_LENIENT} THEN 24 ELSE 12 END END AS term_months FROM (SELECT o_orderkey AS doc_id, CASE o_orderkey % {len(REPLIES)} {_CASES} END AS faults FROM orders)"


def mending(prompt: str) -> str:
    """A model that breaks its first reply as its prompt's key says, and mends it when told what was wrong, but for every fifth key; some keys it can't be reached for."""
    key = int(prompt.split()[0])
    if key % 13 == 5:
        raise ConnectionError("unreachable")
    told = "\n" in prompt
    return (patched() if told and key % 5 else REPLIES[key % len(REPLIES)][0]).replace("{k}", str(key))


def extraction_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order asked, and asked once more where the first reply is broken: status and attempts."""
    texts = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").cast("string").alias("prompt"))
    out = extraction.extract(texts, extraction.Mock(mending), kept(spark))
    return out.select("doc_id", "status", F.col("attempts").cast("long").alias("attempts"), F.col("record.contract_number").alias("contract_number"))


_IS_GOOD = f"o_orderkey % {len(REPLIES)} IN ({', '.join(map(str, _GOOD))})"
_NO_NUMBER = next(i for i, (r, _) in enumerate(REPLIES) if '"contract_number": null' in r)
RETRY_SQL = (
    "SELECT o_orderkey AS doc_id, status, CASE WHEN status = 'backend_error' OR status = 'ok_first_try' THEN 1 ELSE 2 END AS attempts, "
    f"CASE WHEN status LIKE 'ok%' AND NOT (status = 'ok_first_try' AND o_orderkey % {len(REPLIES)} = {_NO_NUMBER}) THEN 'A-' || o_orderkey END AS contract_number "
    f"FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 5 THEN 'backend_error' WHEN {_IS_GOOD} THEN 'ok_first_try' WHEN o_orderkey % 5 > 0 THEN 'ok_after_retry' ELSE 'failed' END AS status FROM orders)"
)

QUERIES = {"schema_faults": (schema_faults, FAULTS_SQL), "extraction_retry": (extraction_retry, RETRY_SQL)}
