"""Word files' parts made of the order tables: a list of three depths that begins again, tables, tables in two languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.sources import word

_NS = f'xmlns:w="{word.NAMESPACE}"'
_FORMATS = (("decimal", "%1."), ("decimal", "%1.%2."), ("russianLower", "%3)"))
#: List 2 goes on counting as list 1, but begins at 5 anew.
AGAIN = 5
LISTS = (
    f'<w:numbering {_NS}><w:abstractNum w:abstractNumId="7">'
    + "".join(f'<w:lvl w:ilvl="{d}"><w:start w:val="1"/><w:numFmt w:val="{f}"/><w:lvlText w:val="{t}"/></w:lvl>' for d, (f, t) in enumerate(_FORMATS))
    + f'</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="7"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="{AGAIN}"/></w:lvlOverride></w:num></w:numbering>'
)
_PARAGRAPH = '<w:p><w:pPr><w:numPr><w:ilvl w:val="%d"/><w:numId w:val="%d"/></w:numPr></w:pPr><w:r><w:t>строка %d</w:t></w:r></w:p>'
_CELL = "<w:tc><w:p><w:r><w:t>%s</w:t></w:r></w:p></w:tc>"
_TABLE = f"<w:tbl><w:tr>{_CELL}{_CELL}</w:tr></w:tbl>"
KAZAKH, RUSSIAN, LEFT, RIGHT = "Жалға алушы төлейді", "Покупатель платит", "Поставщик &amp; Ко", "Покупатель"


def word_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a Word file for each order: its lines are numbered paragraphs, a table follows."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity").cast("int") % 4).alias("q")).alias("x"))
    k = F.col("l_orderkey")

    def paragraph(x, i):
        depth = F.when((i == 0) | (x["q"] == 0), 0).when(x["q"] == 3, 2).otherwise(1)
        return F.format_string(_PARAGRAPH, depth, F.when((k % 3 == 0) & (i >= 3), 2).otherwise(1), i + 1)

    body = F.array_join(F.transform("xs", paragraph), "")
    even, odd = F.format_string(_TABLE, F.lit(KAZAKH), F.concat(F.lit(RUSSIAN + " "), k)), F.format_string(_TABLE, F.lit(LEFT), F.concat(F.lit(RIGHT + " "), k))
    files = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("xs")).select(
        "l_orderkey", F.concat(F.lit(f"<w:document {_NS}><w:body>"), body, F.when(k % 2 == 0, even).otherwise(odd), F.lit("</w:body></w:document>")).alias("document"), F.lit(LISTS).alias("numbering"), F.lit(None).cast("string").alias("styles")
    )
    return word.texts(files, key="l_orderkey").select("l_orderkey", "text", F.size("warnings").cast("long").alias("warnings"))


_W = "(PARTITION BY k ORDER BY rn)"
TEXTS_SQL = (
    "WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT) % 4) AS rn, CAST(l_quantity AS INT) % 4 AS q FROM lineitem), "
    "d AS (SELECT *, CASE WHEN rn = 1 OR q = 0 THEN 0 WHEN q = 3 THEN 2 ELSE 1 END AS depth, CASE WHEN k % 3 = 0 AND rn = 4 THEN 1 ELSE 0 END AS anew FROM l), "
    f"i AS (SELECT *, sum(anew) OVER {_W} AS i0, sum(CASE WHEN anew = 1 OR depth < 1 THEN 1 ELSE 0 END) OVER {_W} AS i1, sum(CASE WHEN anew = 1 OR depth < 2 THEN 1 ELSE 0 END) OVER {_W} AS i2 FROM d), "
    "n AS (SELECT *, " + ", ".join(f"greatest(sum(CASE WHEN depth = {d} THEN 1 ELSE 0 END) OVER (PARTITION BY k, i{d} ORDER BY rn), 1) AS n{d}" for d in range(3)) + " FROM i), "
    f"s AS (SELECT k, rn, CASE depth WHEN 0 THEN (n0 + {AGAIN - 1} * i0) || '.' WHEN 1 THEN (n0 + {AGAIN - 1} * i0) || '.' || n1 || '.' ELSE substr('{word.RUSSIAN}', CAST(n2 AS INT), 1) || ')' END || ' строка ' || rn AS line FROM n) "
    f"SELECT k AS l_orderkey, string_agg(line, chr(10) ORDER BY rn) || chr(10) || CASE WHEN k % 2 = 0 THEN '{RUSSIAN} ' || k ELSE '{LEFT.replace('&amp;', '&')} | {RIGHT} ' || k END AS text, CAST(CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS warnings FROM s GROUP BY k"
)

QUERIES = {"word_texts": (word_texts, TEXTS_SQL)}
