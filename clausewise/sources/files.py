"""Contract files: format by extension, text files of two encodings, word-processor files by their XML."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.functions.text import normalized, without_repeated_lines
from clausewise.sources import word

FORMATS = {"txt": "txt", "docx": "docx", "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "tif": "image", "tiff": "image"}
# A text layer with less on a page is a scan; so many signs without a letter spoil it.
CHARS_PER_PAGE, BROKEN_SIGNS = 50, 20


def plain(data: bytes) -> tuple[str, list[str]]:
    """UTF-8 with or without its mark, else Windows Cyrillic."""
    try:
        return data.decode("utf-8-sig"), []
    except UnicodeDecodeError:
        return data.decode("cp1251", "replace"), ["not UTF-8: read as cp1251"]


class Pages(Protocol):
    """A reader of page files: the text of each page, from the file's text layer or by recognising pictures. Neither comes with this library."""

    name: str

    def pages(self, data: bytes, kind: str) -> list[str]: ...


def load(data: bytes, kind: str | None) -> tuple[str | None, tuple[str | None, str | None, str | None] | None, list[str]]:
    """A file's text, or the XML of a word-processor file's parts; and warnings."""
    try:
        if kind == "txt":
            text, warnings = plain(data)
            return text, None, warnings
        if kind == "docx":
            return None, word.parts(data), []
    except (zipfile.BadZipFile, KeyError) as e:
        return None, None, [f"unreadable: {e}"]
    return None, None, ["needs a reader of its own" if kind else "unsupported format"]


def read(spark: SparkSession, path: str, prefer: str = "ru") -> DataFrame:
    """(doc_id, path, source_format, text, warnings) of all files below a path; unreadable ones keep a null text and a warning."""

    @F.pandas_udf("text string, document string, numbering string, styles string, warnings array<string>")
    def loaded(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for contents, kinds in it:
            rows = [load(c, k) for c, k in zip(contents, kinds, strict=True)]
            yield pd.DataFrame([(t, *(parts or (None, None, None)), w) for t, parts, w in rows], columns=["text", *word.PARTS, "warnings"])

    r = contents(spark, path).withColumn("r", loaded("content", "source_format"))
    files = r.select("doc_id", "path", "source_format", F.struct("r.text", "r.warnings").alias("own"), *[f"r.{c}" for c in word.PARTS])
    read = word.texts(files, prefer)
    return read.select("doc_id", "path", "source_format", normalized(F.coalesce("own.text", "text")).alias("text"), F.concat("own.warnings", "warnings").alias("warnings"))


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, source_format, content) of all files below a path; doc_id is of the content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv]), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    return files.select(F.substring(F.sha2("content", 256), 1, 12).alias("doc_id"), "path", known.alias("source_format"), "content")


def parse_text(texts: DataFrame) -> DataFrame:
    """(doc_id, text) as a source of documents: normalised, without warnings."""
    return texts.select("doc_id", F.lit("txt").alias("source_format"), normalized(F.col("text")).alias("text"), F.array().cast("array<string>").alias("warnings"))


def paged(files: DataFrame, reader: Pages) -> DataFrame:
    """files (doc_id, source_format, content) of pages: (doc_id, page_no, text) by a reader."""

    @F.pandas_udf("array<string>")
    def of(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for data, kinds in it:
            yield pd.Series([reader.pages(d, k) for d, k in zip(data, kinds, strict=True)])

    return files.select("doc_id", F.posexplode_outer(of("content", "source_format")).alias("page_no", "text"))


def scans(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page_no, text): documents whose text layer is no use, with needs_ocr and a warning: too few characters a page, or a font without a table of characters."""
    t = F.coalesce("text", F.lit(""))
    per = pages.groupBy("doc_id").agg(F.avg(F.length(F.trim(t))).alias("chars"), F.sum(F.regexp_count(t, F.lit(r"\(cid:"))).alias("broken"))
    broken, few = F.col("broken") > BROKEN_SIGNS, F.col("chars") < CHARS_PER_PAGE
    warnings = F.array_compact(F.array(F.when(broken, "the font has no table of characters"), F.when(broken | few, "looks like a scan: needs recognising")))
    return per.select("doc_id", (broken | few).alias("needs_ocr"), warnings.alias("warnings"))


def assembled(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page_no, text) as documents (doc_id, text, page_starts): each page normalised, headers and footers dropped."""
    lines = pages.select("doc_id", "page_no", F.posexplode(F.split(F.regexp_replace(normalized(F.coalesce("text", F.lit(""))), r"\n+$", ""), "\n")).alias("line_no", "line"))
    kept = without_repeated_lines(lines).groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    all_ = pages.select("doc_id", "page_no").join(kept, ["doc_id", "page_no"], "left").select("doc_id", "page_no", F.when(F.coalesce("text", F.lit("")) == "", "").otherwise(F.concat("text", F.lit("\n"))).alias("text"))
    own = all_.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]).alias("t"))
    starts = F.transform("t", lambda x, i: F.aggregate(F.slice("t", F.lit(1), i), F.lit(0), lambda n, y: n + F.length(y)))
    return own.select("doc_id", F.array_join("t", "").alias("text"), starts.alias("page_starts"))
