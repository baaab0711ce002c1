"""Standoff annotation files and article XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialnum.operators.annotations import section_text
from trialnum.operators.numbering import number_rows
from trialnum.operators.tables import written
from trialnum.sources.small_files import read_small_files


def _pmid_of(name: Column) -> Column:
    """``12-33306283.ann`` -> ``33306283``."""
    return F.get(F.split(F.get(F.split(name, "-"), F.lit(1)), r"\."), F.lit(0))


def read_standoff_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``(pmid, line_no, line)`` of all ``.ann`` files, numbered within each file."""
    files = read_small_files(spark, folder, "ann")
    lines = files.select(
        _pmid_of(F.col("name")).alias("pmid"),
        F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line_no", "line"),
    )
    return lines.filter(F.col("line") != "")


def read_document_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents of a folder, from ``.ann`` and ``.txt`` names; files are not opened, empty ones count."""
    files = read_small_files(spark, folder, "ann", "txt", content=False)
    return files.select(_pmid_of(F.col("name")).alias("pmid")).distinct()


ARTICLE = """
    MedlineCitation STRUCT<
        PMID: STRUCT<_VALUE: BIGINT, _Version: STRING>,
        Article: STRUCT<ArticleTitle: STRING, Abstract: STRING>>
"""
# Elements that may stand inside a title or a section.
MARKUP = r"</?(?:[bisu]|sub|sup|em|strong|br|DispFormula|mml:[A-Za-z]+)(?:\s[^<>]*)?/?>"
SECTION = r"(?s)<AbstractText((?:\s[^>]*)?)>(.*?)</AbstractText>"


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, MARKUP, "")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """``(pmid, abstract, record_no)`` from article XML; articles without abstract are left out.

    Titles and abstracts are read with their inner elements, which then lose their tags but no
    text. An article is one row with its sections inside, so nothing is grouped. A missing title or an
    empty section is empty text.
    """
    articles = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(ARTICLE).load(path)
    citation = F.col("MedlineCitation")
    body = citation["Article"]["Abstract"]
    found = F.arrays_zip(
        F.regexp_extract_all(body, F.lit(SECTION), F.lit(1)).alias("attributes"),
        F.regexp_extract_all(body, F.lit(SECTION), F.lit(2)).alias("text"),
    )

    def section(s: Column, i: Column) -> Column:
        label = F.nullif(F.regexp_extract(s["attributes"], '\\bLabel="([^"]*)"', 1), F.lit(""))
        return F.struct(i.alias("pos"), label.alias("label"), _plain(s["text"]).alias("text"))

    rows = articles.select(
        citation["PMID"]["_VALUE"].alias("pmid"),
        _plain(F.coalesce(citation["Article"]["ArticleTitle"], F.lit(""))).alias("title"),
        F.transform(found, section).alias("sections"),
    ).filter(F.size("sections") > 0)
    abstracts = rows.select(
        "pmid",
        F.concat(F.lit("TITLE: "), F.col("title"), F.lit("\n"), section_text(F.col("sections"))).alias("abstract"),
    )
    # written, so that the articles are parsed once
    return number_rows(written(abstracts), "pmid", out="record_no")
