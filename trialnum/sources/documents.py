"""Readers and writers of documents, gold, predictions and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialnum.sources.csv_records import csv_records

# numbers of texts may have up to 38 digits, as extraction and annotations give them
DOCUMENTS = "pmid bigint, abstract string"
LABELLED = "pmid bigint, abstract string, tt_sample_size decimal(38,0)"
PREDICTIONS = "pmid bigint, pred_ss decimal(38,0), conf double"
GOLD = "pmid bigint, tt_sample_size decimal(38,0), fold_id int"
VOCABULARY = "token string, id int, cnt bigint"
LOOSE = "pmid bigint, total decimal(38,0), poss array<decimal(38,0)>"


def _whole(text: Column, kind: T.DataType) -> Column:
    """A whole number from its text, exact at any length the type holds; a fraction is cut off.

    Tables with gaps often write ``50.0``, and large numbers as ``1e+20``.
    """
    digits = F.regexp_replace(F.trim(text), r"\.[0-9]*$", "")
    return F.coalesce(digits.try_cast(kind), text.try_cast("double").try_cast(kind))


def read_csv(spark: SparkSession, path: str, schema: str, index: bool = False) -> DataFrame:
    """CSV with a header and quoted, possibly multi-line text; files of any size are read in splits.

    ``index`` reads and drops an unnamed leading index column. Whole numbers are read as text and
    cast, so that they keep all digits and may carry a decimal point.
    """
    declared = T.StructType.fromDDL(schema)
    whole = [f for f in declared if isinstance(f.dataType, (T.IntegralType, T.DecimalType))]
    raw = T.StructType([T.StructField(f.name, T.StringType() if f in whole else f.dataType) for f in declared])
    if index:
        raw = T.StructType([T.StructField("_index", T.StringType()), *raw])
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    records = csv_records(spark, path).where("NOT first")
    rows = records.select(F.from_csv("record", raw.toDDL(), options).alias("_row")).select("_row.*")
    return rows.select(*[_whole(F.col(f.name), f.dataType).alias(f.name) if f in whole else f.name for f in declared])


def read_parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The declared columns in their declared types; narrower numbers of a file are widened."""
    rows = spark.read.parquet(path)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """Also for nested tables: annotations per document, loose-match table, vocabulary."""
    df.write.mode("overwrite").parquet(path)
