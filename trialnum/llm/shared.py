"""Helpers of the operators: tables in the shared folder, joins that survive hot keys, prefix sums."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trialnum.operators.tables import shared_folder

HOT_KEYS = 1000  # a key with a thousandth of all rows or more is hot, so there are at most this many


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; without it a temporary one in local sessions, none on a cluster."""
    return shared_folder(spark)


def materialize(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_by_key(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left rows joined to the one row of `table` with their key, where `count` tells how many rows a key has.

    Keys with a thousandth of `total` or more are joined by broadcast: there are at most a thousand
    of them, whatever the data. The others are small and meet by a shuffle.
    """
    hot = table.where(F.col(count) * HOT_KEYS >= F.lit(total))
    cold = table.where(F.col(count) * HOT_KEYS < F.lit(total))
    marked = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return marked.unionByName(rest)


def row_key(id_col: str, mark: Column) -> Column:
    """One string of an id (null is none) and a mark of the text, so that shuffles by it can be shared."""
    return F.concat(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")), F.lit("/"), mark.cast("string"))


def words(text: Column) -> Column:
    """How many runs of characters other than the six ASCII spaces a text has; null has none."""
    parts = F.size(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]++"))
    text = F.coalesce(text, F.lit(""))
    edge = lambda pattern: F.when(text.rlike(pattern), 1).otherwise(0)
    blank = ~text.rlike("[^\\x20\\x09-\\x0D]")
    return F.when(blank, 0).otherwise(parts - edge("^[\\x20\\x09-\\x0D]") - edge("[\\x20\\x09-\\x0D]\\z")).cast("long")


def text_bytes(text: str | None) -> bytes:
    """UTF-8 of a text, null as the empty one."""
    return text.encode("utf-8", "replace") if text else b""


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a schema, made on the driver for functions that run in tasks."""
    return to_arrow_schema(T.StructType.fromDDL(ddl))
