"""Row numbers and folds over a whole table without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialnum.operators.tables import written

# bits of a row's place within its partition, as Spark numbers rows
PLACE_BITS = 33


def number_rows(df: DataFrame, *order: str | Column, out: str = "row_no") -> DataFrame:
    """Rows numbered from 1 in an order, which should tell all rows apart.

    Rows are dealt out by ranges of the order and sorted where they lie; a row's number is its place plus the rows of all
    ranges before, a prefix sum over one row per range. The sorted rows are written, as ranges made again could
    be others.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", PLACE_BITS)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    # one row for every range, whatever the data
    placed = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
    within = F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return placed.withColumn(out, F.col("_start") + within + 1).drop("_part", "_place", "_start")


def assign_folds(df: DataFrame, key: str = "pmid", k: int = 5, seed: int = 0) -> DataFrame:
    """Adds ``fold_id`` from a hash of the key: no shuffle, folds about equal in size."""
    fold = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(k)).cast("int")
    return df.withColumn("fold_id", fold)


def assign_even_folds(df: DataFrame, key: str = "pmid", k: int = 5, seed: int = 0) -> DataFrame:
    """Adds ``fold_id`` so that fold sizes differ by at most one key.

    Keys are numbered in hash order, hence shuffled. Copies of a key go to the
    same fold; they are collapsed before anything is sorted.
    """
    keys = df.select(key).distinct()
    numbered = number_rows(keys, F.xxhash64(F.col(key), F.lit(seed)), F.col(key), out="_no")
    folds = numbered.select(key, F.pmod(F.col("_no") - 1, F.lit(k)).cast("int").alias("fold_id"))
    return df.join(folds, key)
