"""Texts that many rows share, worked out once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialnum.operators.tables import spread, written


def once_per_text(df: DataFrame, work: Callable[[DataFrame], DataFrame], *keys: str) -> DataFrame:
    """The other columns of ``df`` with what ``work`` makes of each distinct value of ``keys``, by default ``abstract``.

    ``work`` takes a table of the distinct keys and returns one that still has them, with any number of rows for each and
    columns that ``df`` has not. Keys are made distinct in the map tasks first, written, and dealt out by their number. The
    result is written too and met by a join: by broadcast while it is small, else by a shuffle whose large partitions the adaptive planner can split. Nulls
    are a text too; the first key is left out of the result. Where few texts repeat, work on the rows themselves is cheaper.
    """
    keys = keys or ("abstract",)
    done = written(work(spread(written(df.select(*keys).distinct()), keys[0])))
    for k in keys:
        done = done.withColumnRenamed(k, f"_of_{k}")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return df.join(done, same).drop(keys[0], *[f"_of_{k}" for k in keys])


def counted(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct values of ``keys`` with ``copies``, how many rows have them."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
