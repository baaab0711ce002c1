"""Intermediate tables in a folder that all machines see."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
SPREAD_ROWS = 25_000  # rows of a partition


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where it names none, a local session gets a temporary folder, removed at exit; on a cluster other machines
    would not see one, so there it has to be named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "folder" not in _own:
        _own["folder"] = tempfile.mkdtemp(prefix="trialnum-")
        atexit.register(shutil.rmtree, _own["folder"], ignore_errors=True)
    return "file://" + _own["folder"]


def written(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: later steps see the same rows, whatever is computed again or lost."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str, rows: int = SPREAD_ROWS) -> DataFrame:
    """Gives an input with few splits at least one partition per core and one per ``rows`` rows.

    Text work is heavy per row: a split of narrow keys holds millions of them, and a one-split file would run on one core.
    The rows of a parquet file are counted from its footers.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(parts, key) if df.rdd.getNumPartitions() < parts else df
