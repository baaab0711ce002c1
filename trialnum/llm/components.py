"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialnum.llm.shared import join_by_key, materialize


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
    joined = join_by_key(both, least, "u", "n", total)
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root): every node of an edge table (u, v) of longs and the smallest node it reaches.

    Each round replaces edges so that nodes point to ever smaller nodes, until all point to their
    component's smallest. Rounds grow with the logarithm of the longest path, each is written to
    the shared folder. Minima are aggregated before the shuffle and nodes with many edges are joined
    by broadcast, so a hub with a third of all edges is no single task. Loops and repeated edges are
    ignored; an empty table gives no rows.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, seen = materialize(e), None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        e = materialize(_star(materialize(_star(e, True, 2 * mark[0])), False, mark[0]))
    return e.select("u", F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
