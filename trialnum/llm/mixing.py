"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialnum.llm.shared import materialize, words


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """Targets of sources: (source, none, source_size) -> the same with target.

    Sources in code point order (null last) weigh `weights`, repeating. share[0] / share[1] of
    all sizes is dealt out by weight; no target goes above `most` times its source's size, the
    excess goes to the others by weight. In order of size per weight a source is capped as long
    as its fair part of what is left reaches its cap. One row per source, as aggregated before.
    """
    order = Window.orderBy("none", "source")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.lit(most) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "none", "source")
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("before", before).withColumn("left_weight", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("all_sizes", F.sum("source_size").over(Window.partitionBy()))
    up, down = share
    left = F.lit(up) * F.col("all_sizes") - F.lit(down) * F.col("before")
    s = s.withColumn("left", left)
    s = s.withColumn("full", F.col("weight") * F.col("left") >= F.lit(down) * F.col("cap") * F.col("left_weight"))
    # the first source that is not full sets the level of all later ones
    level = F.first(F.when(~F.col("full"), F.struct("left", "left_weight")), ignorenulls=True).over(
        fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    s = s.withColumn("level", level)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(
        F.col("weight") * F.col("level.left") / (F.lit(down) * F.col("level.left_weight"))
    )
    return s.select("source", "none", "source_size", target.alias("target"))


def random_offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) of a source and a seed, the same in every run: 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), source)), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2, seed: int = 42,
    text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: (id, size, source_size, target, copies) and the columns of `carry`.

    Within a source every document is expected target / source_size times. Documents are ranked
    by size within their source, the expectations add up to rank times that rate, and with one
    random offset per source a document is emitted once per whole number its step crosses. In order
    of size the words taken differ from the target by about one document at most.

    Ranks are distributed: rows are dealt out by ranges of (source, size, id), numbered where they
    lie, and a row's rank is its place plus the source's rows in earlier ranges. A hot source
    simply fills many ranges. Ties in all keys are equal documents and interchangeable.

    Null text has size 0; null source is a source of its own; a source without words has target
    0 and is not taken. Repeated rows count each. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("hash"),
        *[F.col(c).alias(f"carry_{c}") for c in carry],
    )
    keys = ["none", "source", "size", "id", "hash"]
    ranked = materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()))
    ranked = ranked.withColumn("bucket", F.shiftright("place", 33))
    by_range = materialize(
        ranked.groupBy("bucket", "none", "source").agg(
            F.count(F.lit(1)).alias("n"), F.min("place").alias("start"), F.sum("size").alias("words")
        )
    )
    targets = source_targets(by_range.groupBy("source", "none").agg(F.sum("words").alias("source_size")), weights, share, most)
    earlier = Window.partitionBy("none", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_range.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n", "words")
    # written, so that its size is known and the rows with their texts need not move to meet it
    offsets = materialize(offsets.join(targets, ["none", "source"]))
    joined = ranked.join(offsets, ["bucket", "none", "source"])
    rank = F.col("place") - F.col("start") + F.col("before")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u = random_offset(F.concat(F.when(F.col("none"), "n").otherwise("s"), F.col("source")), seed)
    copies = F.floor(rate * (rank + 1) + u) - F.floor(rate * rank + u)
    return joined.select(
        "id", "size", "source_size", "target", copies.cast("long").alias("copies"), *[F.col(f"carry_{c}").alias(c) for c in carry]
    )
