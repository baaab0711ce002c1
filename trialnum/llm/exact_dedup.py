"""Exact duplicates by a 128-bit content hash, with the bytes of equal hashes compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialnum.llm.shared import join_by_key, materialize, row_key


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
    digest: Callable[[Column], Column] = md5_128,
) -> DataFrame:
    """One row per document: (uid, id, keep_id, group_size, kept, text_sha256).

    Documents are one group if their whole texts are equal byte by byte. The hash only finds
    the groups: grouping by (hash, text) compares the bytes, with partial aggregation before the
    shuffle, so a text that a third of all rows share is one row of each map task. Hashes that
    more than one text has are then told apart by the text itself.

    The row of a group with the smallest (or largest) id stays, of repeated ids one row; a null
    id stays only if the group has no other. Null text is the empty text. An empty table gives
    no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    texts = source.groupBy(digest(F.col("text")).alias("digest"), "text").agg(F.count(F.lit(1)).alias("n"))
    shared = materialize(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"))
    collision = F.lit("")
    rows = source.withColumn("digest", digest(F.col("text")))
    if not shared.isEmpty():
        rows = rows.join(shared.withColumn("shared", F.lit(True)), "digest", "left")
        collision = F.when(F.col("shared"), F.col("text")).otherwise("")
    rows = materialize(
        rows.select(
            F.monotonically_increasing_id().alias("uid"), "id", "digest", collision.alias("apart"),
            F.sha2("text", 256).alias("text_sha256"),
        )
    )
    rows = rows.withColumn("key", F.concat(F.col("digest"), F.encode("apart", "utf-8"))).drop("digest", "apart")
    least = keep == "smallest"
    first = F.struct(F.col("id").isNull() if least else F.col("id").isNotNull(), "id", "uid")
    first = F.min(first) if least else F.max(first)
    groups = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first")))
    groups = groups.select("key", "group_size", F.col("first.id").alias("keep_id"), F.col("first.uid").alias("keep_uid"))
    joined = join_by_key(rows, groups, "key", "group_size", rows.count())
    return joined.select("uid", "id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of `docs` that stay, with all their columns; of fully repeated rows one.

    Rows that repeat both id and text become one before anything is joined; kept rows are then
    found by (id, SHA-256 of the text).
    """
    kept = duplicate_classes(docs, id_col, text_col, keep).where("kept").select(row_key("id", F.col("text_sha256")).alias("_key"))
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    single = docs.withColumn("_key", row_key(id_col, sha)).dropDuplicates(["_key"])
    return single.join(kept, "_key", "left_semi").drop("_key")
