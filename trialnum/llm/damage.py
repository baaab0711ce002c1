"""Seeded faults for queries that find and mend them: what is damaged follows from checksums of the keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialnum.llm.spelling import letter_runs, without_point

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def crc_of(*parts: Column) -> Column:
    """Unsigned CRC-32 of parts joined by colons, as UTF-8."""
    text = parts[0]
    for part in parts[1:]:
        text = F.concat(text, F.lit(":"), part)
    return F.crc32(text.cast("binary"))


def misspelt_words(docs: DataFrame, letters: str = "A-Za-z\\u00C0-\\u00FF", least: int = 7, every: int = 31) -> DataFrame:
    """``(word, n)`` of the letter runs of all texts, some with one code point deleted.

    Runs are lower-cased (A-Z only). A run loses a point if ``every`` divides the checksum of
    ``<doc_id>:<run>``. Words of fewer than ``least`` points or that occur once are left out. Null text has no run, a
    null id stands for an empty one. Runs are counted where they are read, before anything is shuffled.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(letter_runs(F.col("text"), letters, least)).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run")).withColumn("crc", crc_of(F.col("id"), F.col("run")))
    place = (F.col("crc") % F.length("run")).cast("int")
    word = F.when(F.col("crc") % every == 0, without_point(F.col("run"), place)).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def damaged_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with a quarter of the rows damaged, by the checksum of ``<conv_id>:<turn>`` mod 20.

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 makes the role user. Null
    id and turn count as one space in the checksum, null role and text become one space.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"))
    rows = rows.withColumn("_fault", crc_of(blank("conv_id"), blank("turn")) % 20).where("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(1), F.when(F.col("_fault") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies)).drop("col")
