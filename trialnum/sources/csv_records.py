"""Records of CSV files of any size, where quoted fields may hold line ends.

Whether a line end closes a record depends on all quotes before it, so a reader that wants exact records takes a file as
one task. Here files are split as any text is. Every split is scanned in both states it may begin in, at the start of a
record or inside a quoted field; which of them holds follows from the splits before, a prefix over one row per split.
Then each split gives the records that lie in it, and the few that cross a border are put together from their lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT = ["_file", "_block"]
RECORD, QUOTED = 0, 1  # states at the start of a line


class LineStates:
    """State after a line, from the state before it. Quotes within unquoted fields are plain characters."""

    def __init__(self, delimiter: str) -> None:
        d = re.escape(delimiter)
        inside = r'[^"]*+(?:""[^"]*+)*+'
        fields = rf'(?:(?:"{inside}"[^{d}]*+|(?!")[^{d}]*+){d})*+'
        self._opens = re.compile(rf'{fields}"{inside}\Z', re.S)
        self._stays = re.compile(rf"{inside}\Z", re.S)
        self._closes = re.compile(rf'{inside}"[^{d}]*+', re.S)
        self._delimiter = delimiter

    def after(self, state: int, line: str) -> int:
        if '"' not in line:
            return state
        if state == RECORD:
            return QUOTED if self._opens.match(line) else RECORD
        if self._stays.match(line):
            return QUOTED
        end = self._closes.match(line).end()
        return QUOTED if line.startswith(self._delimiter, end) and self._opens.match(line, end + 1) else RECORD


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in the order of their split, with the file and the place where the split begins."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def _split_states(lines: DataFrame, delimiter: str) -> DataFrame:
    """(file, block, after_record, after_quoted): the state after each split, for both states before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, found = LineStates(delimiter), {}
        for batch in batches:
            for value, file, block in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = found.get((file, block), (RECORD, QUOTED))
                found[file, block] = (states.after(a, value), states.after(b, value))
        rows = [{"_file": f, "_block": k, "after_record": a, "after_quoted": b} for (f, k), (a, b) in found.items()]
        schema = pa.schema([("_file", pa.string()), ("_block", pa.int64()), ("after_record", pa.int32()), ("after_quoted", pa.int32())])
        yield pa.RecordBatch.from_pylist(rows, schema)

    return lines.mapInArrow(run, "_file string, _block long, after_record int, after_quoted int")


def _first_states(splits: DataFrame) -> DataFrame:
    """(file, block, state): the state that each split begins in.

    A split leads to one state whatever was before, or keeps the state, or turns it: the state is that of the last split
    of the first kind, turned as often as splits after it do. A file has one row for each of its splits here.
    """
    fixed = F.col("after_record") == F.col("after_quoted")
    order = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    turned = splits.withColumn("_turns", F.sum(F.when(~fixed & (F.col("after_record") == QUOTED), 1).otherwise(0)).over(order))
    last = F.last(F.when(fixed, F.struct(F.col("after_record").alias("to"), F.col("_turns").alias("turns"))), ignorenulls=True).over(order)
    turned = turned.withColumn("_last", last)
    turns = F.col("_turns") - F.coalesce(F.col("_last.turns"), F.lit(0))
    after = F.pmod(F.coalesce(F.col("_last.to"), F.lit(RECORD)) + turns, F.lit(2))
    before = F.lag(after, 1, RECORD).over(Window.partitionBy("_file").orderBy("_block"))
    return turned.select(*SPLIT, before.cast("int").alias("_state"))


def csv_records(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """``(file, first, record)``: every record of the files as text, ``first`` for the first of a file; blank lines are no records.

    Quotes are doubled inside quoted fields. Lines end with ``\\n`` or ``\\r\\n``.
    """
    lines = _lines(spark, path)
    # one row for each split, so a row for every 128 MB of input
    begins = F.broadcast(_first_states(_split_states(lines, delimiter)))
    marked = lines.join(begins, SPLIT, "left")
    missing = F.raise_error(F.lit("files were split otherwise when they were scanned"))
    marked = marked.withColumn("_state", F.when(F.col("_state").isNull(), missing.cast("int")).otherwise(F.col("_state")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, split, state, held, place, rows = LineStates(delimiter), None, RECORD, [], 0, []

        def part(ends: bool) -> dict:
            """Lines that belong together: a record, or what of one lies before or behind a border."""
            return {"_file": split[0], "_block": split[1], "_place": place, "text": "\n".join(held), "_starts": held_starts, "_ends": ends}

        held_starts = True
        for batch in batches:
            for file, block, value, begins_in in zip(*(batch[c].to_pylist() for c in ("_file", "_block", "value", "_state"))):
                if (file, block) != split:
                    if held:
                        rows.append(part(False))
                    split, state, held, place, held_starts = (file, block), begins_in, [], 0, begins_in == RECORD
                held.append(value)
                state = states.after(state, value)
                if state == RECORD:
                    rows.append(part(True))
                    held, place, held_starts = [], place + 1, True
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if held:
            rows.append(part(False))
        yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema(
        [("_file", pa.string()), ("_block", pa.int64()), ("_place", pa.int64()), ("text", pa.string()), ("_starts", pa.bool_()), ("_ends", pa.bool_())]
    )
    parts = marked.mapInArrow(run, "_file string, _block long, _place long, text string, _starts boolean, _ends boolean")
    whole = parts.where("_starts AND _ends").select("_file", "_block", "_place", "text")
    # what crosses a border: the start of a record and, in order, what follows up to its end
    order = Window.partitionBy("_file").orderBy("_block", "_place")
    torn = parts.where("NOT (_starts AND _ends)").withColumn("_record", F.sum(F.col("_starts").cast("int")).over(order))
    pieces = F.array_sort(F.collect_list(F.struct("_block", "_place", "text")))
    joined = torn.groupBy("_file", "_record").agg(pieces.alias("_pieces"))
    joined = joined.select(
        "_file", F.col("_pieces")[0]["_block"].alias("_block"), F.col("_pieces")[0]["_place"].alias("_place"),
        F.array_join(F.transform("_pieces", lambda p: p["text"]), "\n").alias("text"),
    )
    records = whole.unionByName(joined).withColumn("record", F.regexp_replace("text", "\r\\z", ""))
    first = (F.col("_block") == 0) & (F.col("_place") == 0)
    return records.select(F.col("_file").alias("file"), first.alias("first"), "record").where("first OR record <> ''")
