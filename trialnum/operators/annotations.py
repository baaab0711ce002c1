"""Standoff annotation lines as tables, gold and loose-match tables, abstract assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialnum.functions.numbers import annotated_number, capitalize, normalized_number
from trialnum.functions.tokens import NUMBER
from trialnum.operators.numbering import number_rows

# First letters of the line kinds, and the entity types in use.
ENTITY_MARK, RELATION_MARK = "T", "R"
TOTAL_TYPE, POSSIBLE_TYPE = "Total_sample_size", "Poss_total_sample"


def _parts(line: Column) -> tuple[Column, Column]:
    fields = F.split(line, "\t")
    return fields, F.split(F.trim(F.get(fields, F.lit(1))), r"(?U)\s+")


def _tail_id(field: Column) -> Column:
    """``T12`` -> 12."""
    return F.substr(field, F.lit(2)).try_cast("int")


def _argument_id(field: Column) -> Column:
    """``Arg1:T3`` -> 3."""
    return _tail_id(F.get(F.split(field, ":"), F.lit(1)))


def entities(lines: DataFrame) -> DataFrame:
    """Entity rows of ``lines (pmid, line_no, line)``; other kinds of lines are skipped."""
    fields, words = _parts(F.col("line"))
    return lines.filter(F.col("line").startswith(ENTITY_MARK)).select(
        "pmid",
        "line_no",
        _tail_id(F.get(fields, F.lit(0))).alias("standoff_id"),
        capitalize(F.get(words, F.lit(0))).alias("entity_type"),
        F.get(words, F.lit(1)).try_cast("int").alias("offset_start"),
        F.get(words, F.lit(2)).try_cast("int").alias("offset_end"),
        F.get(fields, F.lit(2)).alias("word"),
    )


def relations(lines: DataFrame) -> DataFrame:
    """Relation rows of ``lines (pmid, line_no, line)``."""
    fields, words = _parts(F.col("line"))
    return lines.filter(F.col("line").startswith(RELATION_MARK)).select(
        "pmid",
        "line_no",
        _tail_id(F.get(fields, F.lit(0))).alias("standoff_id"),
        F.get(words, F.lit(0)).alias("name"),
        _argument_id(F.get(words, F.lit(1))).alias("standoff_entity1_id"),
        _argument_id(F.get(words, F.lit(2))).alias("standoff_entity2_id"),
    )


def nested(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Entity or relation rows of each document as one array, in file order.

    With ``ids`` every document has a row, with an empty array if it has none. The
    array is one document's annotations, the value that is asked for.
    """
    fields = [c for c in rows.columns if c not in ("pmid", "line_no")]
    packed = F.sort_array(F.collect_list(F.struct("line_no", *fields)))
    groups = rows.groupBy("pmid").agg(packed.alias("items"))
    if ids is None:
        return groups
    kind = groups.schema["items"].dataType
    everyone = ids.select("pmid").distinct().join(groups, "pmid", "left")
    return everyone.withColumn("items", F.coalesce("items", F.array().cast(kind)))


def entity_numbers(entity_rows: DataFrame, entity_type: str | None = None) -> DataFrame:
    """Entities with ``num`` (annotated number), ``norm`` and ``norm_num`` (rewritten text)."""
    if entity_type is not None:
        entity_rows = entity_rows.filter(F.col("entity_type") == entity_type)
    rows = entity_rows.withColumn("num", annotated_number(F.col("word")))
    rows = rows.withColumn("_n", normalized_number(F.col("word")))
    return rows.select(
        *entity_rows.columns, "num", F.col("_n.norm").alias("norm"), F.col("_n.num").alias("norm_num")
    )


def gold_totals(entity_rows: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for every document id, NULL without a total; two totals give two rows.

    A semi and an anti join in place of one outer join: a document with very many
    totals is then on a side that the adaptive planner can split.
    """
    totals = entity_numbers(entity_rows, TOTAL_TYPE).select(
        "pmid", F.col("num").alias("tt_sample_size")
    )
    known = ids.select("pmid").distinct()
    without = known.join(totals.select("pmid").distinct(), "pmid", "left_anti")
    none = F.lit(None).cast(NUMBER).alias("tt_sample_size")
    return totals.join(known, "pmid", "left_semi").unionByName(without.select("pmid", none))


def loose_totals(entity_rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``(pmid, total, poss)``: the last total of the file and all possible totals.

    Numbers are made before the shuffle, and only they travel.
    """
    kinds = entity_rows.filter(F.col("entity_type").isin(TOTAL_TYPE, POSSIBLE_TYPE)).select(
        "pmid",
        "line_no",
        (F.col("entity_type") == TOTAL_TYPE).alias("is_total"),
        annotated_number(F.col("word")).alias("num"),
    )
    loose = kinds.groupBy("pmid").agg(
        F.max_by("num", F.when(F.col("is_total"), F.col("line_no"))).alias("total"),
        F.sort_array(F.collect_list(F.when(~F.col("is_total"), F.col("num")))).alias("poss"),
    )
    if ids is None:
        return loose
    empty = F.array().cast(f"array<{NUMBER}>")
    return (
        ids.select("pmid")
        .distinct()
        .join(loose, "pmid", "left")
        .select("pmid", "total", F.coalesce("poss", empty).alias("poss"))
    )


def section_text(sections: Column) -> Column:
    """Text of an array of ``(pos, label, text)`` structs, one line each; a section without text keeps its label."""
    lines = F.transform(
        F.sort_array(sections),
        lambda s: F.concat(
            F.when(s["label"].isNotNull(), F.concat(s["label"], F.lit(": "))).otherwise(""),
            F.coalesce(s["text"], F.lit("")),
            F.lit("\n"),
        ),
    )
    return F.array_join(lines, "")


def assemble_abstracts(titles: DataFrame, sections: DataFrame) -> DataFrame:
    """``TITLE: ...`` and the sections of each document as one text, records numbered from 1.

    Documents without sections are left out. One abstract is one row, so its
    sections are the only group ever held in memory. Numbers are made from the ids
    alone and joined on the key that the sections are grouped by, so the texts are
    exchanged once.
    """
    bodies = sections.groupBy("pmid").agg(
        section_text(F.collect_list(F.struct("pos", "label", "text"))).alias("_body")
    )
    kept = titles.select("pmid").join(sections.select("pmid").distinct(), "pmid", "left_semi")
    numbers = number_rows(kept, "pmid", out="record_no")
    abstract = F.concat(F.lit("TITLE: "), F.coalesce("title", F.lit("")), F.lit("\n"), F.col("_body"))
    return (
        bodies.join(titles, "pmid")
        .join(numbers, "pmid")
        .select("pmid", abstract.alias("abstract"), "record_no")
    )
