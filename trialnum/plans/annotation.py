"""From a folder of standoff files to gold and loose-match tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialnum.operators.annotations import entities, gold_totals, loose_totals, nested, relations
from trialnum.sources.standoff import read_document_ids, read_standoff_lines


def annotation_tables(spark: SparkSession, folder: str, documents: DataFrame | None = None) -> dict[str, DataFrame]:
    """Entities, relations, both nested per document, gold totals and loose totals.

    Documents are those of the folder's file names, empty files too, and of ``documents (pmid)`` if given.
    """
    lines = read_standoff_lines(spark, folder)
    ids = read_document_ids(spark, folder)
    if documents is not None:
        ids = ids.unionByName(documents.select(F.col("pmid").cast("string").alias("pmid"))).distinct()
    entity_rows, relation_rows = entities(lines), relations(lines)
    return {
        "entities": entity_rows,
        "relations": relation_rows,
        "entities_nested": nested(entity_rows, ids),
        "relations_nested": nested(relation_rows, ids),
        "gold": gold_totals(entity_rows, ids),
        "loose": loose_totals(entity_rows, ids),
    }
