"""Extraction over a stream of documents.

The batch plan is row-local, so it runs on a stream as it is: no state, no
watermark, append mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from trialnum.operators.classifier import CandidateModel
from trialnum.plans.extraction import extract
from trialnum.sources.documents import DOCUMENTS


def extract_stream(
    spark: SparkSession, source: str, target: str, checkpoint: str, model: CandidateModel
) -> StreamingQuery:
    """Scores the parquet files arriving under ``source`` into ``target``, then stops when drained."""
    documents: DataFrame = spark.readStream.schema(DOCUMENTS).parquet(source)
    return (
        extract(documents, model)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(target)
    )
