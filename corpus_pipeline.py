"""The corpus pipeline: stages over documents, each written as Parquet and read again."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialnum.llm.exact_dedup import drop_duplicates
from trialnum.llm.mixing import mix_sources
from trialnum.llm.packing import pack
from trialnum.llm.quality import quality_scores
from trialnum.llm.shared import shared_dir
from trialnum.llm.simhash import drop_near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Rows are told by id and hash of the text.

    Null and empty texts are scored as texts without words, null ids as ids like others; repeated rows stay or go
    together. An empty table gives no rows; other columns are left out.
    """
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = quality_scores(docs, labels, "quality", threshold=0.7).where("predicted = 1").select("id", "hash").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("hash"))
    return docs.join(good, same, "left_semi").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    Null text is the empty one; a null id stays only if its text has no other; of repeated rows one stays. An empty table
    gives no rows; other columns are left out.
    """
    return drop_duplicates(docs, keep="largest").select(*COLUMNS)


def near_deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of SimHash fingerprints connect, the one with the smallest doc_id stays.

    Null and empty texts have the fingerprint zero and are linked like others, so one of them stays; of repeated rows one
    stays. Texts of any length are read whole. An empty table gives no rows; other columns are left out.
    """
    return drop_near_duplicates(docs, shingle=3, budget=3).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.

    Null source is a source of its own, null text has no words. Repeated rows are taken each by themselves. An empty table gives no
    rows; other columns are left out.
    """
    mixed = mix_sources(docs, carry=tuple(COLUMNS)).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and place.

    Null and empty texts are the end token alone, long texts are cut into pieces; repeated rows are packed each. An
    empty table gives no rows; other columns are left out.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("quality", keep_good), ("exact dedup", deduplicate), ("near dedup", near_deduplicate), ("mixing", mix), ("packing", pack_documents),
]
ORACLE_SQL = None  # trained scores, fingerprints and tokens: tested against a brute-force version instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
