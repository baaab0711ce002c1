"""Documents in, ``(pmid, pred_ss, conf)`` out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialnum.functions.tokens import tag_token
from trialnum.operators.candidates import ColumnFunction, build_candidates
from trialnum.operators.classifier import CandidateModel
from trialnum.operators.copies import once_per_text
from trialnum.operators.scoring import KEEP_THRESHOLD, REPORT_THRESHOLD, best_of, thresholded


def extract(
    documents: DataFrame,
    model: CandidateModel,
    keep: float = KEEP_THRESHOLD,
    report: float = REPORT_THRESHOLD,
    tokenizer: ColumnFunction | None = None,
    tagger: ColumnFunction | None = tag_token,
    array_tagger: ColumnFunction | None = None,
    lexicon: DataFrame | None = None,
    once: bool = False,
) -> DataFrame:
    """Best number of every document, one output row per input row.

    One narrow stage from scan to result, whatever the size of the corpus: the text
    is dropped as soon as its candidates are known, and nothing is exchanged. With ``once``, for corpora whose texts
    repeat, equal texts are scored once and joined back.
    """

    def best(docs: DataFrame, key: str) -> DataFrame:
        docs = build_candidates(
            docs,
            tokenizer=tokenizer,
            tagger=tagger,
            array_tagger=array_tagger,
            lexicon=lexicon,
            keep_text=key == "abstract",
        )
        return best_numbers(docs.withColumn("_conf", model.confidences(F.col("candidates"))), keep, report, key=key)

    docs = documents.select("pmid", "abstract")
    return once_per_text(docs, lambda texts: best(texts, "abstract")) if once else best(docs, "pmid")


def best_numbers(
    docs: DataFrame, keep: float = KEEP_THRESHOLD, report: float = REPORT_THRESHOLD, *more: str, key: str = "pmid"
) -> DataFrame:
    """``(pmid, pred_ss, conf)`` and the columns ``more`` of documents with ``candidates`` and their ``_conf``."""
    scored = F.transform(
        "candidates",
        lambda c, i: F.struct(
            c["idx"].alias("idx"), c["num"].alias("num"), F.get("_conf", i).alias("conf")
        ),
    )
    best = docs.select(key, *more, best_of(scored).alias("_best"))
    conf = F.when(F.col("_best.conf") >= keep, F.col("_best.conf"))
    return best.select(
        key, thresholded(F.col("_best.num"), conf, report).alias("pred_ss"), conf.alias("conf"), *more
    )
