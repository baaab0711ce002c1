"""Best candidate per document and the confidence thresholds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Least confidence for a candidate to be kept, and for its number to be reported.
KEEP_THRESHOLD = 0.25
REPORT_THRESHOLD = 0.2


def thresholded(num: Column, conf: Column, threshold: Column | float) -> Column:
    """The number if its confidence reaches the threshold, else NULL."""
    return F.when(conf >= threshold, num)


def best_of(scored: Column) -> Column:
    """Best of an array of structs with ``conf`` and ``idx``; the first wins a tie."""
    ranked = F.transform(
        scored, lambda c: F.struct(c["conf"].alias("conf"), (-c["idx"]).alias("at"), c["num"].alias("num"))
    )
    return F.array_max(ranked)


def _report(best: Column, keep: float, report: float) -> list[Column]:
    conf = F.when(best["conf"] >= keep, best["conf"])
    return [thresholded(best["num"], conf, report).alias("pred_ss"), conf.alias("conf")]


def best_in_row(
    documents: DataFrame,
    confidence: Callable[[Column], Column],
    keep: float = KEEP_THRESHOLD,
    report: float = REPORT_THRESHOLD,
) -> DataFrame:
    """``(pmid, pred_ss, conf)`` from documents with a ``candidates`` array.

    ``confidence`` scores one candidate struct. The whole plan is row-local: no
    shuffle, one output row per input row even where ids repeat, and it runs on
    streams without state.
    """
    scored = F.transform(
        "candidates",
        lambda c: F.struct(c["idx"].alias("idx"), c["num"].alias("num"), confidence(c).alias("conf")),
    )
    best = documents.withColumn("_scored", scored).withColumn("_best", best_of(F.col("_scored")))
    return best.select("pmid", *_report(F.col("_best"), keep, report))


def top_candidates(scored: DataFrame, keep: float = KEEP_THRESHOLD) -> DataFrame:
    """``(pmid, idx, num, conf)`` of the best candidate of each document that reaches ``keep``.

    From one row per candidate. ``max_by`` keeps one row per document and task
    before the shuffle, so neither long documents nor repeated ids pile up.
    """
    rank = F.struct(F.col("conf"), (-F.col("idx")).alias("at"))
    best = scored.groupBy("pmid").agg(F.max_by(F.struct("idx", "num", "conf"), rank).alias("_best"))
    return best.select("pmid", "_best.*").filter(F.col("conf") >= keep)


def extract_documents(
    documents: DataFrame,
    scored: DataFrame,
    keep: float = KEEP_THRESHOLD,
    report: float = REPORT_THRESHOLD,
) -> DataFrame:
    """``(pmid, pred_ss, conf)`` with a row for every row of ``documents``."""
    top = top_candidates(scored, keep)
    return documents.select("pmid").join(top, "pmid", "left").select(
        "pmid",
        thresholded(F.col("num"), F.col("conf"), report).alias("pred_ss"),
        "conf",
    )
