"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is written whole to the noop sink. The first run warms the JVM up, the
better of the next two counts.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import DataFrame, SparkSession

from trialnum.catalog.queries import QUERIES

HEADLINE = [
    "thousands_join_documents", "number_normalize", "number_normalize_documents", "tokenize_documents",
    "candidates", "features", "features_documents", "top_candidate", "extract_all_docs", "extract_documents",
    "encode_words", "vocab_topk", "unk_rewrite", "eval_exact", "eval_exact_cv", "eval_loose", "eval_loose_cv",
    "match_rows_exact", "gold_per_doc", "loose_dict", "assemble_sections", "even_fold_sizes",
]


def seconds(df: DataFrame) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        seconds(QUERIES[name](spark, folder))
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            df = QUERIES[name](spark, folder)
            planned = time.perf_counter() - start
            runs.append(planned + seconds(df))
        times[name] = round(min(runs), 3)
    sf = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf.group(1)) if sf else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
