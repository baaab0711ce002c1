import math
import zlib

import numpy as np

from trialnum.llm import quality


def accuracy(rows, labels, column):
    held = [(r, labels[r.id]) for r in rows if r.held_out and r.id in labels]
    return sum(r.predicted == labels[r.id] for r, _ in held) / len(held)


def test_log_density_difference_equals_the_plain_formula():
    rng = np.random.default_rng(1)
    x = {k: rng.normal(k, 1 + k, (200, quality.FEATURES)) for k in (0, 1)}
    of = {k: (len(v), v.mean(0), np.cov(v.T, bias=True)) for k, v in x.items()}
    model = quality.Discriminant(of, common=0, diagonal=0, evidence=0)
    probe = np.abs(rng.normal(1, 2, (20, quality.FEATURES)))
    plain = np.zeros(20)
    for k, sign in ((1, 1), (0, -1)):
        c = of[k][2] + 1e-6 * np.eye(quality.FEATURES)
        m = probe - of[k][1]
        plain += sign * (-0.5 * np.einsum("ij,jk,ik->i", m, np.linalg.inv(c), m) - 0.5 * np.linalg.slogdet(c)[1])
    assert np.allclose(model.log_odds(probe) - model.prior, plain)


def test_held_out_accuracy_and_edge_cases(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (None, "x"), (10**6 + 2, "long " * 200_000), (10**6 + 2, "long " * 200_000)], "doc_id long, text string")
    docs = docs.unionByName(extra).selectExpr("*", "'clash' AS score", "1 AS x")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    some = spark.createDataFrame([(None, 1), (3, None), (5 * 10**6, 1)], "doc_id long, quality int")
    rows = quality.quality_scores(docs, labels.select("doc_id", "quality").unionByName(some)).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and not math.isnan(r.score) and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (r.id is not None and zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert accuracy(rows, truth, "quality") > 0.95
    assert quality.quality_scores(docs.where("false"), labels).count() == 0
    assert {r.score for r in quality.quality_scores(extra, labels.where("false")).collect()} == {0.5}
