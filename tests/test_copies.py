"""Texts that many rows share: worked out once, same results for all rows."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from trialnum.operators.candidates import build_candidates, explode_candidates
from trialnum.operators.classifier import fit_classifier, prepare_vectors
from trialnum.operators.copies import counted, once_per_text
from trialnum.operators.counted_network import mean_loss, minimised
from trialnum.operators.labels import labelled_candidates
from trialnum.operators.tables import spread
from trialnum.operators.vocabulary import word_counts
from trialnum.plans.extraction import extract
from trialnum.plans.training import train

TEXTS = ["A total of 40 patients, 30 men and 10 women.", "twenty-five adults (n=25) in 2019", "none", "", None]


def _documents(spark, rows=60):
    data = [(k if k % 7 else None, TEXTS[k % 5], 40 if k % 2 else None) for k in range(rows)] * 2
    return spark.createDataFrame(data, "pmid bigint, abstract string, tt_sample_size bigint")


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_once_per_text_equals_row_by_row(spark):
    docs = _documents(spark).select("pmid", "abstract")
    names = ["pmid", "idx", "num", "left_word", "left_pos", "other"]
    plain = explode_candidates(build_candidates(docs)).select(*names)
    work = lambda t: explode_candidates(build_candidates(t, keep_text=True)).select("abstract", *names[1:])
    assert _rows(once_per_text(docs, work).select(*names)) == _rows(plain)
    assert _rows(plain)


def test_work_sees_every_text_once(spark):
    seen = []

    def work(texts):
        seen.extend(r["abstract"] for r in texts.collect())
        return texts.withColumn("n", F.length("abstract"))

    rows = once_per_text(_documents(spark), work)
    assert len(seen) == len(TEXTS) and set(seen) == set(TEXTS)
    assert rows.count() == 120 and rows.columns == ["pmid", "tt_sample_size", "n"]


def test_words_of_copies_are_counted_as_often(spark):
    docs = _documents(spark)
    assert _rows(word_counts(docs, copies=True)) == _rows(word_counts(docs))


def test_partitions_follow_the_rows(spark):
    assert spread(spark.range(1000, numPartitions=1), "id", 100).rdd.getNumPartitions() == 10
    assert spread(spark.range(1000, numPartitions=1), "id").rdd.getNumPartitions() == 4


def test_counted_texts_train_nearly_the_same_model(spark):
    data = [(k, f"A total of {20 + k % 150} patients, {k % 90} men in 2019.", 20 + k % 150) for k in range(450)] * 3
    docs = spark.createDataFrame(data, "pmid bigint, abstract string, tt_sample_size bigint")
    options = {"kind": "logistic", "dim": 4, "max_iter": 10}
    every, once = train(docs, **options), train(docs, counted_from=0, **options)
    a, b = (m.pipeline.stages[-1].coefficients.toArray() for m in (every, once))
    assert abs(a - b).max() < 0.02 * abs(a).max()
    assert once.pipeline.stages[-1].summary.weightCol == "copies" and every.pipeline.stages[-1].summary.weightCol != "copies"


def test_network_refuses_counts(spark):
    docs = counted(_documents(spark), "abstract", "tt_sample_size")
    with pytest.raises(ValueError):
        fit_classifier(labelled_candidates(docs), prepare_vectors(_documents(spark), 4), 4, copies="copies")


def test_counted_network_equals_the_network_of_all_rows(spark):
    data = [(k, f"A total of {20 + k % 50} patients, {k % 30} men in 2019.", 20 + k % 50) for k in range(300)] * 2
    docs = spark.createDataFrame(data, "pmid bigint, abstract string, tt_sample_size bigint").coalesce(1)
    options = {"dim": 4, "hidden": [5], "max_iter": 3}
    every, once = train(docs, **options), train(docs, counted_from=0, **options)
    assert once.pipeline.stages[-1].getLayers() == every.pipeline.stages[-1].getLayers()
    assert abs(once.weights - every.weights).max() < 0.02 * abs(every.weights).max()
    on = train(docs, counted_from=0, pretrained=once, hidden=[5], max_iter=0)
    assert (on.weights == once.weights).all()


def test_gradient_of_counted_rows(spark):
    rng = np.random.default_rng(3)
    data = [(Vectors.dense(rng.normal(size=3)), float(k % 2), k % 4 + 1) for k in range(9)]
    loss = mean_loss(spark.createDataFrame(data, ["features", "label", "copies"]), [3, 4, 2], "copies")
    w = rng.normal(size=3 * 4 + 4 + 4 * 2 + 2)
    value, gradient = loss(w)
    step = 1e-5 * np.eye(len(w))
    assert all(abs((loss(w + step[k])[0] - loss(w - step[k])[0]) / 2e-5 - gradient[k]) < 1e-8 for k in (0, 5, 13, 17, 25))
    each = spark.createDataFrame([(x, y, 1) for x, y, n in data for _ in range(n)], ["features", "label", "copies"])
    assert abs(mean_loss(each, [3, 4, 2], "copies")(w)[0] - value) < 1e-12


def test_minimum_of_a_valley():
    def valley(x):
        a, b = 1 - x[0], x[1] - x[0] ** 2
        return a * a + 100 * b * b, np.array([-2 * a - 400 * b * x[0], 200 * b])

    assert abs(minimised(valley, np.array([-1.2, 1.0]), 100) - 1).max() < 1e-3


def test_equal_texts_are_extracted_once_with_the_same_result(spark):
    docs = _documents(spark)
    model = train(docs, dim=2, hidden=[3], max_iter=2)
    rows = [extract(docs, model, keep=0.0, report=0.0, once=o).withColumn("conf", F.round("conf", 12)) for o in (True, False)]
    assert _rows(rows[0]) == _rows(rows[1]) and rows[0].count() == 120
