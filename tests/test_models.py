import numpy as np
import pytest
from pyspark.sql import functions as F

from trialnum.catalog import fixtures as fx
from trialnum.operators.candidates import build_candidates, explode_candidates
from trialnum.operators.classifier import CandidateModel, arrow_scorer, fit_classifier, prepare_vectors
from trialnum.operators.evaluate import evaluate_exact, evaluate_exact_cv
from trialnum.operators.labels import labelled_candidates
from trialnum.operators.numbering import assign_folds
from trialnum.plans import training
from trialnum.plans.extraction import extract
from trialnum.streaming.extraction import extract_stream

SMALL = {"dim": 4, "hidden": [8], "max_iter": 25}


@pytest.fixture(scope="module")
def docs(spark, small):
    return fx.trial_abstracts(spark, small).persist()


@pytest.fixture(scope="module")
def model(docs):
    return training.train(docs, **SMALL)


def inside(df, scorer):
    docs = build_candidates(df).withColumn("c", scorer(F.col("candidates")))
    rows = docs.select("pmid", F.explode_outer(F.arrays_zip("candidates.idx", "c")).alias("z"))
    return {(r["pmid"], r["z"]["idx"]): r["z"]["c"] for r in rows.collect() if r["z"]}


@pytest.mark.parametrize("kind", ["mlp", "logistic"])
def test_both_ways_of_scoring_agree(docs, model, kind):
    m = model if kind == "mlp" else training.train(docs, kind="logistic", dim=4, max_iter=5)
    part = docs.filter("pmid % 3 = 0")
    rows = m.score_rows(explode_candidates(build_candidates(part)))
    want = {(r["pmid"], r["idx"]): r["conf"] for r in rows.collect()}
    for slice_rows in (8192, 7):
        got = inside(part, arrow_scorer(m, slice_rows))
        assert got.keys() == want.keys()
        assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_learns_and_extracts(docs, model):
    pred = extract(docs, model)
    assert pred.count() == docs.count()
    gold = docs.select("pmid", "tt_sample_size", "fold_id")
    assert evaluate_exact(gold, pred).first()["recall"] > 0.9


def test_extraction_has_no_shuffle_and_keeps_repeated_ids(spark, model):
    rows = [(1, "50 patients were enrolled"), (1, "no number"), (2, None)]
    df = spark.createDataFrame(rows, "pmid long, abstract string")
    out = extract(df, model)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["pmid"] for r in out.collect()) == [1, 1, 2]


def test_training_repeats(docs, model):
    again = training.train(docs, **SMALL)
    assert np.allclose(again.weights, model.weights, atol=1e-4)


def test_save_load_and_fine_tune(spark, docs, model, tmp_path):
    model.save(str(tmp_path / "m"))
    loaded = CandidateModel.load(spark, str(tmp_path / "m"))
    part = docs.filter("pmid < 100")
    order = lambda m: [tuple(r) for r in extract(part, m).orderBy("pmid").collect()]
    assert order(loaded) == order(model)
    tuned = training.train(docs, pretrained=loaded, hidden=[8], max_iter=1)
    fresh = training.train(docs, dim=4, hidden=[8], max_iter=1)
    close = lambda m: np.abs(m.weights - model.weights).mean()
    assert close(tuned) < close(fresh)


def test_pretrain_holds_documents_out(docs):
    _, held = training.pretrain(docs, holdout=0.2, kind="logistic", dim=4, max_iter=2)
    assert 0 < held.count() < docs.count() / 2


def test_cross_validation(docs):
    plain = docs.drop("fold_id")
    pred = training.cross_validate(plain, k=3, kind="logistic", dim=4, max_iter=8).persist()
    gold = training.gold_with_folds(plain, k=3)
    assert pred.count() == plain.count()
    assert pred.join(gold, ["pmid", "fold_id"]).count() == plain.count()
    assert evaluate_exact_cv(gold, pred.drop("fold_id")).count() == 3


def test_fitted_word_vectors(docs):
    rows = prepare_vectors(docs.filter("pmid < 200"), dim=3, max_features=50, word2vec=True).collect()
    assert len(rows) == 50 and all(len(r["vec"]) == 3 for r in rows)


def test_stream_gives_the_batch_result(spark, docs, model, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    part = docs.filter("pmid < 300").select("pmid", "abstract")
    part.repartition(3).write.parquet(source)
    extract_stream(spark, source, target, str(tmp_path / "ck"), model).awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(target).collect())
    assert got == sorted(tuple(r) for r in extract(part, model).collect())


def test_cross_validation_reads_the_texts_once_and_equals_one_model_per_fold(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = [(i, f"We enrolled {20 + i} patients aged 18 to {40 + i % 9} years.", 20 + i) for i in range(60)]
    spark.createDataFrame(rows, "pmid long, abstract string, tt_sample_size long").write.parquet(path)
    docs = spark.read.parquet(path)
    got = training.cross_validate(docs, k=3, kind="logistic", dim=4, max_iter=4)
    assert got._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    found = {r["pmid"]: (r["fold_id"], r["conf"]) for r in got.collect()}
    assert len(found) == 60 and {f for f, _ in found.values()} == {0, 1, 2}
    folded, vectors = assign_folds(docs, k=3), prepare_vectors(docs, 4)
    labelled = labelled_candidates(folded, normalize=True)
    for fold in range(3):
        model = fit_classifier(labelled.filter(f"fold_id <> {fold}"), vectors, 4, kind="logistic", max_iter=4)
        one = extract(folded.filter(f"fold_id = {fold}"), model).collect()
        assert all(abs((r["conf"] or 0) - (found[r["pmid"]][1] or 0)) < 1e-6 for r in one)


def test_weights_that_cannot_be_used_are_refused(spark):
    docs = spark.createDataFrame([(i, f"{20 + i} of 7", 20 + i) for i in range(20)], "pmid long, abstract string, tt_sample_size long")
    model = training.train(docs, kind="logistic", dim=2, max_iter=2)
    with pytest.raises(ValueError):
        _ = model.weights


def test_network_as_columns_equals_the_fitted_models(docs, model):
    from trialnum.operators.classifier import _layers, network_scorer
    from trialnum.operators.network import candidate_confidence
    from trialnum.operators.vocabulary import embed_documents

    logistic = training.train(docs, kind="logistic", dim=4, max_iter=5)
    part = docs.filter("pmid % 5 = 0")
    for m in (model, logistic):
        rows = explode_candidates(embed_documents(build_candidates(part), m.vectors, 4))
        candidate = F.struct("left_vec", "right_vec", "left_pos", "right_pos", "other")
        rows = rows.select("pmid", "idx", candidate_confidence(candidate, _layers(m), 4).alias("conf"))
        got = {(r["pmid"], r["idx"]): r["conf"] for r in rows.collect()}
        want = inside(part, network_scorer(_layers(m), m.vectors, 4))
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_vectors_too_many_for_every_task_are_refused(docs, model, monkeypatch):
    from trialnum.operators import classifier

    monkeypatch.setattr(classifier, "LOOKUP_BYTES", 10)
    with pytest.raises(ValueError):
        arrow_scorer(model)
