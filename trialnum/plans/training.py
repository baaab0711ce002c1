"""Training, fine-tuning and cross-validation."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialnum.operators.candidates import build_candidates
from trialnum.operators.classifier import CandidateModel, fit_classifier, fit_counted_network, fold_scorer, prepare_vectors
from trialnum.operators.copies import counted, once_per_text
from trialnum.operators.evaluate import evaluate_exact
from trialnum.operators.labels import labelled_candidates
from trialnum.operators.numbering import assign_folds
from trialnum.operators.scoring import KEEP_THRESHOLD, REPORT_THRESHOLD
from trialnum.operators.tables import spread, written
from trialnum.plans.extraction import best_numbers, extract

# Documents from which on a model is trained on distinct texts with their counts. The objective is that of all rows, but
# for MLlib's standard deviations of a logistic model, which divide by W - sum(w^2) / W in place of W - 1 (w: counts, W:
# their sum), and for the perceptron's mean, which MLlib takes over blocks of 128 rows, of which a partition's last is smaller.
COUNTED_FROM = 500_000


def train(
    documents: DataFrame,
    normalize: bool = True,
    dim: int = 16,
    vectors: DataFrame | None = None,
    word2vec: bool = False,
    pretrained: CandidateModel | None = None,
    text_options: dict | None = None,
    counted_from: int = COUNTED_FROM,
    **options,
) -> CandidateModel:
    """Fits a model on ``(pmid, abstract, tt_sample_size)``.

    ``text_options`` are a tokenizer or tagger, the same as later given to ``extract``.

    ``pretrained`` starts from another model's weights and vectors. The candidate
    rows are kept for the iterations; they are small, the texts are read once.
    From ``counted_from`` documents on, a model is trained on distinct labelled texts that count as often as
    they occur, see ``COUNTED_FROM``.
    """
    weighted = documents.count() >= counted_from
    if pretrained is not None:
        vectors_table, dim = pretrained.vectors, pretrained.dim
        options["initial_weights"] = pretrained.weights
    else:
        vectors_table = prepare_vectors(documents, dim, vectors=vectors, word2vec=word2vec, copies=weighted)
    if weighted:
        documents = spread(written(counted(documents, "abstract", "tt_sample_size")), "abstract")
    rows = labelled_candidates(documents, normalize=normalize, **(text_options or {}))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fitted(rows, vectors_table, dim, weighted, **options)
    finally:
        rows.unpersist()


def _fitted(rows: DataFrame, vectors: DataFrame, dim: int, weighted: bool, **options) -> CandidateModel:
    """A model of rows that count once each or, ``weighted``, as often as ``copies`` says."""
    if not weighted:
        return fit_classifier(rows, vectors, dim, **options)
    if options.get("kind", "mlp") == "logistic":
        return fit_classifier(rows, vectors, dim, copies="copies", **options)
    return fit_counted_network(rows, vectors, dim, "copies", **{k: v for k, v in options.items() if k != "kind"})


def pretrain(documents: DataFrame, holdout: float = 0.1, seed: int = 0, **options) -> tuple[CandidateModel, DataFrame]:
    """Trains on all but a hashed share of the documents; returns model and held-out documents."""
    bucket = F.pmod(F.xxhash64("pmid", F.lit(seed)), F.lit(1000))
    limit = round(holdout * 1000)
    return train(documents.filter(bucket >= limit), seed=seed, **options), documents.filter(bucket < limit)


def holdout_metrics(model: CandidateModel, held_out: DataFrame, **text_options) -> DataFrame:
    """Exact-match metrics of a model on documents that it was not trained on."""
    return evaluate_exact(held_out.select("pmid", "tt_sample_size"), extract(held_out, model, **text_options))


def gold_with_folds(documents: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """``(pmid, tt_sample_size, fold_id)``."""
    return assign_folds(documents, k=k, seed=seed).select("pmid", "tt_sample_size", "fold_id")


def cross_validate(
    documents: DataFrame,
    k: int = 5,
    seed: int = 0,
    normalize: bool = True,
    dim: int = 16,
    pretrained: CandidateModel | None = None,
    vocabulary_per_fold: bool = False,
    text_options: dict | None = None,
    counted_from: int = COUNTED_FROM,
    **options,
) -> DataFrame:
    """``(pmid, pred_ss, conf, fold_id)``, every document scored by the model of the other folds.

    Candidate rows are built once and filtered per fold. The vocabulary covers all
    texts, test folds too, unless ``vocabulary_per_fold``. From ``counted_from`` documents on, a model is
    trained as in ``train`` says, and equal texts of a fold are scored once.
    """
    folded = assign_folds(documents, k=k, seed=seed)
    text_options = text_options or {}
    weighted = documents.count() >= counted_from
    labelled = folded
    if weighted:
        labelled = spread(written(counted(folded, "abstract", "tt_sample_size", "fold_id")), "abstract")
    rows = labelled_candidates(labelled, normalize=normalize, **text_options)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    if pretrained is not None:
        dim, options["initial_weights"] = pretrained.dim, pretrained.weights
    shared = pretrained.vectors if pretrained is not None else None
    if shared is None and not vocabulary_per_fold:
        shared = prepare_vectors(documents, dim, copies=weighted)
    models = []
    for fold in range(k):
        vectors = shared
        if vectors is None:
            vectors = prepare_vectors(folded.filter(F.col("fold_id") != fold), dim)
        others = rows.filter(F.col("fold_id") != fold)
        models.append(_fitted(others, vectors, dim, weighted, seed=seed, **options))
    scorer = fold_scorer(models)
    rows.unpersist()

    # one pass over the texts, whatever the number of folds
    def best(docs: DataFrame, key: str) -> DataFrame:
        docs = build_candidates(docs, keep_text=key == "abstract", **text_options)
        docs = docs.withColumn("_conf", scorer(F.col("fold_id"), F.col("candidates")))
        return best_numbers(docs, KEEP_THRESHOLD, REPORT_THRESHOLD, "fold_id", key=key)

    docs = folded.select("pmid", "abstract", "fold_id")
    if not weighted:
        return best(docs, "pmid")
    rows = once_per_text(docs, lambda texts: best(texts, "abstract"), "abstract", "fold_id")
    return rows.select("pmid", "pred_ss", "conf", "fold_id")
