"""Candidate classifier: MLlib training, and scoring by rows or inside each document.

Training and row scoring are an MLlib pipeline. For whole corpora ``confidences``
runs the fitted network over the candidate arrays with Arrow, so a document never
leaves its task: no explode, no word-table joins, no shuffle by document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialnum.functions.features import OTHER_FEATURES
from trialnum.functions.tokens import TAGS
from trialnum.operators.counted_network import mean_loss, minimised
from trialnum.operators.lookup import LOOKUP_BYTES, table_bytes
from trialnum.operators.vocabulary import (
    MAX_FEATURES,
    embed_words,
    fit_vocabulary,
    unknown_rewritten,
    vocabulary_vectors,
)

HIDDEN = [128, 64]


def one_hot_tags(rows: DataFrame) -> DataFrame:
    """Adds ``left_hot`` and ``right_hot`` over the 56 tags; unknown tags give zeros."""
    stages = _tag_stages()
    return Pipeline(stages=stages).fit(rows).transform(rows).drop("_left_tag", "_right_tag")


def _tag_stages() -> list:
    indexer = StringIndexerModel.from_arrays_of_labels(
        [TAGS, TAGS],
        inputCols=["left_pos", "right_pos"],
        outputCols=["_left_tag", "_right_tag"],
        handleInvalid="keep",
    )
    # "keep" puts unknown tags last and dropLast drops that slot
    encoder = OneHotEncoder(
        inputCols=["_left_tag", "_right_tag"], outputCols=["left_hot", "right_hot"], dropLast=True
    )
    return [indexer, encoder]


def model_inputs(candidates: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Candidate rows with the vector columns that the pipeline reads."""
    rows = embed_words(candidates, vectors, dim)
    for name in ("left_vec", "right_vec"):
        rows = rows.withColumn(name, array_to_vector(name))
    return rows.withColumn("other_vec", array_to_vector("other"))


def fit_word_vectors(
    docs: DataFrame, vocabulary: DataFrame, dim: int, text: str = "abstract", seed: int = 0
) -> DataFrame:
    """``(token, vec)`` from Word2Vec on texts rewritten to the vocabulary, which bounds its size."""
    parts = docs.sparkSession.sparkContext.defaultParallelism
    texts = unknown_rewritten(docs.select(text), vocabulary, text, "_rewritten")
    words = F.filter(F.split("_rewritten", " "), lambda w: w != "")
    fitted = Word2Vec(
        vectorSize=dim, minCount=1, seed=seed, numPartitions=parts, inputCol="words", outputCol="_v"
    ).fit(texts.select(words.alias("words")))
    return fitted.getVectors().select(
        F.col("word").alias("token"), vector_to_array("vector", "float32").alias("vec")
    )


@dataclass
class CandidateModel:
    """A fitted pipeline with the vocabulary vectors it was trained on."""

    pipeline: PipelineModel
    vectors: DataFrame
    dim: int

    def score_rows(self, candidates: DataFrame) -> DataFrame:
        """Candidate rows with ``conf``, all documents in one pass."""
        rows = self.pipeline.transform(model_inputs(candidates, self.vectors, self.dim))
        conf = vector_to_array("probability")[1]
        return rows.select(*candidates.columns, conf.alias("conf"))

    def confidences(self, candidates: Column) -> Column:
        """Confidences along a ``candidates`` array, see ``arrow_scorer``."""
        return arrow_scorer(self)(candidates)

    @property
    def weights(self) -> np.ndarray:
        """Flat network weights, to start another training from."""
        stage = self.pipeline.stages[-1]
        if not hasattr(stage, "weights"):
            raise ValueError("only a network has weights to go on from")
        return stage.weights.toArray()

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CandidateModel:
        schema = "token string, id int, vec array<float>"
        vectors = spark.read.schema(schema).parquet(f"{path}/vectors")
        dim = len(vectors.select("vec").first()["vec"])
        return cls(PipelineModel.load(f"{path}/pipeline"), vectors, dim)


def fit_classifier(
    labelled: DataFrame,
    vectors: DataFrame,
    dim: int,
    kind: str = "mlp",
    hidden: list[int] | None = None,
    max_iter: int = 10,
    seed: int = 0,
    initial_weights: np.ndarray | None = None,
    copies: str | None = None,
) -> CandidateModel:
    """Trains on labelled candidate rows; ``initial_weights`` continues an earlier training.

    A row counts as often as the column ``copies`` says; only the logistic model takes such rows.
    """
    inputs = _fit_inputs(labelled, vectors, dim, copies)
    if kind == "logistic":
        if initial_weights is not None:
            raise ValueError("a logistic model cannot start from given weights")
        classifier = LogisticRegression(maxIter=max_iter, regParam=1e-4)
        if copies is not None:
            classifier = classifier.setWeightCol(copies)
    else:
        if copies is not None:
            raise ValueError("MLlib trains a network on rows that count once each, see fit_counted_network")
        classifier = _perceptron(dim, hidden, max_iter, seed, initial_weights)
    pipeline = Pipeline(stages=[*_tag_stages(), _assembler(), classifier]).fit(inputs)
    return CandidateModel(pipeline, vectors, dim)


def _fit_inputs(labelled: DataFrame, vectors: DataFrame, dim: int, copies: str | None) -> DataFrame:
    return model_inputs(labelled, vectors, dim).select(
        "left_vec", "right_vec", "left_pos", "right_pos", "other_vec", "label", *([copies] if copies else [])
    )


def _assembler() -> VectorAssembler:
    return VectorAssembler(
        inputCols=["left_vec", "right_vec", "left_hot", "right_hot", "other_vec"],
        outputCol="features",
    )


def _perceptron(
    dim: int, hidden: list[int] | None, max_iter: int, seed: int, initial_weights: np.ndarray | None
) -> MultilayerPerceptronClassifier:
    width = 4 * dim + 2 * len(TAGS) + len(OTHER_FEATURES)
    layers = [width, *(HIDDEN if hidden is None else hidden), 2]
    classifier = MultilayerPerceptronClassifier(layers=layers, maxIter=max_iter, seed=seed)
    return classifier if initial_weights is None else classifier.setInitialWeights(initial_weights.tolist())


def fit_counted_network(
    labelled: DataFrame,
    vectors: DataFrame,
    dim: int,
    copies: str,
    hidden: list[int] | None = None,
    max_iter: int = 10,
    seed: int = 0,
    initial_weights: np.ndarray | None = None,
) -> CandidateModel:
    """As ``fit_classifier`` for a network, where a row counts as often as the column ``copies`` says.

    MLlib's perceptron takes no weights. So its start is taken from it (a training of no iterations), the weights that
    ``counted_network`` finds from there are given back in the same way, and the model is an MLlib pipeline like any other.
    """
    inputs = _fit_inputs(labelled, vectors, dim, copies)
    prepared = Pipeline(stages=[*_tag_stages(), _assembler()]).fit(inputs)
    rows = prepared.transform(inputs).select("features", "label", copies).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        some = rows.limit(1)
        start = _perceptron(dim, hidden, 0, seed, initial_weights).fit(some)
        loss = mean_loss(rows, start.getLayers(), copies)
        weights = minimised(loss, start.weights.toArray(), max_iter)
        network = _perceptron(dim, hidden, 0, seed, weights).fit(some)
    finally:
        rows.unpersist()
    return CandidateModel(PipelineModel([*prepared.stages, network]), vectors, dim)


def prepare_vectors(
    docs: DataFrame,
    dim: int = 16,
    max_features: int = MAX_FEATURES,
    vectors: DataFrame | None = None,
    word2vec: bool = False,
    text: str = "abstract",
    copies: bool = False,
) -> DataFrame:
    """Vocabulary of ``docs`` with a vector per word: given, fitted or drawn from a hash.

    Kept in memory: at most ``max_features`` rows that every later step reads.
    """
    vocabulary = fit_vocabulary(docs, text=text, max_features=max_features, copies=copies)
    if word2vec:
        vectors = fit_word_vectors(docs, vocabulary, dim, text)
    return vocabulary_vectors(vocabulary, dim, vectors).persist()


def _layers(model: CandidateModel) -> list[tuple[np.ndarray, np.ndarray]]:
    """(matrix, bias) of every layer of the fitted classifier."""
    stage = model.pipeline.stages[-1]
    if not hasattr(stage, "weights"):
        return [(stage.coefficientMatrix.toArray(), stage.interceptVector.toArray())]
    sizes, flat, at, layers = stage.getLayers(), stage.weights.toArray(), 0, []
    for n_in, n_out in zip(sizes, sizes[1:]):
        matrix = flat[at : at + n_in * n_out].reshape((n_out, n_in), order="F")
        at += n_in * n_out
        layers.append((matrix, flat[at : at + n_out]))
        at += n_out
    return layers


def _confidence_function(
    layers: list[tuple[np.ndarray, np.ndarray]], vectors_table: DataFrame, dim: int, slice_rows: int = 8192
):
    """A function of an Arrow array of ``candidates`` arrays to their confidences.

    Words and tags are looked up by Arrow over the whole batch and the network is a
    few matrix products. What ships with the task is the network and the vocabulary
    vectors, bounded by the ``max_features`` they were made with. The function names nothing of this package,
    so workers need only NumPy and Arrow.
    """
    table = vectors_table.select("token", "vec").collect()
    words = pa.array([r["token"] for r in table], pa.string())
    # last row: unknown words and tags
    vectors = np.zeros((len(table) + 1, dim))
    vectors[:-1] = np.array([r["vec"] for r in table], dtype="float64").reshape(-1, dim)
    tags = pa.array(TAGS, pa.string())
    tag_rows = np.vstack([np.eye(len(TAGS)), np.zeros(len(TAGS))])

    def rows_of(values: pa.Array, known: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(values, value_set=known), len(known)).to_numpy()

    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-x))

    def forward(x: np.ndarray) -> np.ndarray:
        for matrix, bias in layers[:-1]:
            x = sigmoid(x @ matrix.T + bias)
        matrix, bias = layers[-1]
        z = x @ matrix.T + bias
        # two outputs: softmax of the second, which is the sigmoid of their difference
        return sigmoid(z[:, 1] - z[:, 0]) if z.shape[1] == 2 else sigmoid(z[:, 0])

    def score(flat: pa.StructArray) -> np.ndarray:
        parts = [
            vectors[rows_of(flat.field(side).flatten(), words)].reshape(len(flat), 2 * dim)
            for side in ("left_word", "right_word")
        ]
        parts += [tag_rows[rows_of(flat.field(side), tags)] for side in ("left_pos", "right_pos")]
        parts.append(flat.field("other").flatten().to_numpy().reshape(len(flat), -1))
        return forward(np.hstack(parts))

    def confidences(candidates: pa.Array) -> pa.Array:
        flat = candidates.flatten()
        # in slices, so that memory does not grow with the candidates of a batch
        slices = [score(flat.slice(at, slice_rows)) for at in range(0, len(flat), slice_rows)]
        conf = np.concatenate(slices) if slices else np.zeros(0)
        lengths = pc.fill_null(pc.list_value_length(candidates), 0).to_numpy()
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("int32")
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(conf, pa.float64()))

    return confidences


def arrow_scorer(model: CandidateModel, slice_rows: int = 8192):
    """Arrow UDF: a ``candidates`` array to the array of its confidences, ``slice_rows`` candidates at a time."""
    return network_scorer(_layers(model), model.vectors, model.dim, slice_rows)


def network_scorer(
    layers: list[tuple[np.ndarray, np.ndarray]], vectors: DataFrame, dim: int, slice_rows: int = 8192
):
    """As ``arrow_scorer``, for given layers (matrix, bias) and ``vectors (token, vec)``.

    The vectors go into every task, so they must be small: beyond ``LOOKUP_BYTES`` they are refused, and documents are
    scored from ``embed_documents`` with ``network.candidate_confidence``, which has no such bound.
    """
    if table_bytes(vectors, 8 * dim) > LOOKUP_BYTES:
        raise ValueError("too many word vectors to send to every task")
    confidences = _confidence_function(layers, vectors, dim, slice_rows)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(candidates: pa.Array) -> pa.Array:
        return confidences(candidates)

    # so that no filter is pushed below it and the network runs once per document
    return run.asNondeterministic()


def fold_scorer(models: list[CandidateModel]):
    """Arrow UDF of (fold, candidates): each document is scored by the model of its fold, all in one pass."""
    functions = [_confidence_function(_layers(m), m.vectors, m.dim) for m in models]

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(folds: pa.Array, candidates: pa.Array) -> pa.Array:
        order, parts = [], []
        for fold, confidences in enumerate(functions):
            at = pc.indices_nonzero(pc.fill_null(pc.equal(folds, fold), False))
            if len(at):
                order.append(at.to_numpy())
                parts.append(confidences(candidates.take(at)))
        if not parts:
            return pa.array([[]] * len(folds), pa.list_(pa.float64()))
        back = np.argsort(np.concatenate(order), kind="stable")
        return pa.concat_arrays(parts).take(pa.array(back))

    return run.asNondeterministic()
