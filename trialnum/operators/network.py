"""The network of the classifier as column expressions: for fixed weights, without Python."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from trialnum.functions.tokens import TAGS

Layer = tuple[np.ndarray, np.ndarray]  # matrix (outputs x inputs), bias


def _numbers(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _weighted(inputs: Column, weights) -> Column:
    products = F.zip_with(inputs, _numbers(weights), lambda x, w: x * w)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _layer_sums(inputs: Column, matrix: np.ndarray, bias: np.ndarray) -> Column:
    def sums(made: Column) -> Column:
        return F.array(*[_weighted(made, row) + float(b) for row, b in zip(matrix, bias)])

    # one-element array, so that the inputs are made once
    return F.get(F.transform(F.array(inputs), sums), F.lit(0))


def probability(first_sums: Column, layers: list[Layer]) -> Column:
    """Confidence from the weighted sums of the first layer; hidden layers are sigmoid, two outputs a softmax."""
    sums = first_sums
    for matrix, bias in layers[1:]:
        sums = _layer_sums(F.transform(sums, sigmoid), matrix, bias)
    last = layers[-1][0].shape[0]
    return sigmoid(F.get(sums, F.lit(1)) - F.get(sums, F.lit(0))) if last == 2 else sigmoid(F.get(sums, F.lit(0)))


def candidate_confidence(candidate: Column, layers: list[Layer], dim: int) -> Column:
    """Confidence of a candidate struct that has ``left_vec``, ``right_vec``, tags and ``other``.

    The inputs are those of the classifier: both vectors, both tags as one of 56 and the numeric features. A tag's
    part of the first sums is the weight at its place, taken from a list; an unknown tag adds nothing.
    """
    matrix, bias = layers[0]
    at = np.cumsum([0, 2 * dim, 2 * dim, len(TAGS), len(TAGS)])
    tags = F.array(*map(F.lit, TAGS))

    def tag_weight(tag: Column, weights) -> Column:
        place = F.array_position(tags, tag)
        return F.when(place > 0, F.element_at(_numbers(weights), F.greatest(place, F.lit(1)).cast("int"))).otherwise(0.0)

    sums = [
        float(b)
        + _weighted(candidate["left_vec"], row[at[0] : at[1]])
        + _weighted(candidate["right_vec"], row[at[1] : at[2]])
        + tag_weight(candidate["left_pos"], row[at[2] : at[3]])
        + tag_weight(candidate["right_pos"], row[at[3] : at[4]])
        + _weighted(candidate["other"], row[at[4] :])
        for row, b in zip(matrix, bias)
    ]
    return probability(F.array(*sums), layers)
