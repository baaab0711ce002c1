"""Training of the perceptron on rows that count several times, which MLlib's own training does not take."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


def mean_loss(rows: DataFrame, sizes: list[int], copies: str) -> Objective:
    """Weights -> mean cross-entropy and its gradient over ``rows (features, label)`` that count ``copies`` times each.

    Weights lie as MLlib's perceptron keeps them. Each evaluation is one pass: a task sums up its rows, Spark sums up the tasks.
    """
    rows = rows.select(vector_to_array("features").alias("x"), rows["label"].cast("int").alias("y"), rows[copies].cast("double").alias("n"))

    def evaluate(weights: np.ndarray) -> tuple[float, np.ndarray]:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            layers, at = [], 0
            for n_in, n_out in zip(sizes, sizes[1:]):
                end = at + n_in * n_out
                layers.append((weights[at:end].reshape((n_out, n_in), order="F"), weights[end : end + n_out]))
                at = end + n_out
            total = np.zeros(2 + len(weights))  # loss, rows, gradient
            for batch in batches:
                label, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                if not len(n):
                    continue
                made = [batch.column(0).flatten().to_numpy().reshape(len(n), -1)]
                for matrix, bias in layers[:-1]:
                    made.append(1.0 / (1.0 + np.exp(-(made[-1] @ matrix.T + bias))))
                z = made[-1] @ layers[-1][0].T + layers[-1][1]
                z -= z.max(axis=1, keepdims=True)
                logs = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
                every = np.arange(len(n))
                total[0] -= n @ logs[every, label]
                total[1] += n.sum()
                delta = np.exp(logs)
                delta[every, label] -= 1.0
                delta *= n[:, None]
                parts = []
                for k in range(len(layers) - 1, -1, -1):
                    parts += [delta.sum(axis=0), (delta.T @ made[k]).ravel(order="F")]
                    if k:
                        delta = (delta @ layers[k][0]) * made[k] * (1.0 - made[k])
                total[2:] += np.concatenate(parts[::-1])
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])

        per_task = rows.mapInArrow(sums, "sums array<double>")
        total = per_task.agg(Summarizer.sum(array_to_vector("sums")).alias("s")).first()["s"].toArray()
        return total[0] / total[1], total[2:] / total[1]

    return evaluate


def minimised(objective: Objective, start: np.ndarray, max_iter: int, tolerance: float = 1e-6, memory: int = 10) -> np.ndarray:
    """L-BFGS with the settings of MLlib's perceptron: ten corrections, a strong Wolfe search, its rules to stop."""
    x, (value, gradient) = start, objective(start)
    steps: deque = deque(maxlen=memory)
    first, values, failed = value, deque([value], maxlen=20), False
    done = 0
    while done < max_iter and np.linalg.norm(gradient) > max(tolerance * abs(value), 1e-8):
        direction = -_inverse_times(steps, gradient)
        length = 1.0 if steps else 1.0 / np.linalg.norm(direction)
        found = _wolfe(objective, x, direction, value, gradient, length)
        if found is None:
            if failed:
                break
            failed = True  # once more, along the gradient
            steps.clear()
            continue
        failed = False
        new, new_value, new_gradient = found
        steps.append((new - x, new_gradient - gradient))
        x, value, gradient = new, new_value, new_gradient
        done += 1
        if abs(value - max(values)) <= tolerance * abs(first):
            break
        values.append(value)
    return x


def _inverse_times(steps: deque, gradient: np.ndarray) -> np.ndarray:
    """The inverse Hessian as the last steps tell it, times the gradient."""
    out, scales = gradient.copy(), []
    for s, y in reversed(steps):
        scales.append((s @ out) / (s @ y))
        out -= scales[-1] * y
    if steps:
        s, y = steps[-1]
        out *= (s @ y) / (y @ y)
    for (s, y), scale in zip(steps, reversed(scales)):
        out += (scale - (y @ out) / (s @ y)) * s
    return out


def _wolfe(objective: Objective, x: np.ndarray, direction: np.ndarray, value: float, gradient: np.ndarray, length: float, tries: int = 10):
    """(point, value, gradient) that meets the strong Wolfe conditions along ``direction``; None where none is found."""
    slope = gradient @ direction
    if not slope < 0:
        return None

    def at(t: float) -> tuple:
        v, g = objective(x + t * direction)
        return t, v, g @ direction, g

    def point(c: tuple) -> tuple:
        return x + c[0] * direction, c[1], c[3]

    def between(a: tuple, b: tuple) -> float:
        """Where the cubic through both ends has its least value, a tenth of the range away from them at least."""
        left, right = sorted((a[:3], b[:3]))
        d1 = left[2] + right[2] - 3 * (left[1] - right[1]) / (left[0] - right[0])
        d2 = np.sqrt(max(d1 * d1 - left[2] * right[2], 0.0))
        width, below = right[0] - left[0], right[2] - left[2] + 2 * d2
        t = right[0] - width * (right[2] + d2 - d1) / below if below else left[0] + width / 2
        return float(np.clip(t, left[0] + 0.1 * width, left[0] + 0.9 * width))

    def zoom(low: tuple, high: tuple):
        for _ in range(tries):
            c = at(between(low, high))
            if c[1] > value + 1e-4 * c[0] * slope or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= 0.9 * abs(slope):
                return point(c)
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        return None

    low, t = (0.0, value, slope, gradient), length
    for k in range(tries):
        c = at(t)
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + 1e-4 * t * slope or (k and c[1] >= low[1]):
            return zoom(low, c)
        if abs(c[2]) <= 0.9 * abs(slope):
            return point(c)
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    return None
