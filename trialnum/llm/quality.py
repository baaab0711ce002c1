"""Document quality by a regularised quadratic discriminant over transformed text statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialnum.llm.shared import materialize, text_bytes

KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n", b".,;:?'\"-()", b"!", b"|"]
FEATURES = 18


def _kind_table() -> np.ndarray:
    table = np.full(256, len(KINDS), np.uint8)  # other ASCII signs
    table[128:] = len(KINDS) + 1
    for k, signs in enumerate(KINDS):
        table[list(signs)] = k
    return table


KIND = _kind_table()


def _logit(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)))


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; null counts as empty. Counts go through logarithms, shares through log odds."""
    raw = text_bytes(text)
    kinds = np.zeros(len(KINDS) + 2, np.int64)
    for i in range(0, len(raw), 1 << 22):
        kinds += np.bincount(KIND[np.frombuffer(raw[i : i + (1 << 22)], np.uint8)], minlength=len(kinds))
    words = raw.split()
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x]
    ink = int(kinds.sum() - kinds[3] - kinds[4])
    return [
        np.log1p(n), np.log(sizes.mean() + 1) if n else 0.0, np.log(sizes.std() + 1) if n else 0.0, np.log(sizes.max() + 1) if n else 0.0,
        _logit(len(counts), n), _logit(repeats, n), _logit(max(counts.values(), default=0), n), _logit(pairs, max(n - 1, 0)),
        _logit(len(lines) - len(set(lines)), len(lines)), np.log1p(n / max(len(lines), 1)),
        *[_logit(int(kinds[k]), ink) for k in (0, 1, 2, 5, 6, 7, 8, 9)],
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash, x): the statistics of every row; XXH64 of the text tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([statistics(t) for t in batch.column(2).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), x], names=["id", "hash", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, hash long, x array<double>")


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Number, mean and covariance of x by label (label, x), from sums that each partition makes."""
    d = FEATURES

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            labels = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            for k in np.unique(labels).tolist():
                own = x[labels == k]
                s = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
                total[k] = total.get(k, 0) + s
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["label", "s"]
        )

    parts = labelled.select(F.col("label").cast("int").alias("label"), "x").mapInArrow(sums, "label int, s array<double>")
    parts = parts.groupBy("label").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(1 + d + d * d)]).alias("s"))
    out = {}
    for label, s in parts.collect():
        n, mean = s[0], np.array(s[1 : d + 1]) / s[0]
        out[label] = (n, mean, np.array(s[d + 1 :]).reshape(d, d) / n - np.outer(mean, mean))
    return out


class Discriminant:
    """log p(x | 1) - log p(x | 0) and the prior's log odds, from Cholesky factors that are made once.

    A class covariance is shrunk to the classes' common one and to its own diagonal. Shares
    of a few words say little, so the difference counts n / (n + evidence) for n words. Without
    rows of one class the score is the prior's.
    """

    def __init__(self, of: dict[int, tuple[float, np.ndarray, np.ndarray]], common: float = 0.1, diagonal: float = 0.02, evidence: float = 60):
        self.evidence = evidence
        n = {k: of[k][0] if k in of else 0.0 for k in (0, 1)}
        self.prior = float(np.log((n[1] + 1) / (n[0] + 1)))
        self.classes = {}
        if n[0] and n[1]:
            pooled = sum(n[k] * of[k][2] for k in (0, 1)) / (n[0] + n[1])
            for k in (0, 1):
                c = (1 - common) * of[k][2] + common * pooled
                c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + 1e-6 * np.eye(len(c))
                factor = np.linalg.cholesky(c)
                self.classes[k] = (of[k][1], np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for k, (mean, inverse, log_det) in self.classes.items():
            z = (x - mean) @ inverse.T
            out += (1 if k else -1) * (-0.5 * (z * z).sum(1) - log_det)
        n = np.expm1(x[:, 0])
        return self.prior + out * n / (n + self.evidence)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -700, 700)))


def held_out(id_col: Column) -> Column:
    """Rows that no label is learned from: CRC-32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, hash, held_out, score, predicted), score being the chance of label 1.

    Learns from labelled documents outside the held-out ids. Of several labels of an id the largest
    counts; null labels and labels without a document count nothing; a null id has no label. A null text is
    empty and scored like any other. With no labelled rows at all the score is 0.5. An
    empty table gives no rows; other columns are ignored.
    """
    rows = materialize(document_statistics(docs, id_col, text_col))
    of_id = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label")).dropna()
    of_id = of_id.where(F.col("label").isin(0, 1)).groupBy("id").agg(F.max("label").alias("label"))
    model = Discriminant(moments(rows.where(~held_out(F.col("id"))).join(of_id, "id").select("label", "x")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(3).flatten().to_numpy().reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(model.score(x))], names=["id", "hash", "held_out", "score"])

    scored = rows.select("id", "hash", held_out(F.col("id")).alias("held_out"), "x")
    scored = scored.mapInArrow(run, "id long, hash long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
