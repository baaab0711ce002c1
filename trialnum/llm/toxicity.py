"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialnum.llm.quality import held_out

WORD = re.compile(r"\w+")
PREFIX = 4
BLOCK = 64


def terms(text: str | None) -> Counter:
    """How often the whole text has each lower-case word, and each start of a longer word."""
    words = Counter(WORD.findall((text or "").lower()))
    starts: Counter = Counter()
    for w, n in words.items():
        if len(w) > PREFIX:
            starts[w[:PREFIX] + "*"] += n
    words.update(starts)
    return words


class BlockMaxIndex:
    """Unit TF-IDF vectors of examples by term, in blocks of examples with each block's largest weight."""

    def __init__(self, vectors: list[dict[int, float]], n_terms: int):
        self.n = len(vectors)
        self.blocks = -(-self.n // BLOCK)
        lists: list[list[tuple[int, float]]] = [[] for _ in range(n_terms)]
        for i, v in enumerate(vectors):
            for t, w in v.items():
                lists[t].append((i, w))
        self.ids = [np.array([i for i, _ in p], np.int64) for p in lists]
        self.weights = [np.array([w for _, w in p]) for p in lists]
        self.starts = [np.searchsorted(i, np.arange(self.blocks + 1) * BLOCK) for i in self.ids]
        self.most = np.zeros((n_terms, self.blocks))
        for t, (i, w) in enumerate(zip(self.ids, self.weights, strict=True)):
            np.maximum.at(self.most[t], i // BLOCK, w)

    def nearest(self, query: dict[int, float], k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k most similar examples (smaller numbers first among equals) with a similarity above 0.

        Blocks come in descending order of their upper bound, and end at the first whose bound is below
        the k-th similarity found, so no example is missed.
        """
        ts, qs = np.array(list(query), int), np.array(list(query.values()))
        if not len(ts) or not self.n:
            return np.zeros(0, np.int64), np.zeros(0)
        bound = qs @ self.most[ts] + 1e-9
        order = np.argsort(-bound, kind="stable")
        ids, sims, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        for b in order.tolist():
            if bound[b] <= 2e-9 or (len(ids) == k and bound[b] < least):
                break
            sim = np.zeros(BLOCK)
            for t, q in zip(ts.tolist(), qs.tolist(), strict=True):
                a, z = self.starts[t][b], self.starts[t][b + 1]
                if a < z:
                    sim[self.ids[t][a:z] - b * BLOCK] += q * self.weights[t][a:z]
            hit = np.flatnonzero(sim > 0)
            hit = hit[hit + b * BLOCK != but]
            ids, sims = np.concatenate([ids, hit + b * BLOCK]), np.concatenate([sims, sim[hit]])
            best = np.lexsort((ids, -np.round(sims, 12)))[:k]
            ids, sims = ids[best], sims[best]
            least = sims[-1] if len(sims) == k else 0.0
        return ids, sims


class Neighbours:
    """Distance-weighted votes of the nearest examples, calibrated on the examples themselves.

    The vote is the share of similarity that toxic neighbours have. Each example's vote is taken
    without itself, and a monotone step function (pooled adjacent violators, weighted by what the
    sampled classes stand for) turns votes into chances. Texts without a neighbour have their own.
    """

    def __init__(self, examples: list[tuple[int | None, int, dict[str, int]]], vocabulary: dict[str, float], share: dict[int, float], k: int):
        self.k, self.names = k, {t: i for i, t in enumerate(vocabulary)}
        self.idf = np.array(list(vocabulary.values()))
        self.of = [(i, y) for i, y, _ in examples]
        vectors = [self.vector(c) for _, _, c in examples]
        self.index = BlockMaxIndex(vectors, len(vocabulary))
        votes = [self.vote(*self.index.nearest(v, k, but=i)) for i, v in enumerate(vectors)]
        weight = [share[y] for _, y in self.of]
        toxic = sum(w for w, (_, y) in zip(weight, self.of, strict=True) if y)
        rate = (toxic + 0.5) / (sum(weight) + 1) if weight else 0.5
        lone = [(w, y) for v, w, (_, y) in zip(votes, weight, self.of, strict=True) if v is None]
        self.alone = (sum(w * y for w, y in lone) + rate) / (sum(w for w, _ in lone) + 1)
        known = sorted((v, w, y) for v, w, (_, y) in zip(votes, weight, self.of, strict=True) if v is not None)
        pools: list[list[float]] = []  # [first vote, weight, toxic weight]
        for v, w, y in known:
            if pools and pools[-1][0] == v:
                pools[-1] = [v, pools[-1][1] + w, pools[-1][2] + w * y]
            else:
                pools.append([v, w, w * y])
            while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [pools[-1][0], pools[-1][1] + last[1], pools[-1][2] + last[2]]
        self.steps = np.array([p[0] for p in pools])
        self.chances = np.array([(p[2] + rate) / (p[1] + 1) for p in pools])
        self.rate = rate

    def vector(self, counts: dict[str, int]) -> dict[int, float]:
        v = {self.names[t]: (1 + np.log(n)) * self.idf[self.names[t]] for t, n in counts.items() if t in self.names}
        norm = np.sqrt(sum(w * w for w in v.values()))
        return {t: w / norm for t, w in v.items()}

    def vote(self, ids: np.ndarray, sims: np.ndarray) -> float | None:
        if not len(ids):
            return None
        return round(float(sum(s for i, s in zip(ids.tolist(), sims.tolist(), strict=True) if self.of[i][1]) / sims.sum()), 9)

    def score(self, counts: dict[str, int]) -> tuple[float, list[dict]]:
        ids, sims = self.index.nearest(self.vector(counts), self.k)
        vote = self.vote(ids, sims)
        evidence = [{"doc_id": self.of[i][0], "toxic": self.of[i][1], "similarity": s} for i, s in zip(ids.tolist(), sims.tolist(), strict=True)]
        if vote is None:
            return self.alone, evidence
        if not len(self.steps):
            return self.rate, evidence
        return float(self.chances[max(np.searchsorted(self.steps, vote, side="right") - 1, 0)]), evidence


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str, text_col: str) -> tuple[DataFrame, dict[int, float]]:
    """(id, label, text) of at most `most` distinct documents of as many labelled ids of each class, and what one of them stands for."""
    of_id = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label")).dropna()
    of_id = of_id.where(F.col("label").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    share, sample = {0: 1.0, 1: 1.0}, None
    for k, n in of_id.groupBy("label").count().collect():
        share[k] = max(1.0, n / most)
    for k in (0, 1):
        some = of_id.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(most)
        sample = some if sample is None else sample.unionByName(some)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(sample), "id").distinct()
    for k, n in rows.groupBy("label").count().collect():
        if n > most:  # ids with several texts
            share[k] *= n / most
            some = rows.where(F.col("label") == k).orderBy(F.xxhash64("text", "id"), "id", "text").limit(most)
            rows = rows.where(F.col("label") != k).unionByName(some)
    return rows, share


def fit(docs: DataFrame, labels: DataFrame, label: str, most: int, vocabulary: int, least: float, k: int, id_col: str, text_col: str) -> Neighbours:
    sample, share = labelled_sample(docs, labels, label, most, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(t) for t in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "terms", "counts"])

    found = sample.select("id", "label", "text").mapInArrow(run, "id long, label int, terms array<string>, counts array<long>").persist()
    size = {r.label: r["count"] for r in found.groupBy("label").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    n = n1 + n0
    df = found.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    gap = a * (n0 - b) - b * (n1 - a)
    chi = F.try_divide(F.lit(float(n)) * gap * gap, (a + b) * F.lit(float(max(n1, 1))) * F.lit(float(max(n0, 1))) * (n - a - b))  # null for what all have
    chosen = df.withColumn("chi", chi).where((F.col("chi") >= least) & (a + b >= 3)).orderBy(F.desc("chi"), "term").limit(vocabulary).collect()
    idf = {r.term: float(np.log((1 + n) / (1 + r.a + r.b)) + 1) for r in chosen}
    names = list(idf)
    kept = found.select("id", "label", F.filter(F.arrays_zip("terms", "counts"), lambda x: F.array_contains(F.lit(names), x["terms"])).alias("t")) if names else found.select("id", "label", F.array().alias("t"))
    examples = [(r.id, r.label, {x["terms"]: x["counts"] for x in r.t}) for r in kept.collect()]
    found.unpersist()
    examples.sort(key=lambda e: (e[0] is None, e[0] or 0, e[1], sorted(e[2].items())))
    return Neighbours(examples, idf, share, k)


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.3, most: int = 2000, vocabulary: int = 100,
    least: float = 30.0, k: int = 15, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: (id, held_out, score, predicted, evidence), score being the chance of label 1.

    Examples are the documents of at most `most` labelled ids of each class outside the held-out
    ones, `most` distinct ones at most by hash where ids have several texts. Their terms (words, and starts of words) whose chi-squared with the label is at least `least`,
    at most `vocabulary` of them, span the TF-IDF space; every whole text is then a query of it.
    The index is bounded by `most` and `vocabulary`, and is sent to the tasks.

    Null and empty texts and texts without any chosen term have no neighbours and get the chance that such examples
    have. Without labelled rows the score is 0.5. Of several labels of an id the largest
    counts. Repeated rows are scored each; an empty table gives no rows; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, most, vocabulary, least, k, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("similarity", pa.float64())]))
        for batch in batches:
            scored = [model.value.score(terms(t)) for t in batch.column(2).to_pylist()]
            columns = [pa.array([s for s, _ in scored], pa.float64()), pa.array([e for _, e in scored], kind)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "held_out", "score", "evidence"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, "id long, held_out boolean, score double, evidence array<struct<doc_id: long, toxic: int, similarity: double>>")
    return scored.select("id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
