import math
from collections import Counter

import numpy as np
import pytest

from trialnum.llm import search


@pytest.mark.parametrize(("shard", "block"), [(8192, 4096), (30, 7)])
def test_top_k_equals_scoring_all_pairs(spark, small, monkeypatch, shard, block):
    monkeypatch.setattr(search, "SHARD", shard)
    monkeypatch.setattr(search, "QUERIES", block)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    docs += [(1000, None), (1001, ""), (None, "the thing"), (1003, "the " * 100_000), (1003, "the thing"), (1003, "the thing"), (1004, "same one"), (1005, "same one")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, score string").repartition(3)
    asked = [d for d in docs if d[0] is not None and (d[0] % 20 == 0 or d[0] > 999)]
    rows = search.top_k(df, df.where("doc_id % 20 = 0 OR doc_id > 999"), k=5).collect()
    bags = [(i, Counter(search.terms(t))) for i, t in docs]
    df_of = Counter(t for _, c in bags for t in c)
    n, mean = len(docs), sum(sum(c.values()) for _, c in bags) / len(docs)
    want = []
    for q, text in set(asked):
        query = Counter(search.terms(text))
        scored = []
        for i, c in bags:
            s = 0.0
            for t, m in query.items():
                if c[t]:
                    idf = math.log(1 + (n - df_of[t] + 0.5) / (df_of[t] + 0.5))
                    s += m * idf * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
            if s > 0:
                scored.append((-round(s, 6), i is None, i))
        want += [(q, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:5], 1)]
    key = lambda r: (r[0], r[1], str(r[2]), r[3])
    assert sorted(((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in rows), key=key) == sorted(want, key=key)
    assert search.top_k(df.where("false"), df.where("false")).count() == 0


def test_queries_of_a_shard_are_scored_together_and_few_documents_in_full():
    rng = np.random.default_rng(3)
    words = [b"w%d" % i for i in range(400)]
    docs = [[words[i] for i in np.minimum(rng.zipf(1.2, 120), 400) - 1] for _ in range(1000)]
    docs[500] = docs[10]
    stats = search.Statistics(
        {w: i for i, w in enumerate(words)}, np.array([sum(w in d for d in map(set, docs)) for w in words], float), len(docs), 120 * len(docs)
    )
    counts = [stats.counts(d) for d in docs]
    shard = search.Shard([(i, c, 120) for i, c in enumerate(counts)], stats, 1.2, 0.75)
    queries = [(c[0].astype(np.int64), c[1].astype(float)) for c in counts[:40]] + [(np.zeros(0, np.int64), np.zeros(0))]
    impacts = np.zeros((len(docs), len(words)))
    for i, (term, tf) in enumerate(counts):
        impacts[i, term] = stats.idf[term] * tf * 2.2 / (tf + 1.2)
    found = list(shard.top(queries, 5, np.zeros(len(queries))))
    for (term, times), (at, scores) in zip(queries[:-1], found[:-1], strict=True):
        want = impacts[:, term] @ times
        order = np.lexsort((np.arange(len(docs)), -np.round(want, 9)))[:5]
        best = np.lexsort((at, -scores))[:5]
        assert at[best].tolist() == order.tolist()
        assert np.allclose(scores[best], want[order])
        assert len(at) <= 15
    assert 500 in found[10][0] and len(found[-1][0]) == 0


def test_documents_are_read_once_whatever_the_number_of_queries(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(search, "QUERIES", 7)
    log = str(tmp_path / "read")

    def logged(batches):
        for batch in batches:
            with open(log, "a") as f:
                f.write("x" * batch.num_rows)
            yield batch

    rows = [(i, f"word{i % 7} and word{i % 5} of text {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = search.top_k(df.mapInArrow(logged, df.schema), df, k=3).collect()  # nine blocks of queries
    assert len(found) == 180 and all(r.query_id == r.id for r in found if r["rank"] == 1)
    assert len(open(log).read()) == len(rows)


def test_documents_of_a_block_are_alike():
    rng = np.random.default_rng(5)
    words = [b"%s%d" % (side, i) for side in (b"a", b"b") for i in range(30)]
    docs = [[words[30 * (d % 2) + i] for i in rng.integers(0, 30, 40)] for d in range(640)]
    stats = search.Statistics({w: i for i, w in enumerate(words)}, np.array([sum(w in d for d in map(set, docs)) for w in words], float), len(docs), 40 * len(docs))
    shard = search.Shard([(i, stats.counts(d), 40) for i, d in enumerate(docs)], stats, 1.2, 0.75)
    sides = shard.most.reshape(shard.blocks, 2, 30).max(2) > 0
    assert (sides.sum(1) == 1).sum() >= shard.blocks - 1  # the terms of one side have no impact in the other's blocks
