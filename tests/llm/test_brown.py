import math
import zlib
from collections import Counter

import numpy as np
import pytest

from trialnum.llm import brown


def likelihood(pairs, of, classes):
    g = np.zeros((classes, classes))
    np.add.at(g, (of[:, None].repeat(len(of), 1), of[None, :].repeat(len(of), 0)), pairs)
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(g) - f(g.sum(1)) - f(g.sum(0))


def test_exchange_finds_blocks_and_no_single_move_helps():
    rng = np.random.default_rng(2)
    block = rng.integers(0, 3, 30)
    pairs = np.where(block[:, None] == block[None, :], rng.integers(5, 50, (30, 30)), rng.integers(0, 3, (30, 30)))
    of = brown.exchange(pairs, 3, sweeps=50)
    best = likelihood(pairs, of, 3)
    for w in range(30):
        for c in range(3):
            other = of.copy()
            other[w] = c
            assert likelihood(pairs, other, 3) <= best + 1e-3
    assert len({(a, b) for a, b in zip(block.tolist(), of.tolist(), strict=True)}) == 3


@pytest.mark.parametrize("kept", [10**6, 40])
def test_scores_equal_a_plain_count(spark, small, kept):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").limit(80).collect()]
    docs += [(5000, None), (5001, " \n"), (None, "The the THE"), (5002, "once more " * 60_000), (5002, "zebra"), (5002, "zebra")]
    df = spark.createDataFrame([(i, t, b"x", 1) for i, t in docs], "doc_id long, text string, word binary, score int")
    rows = brown.score_texts(df, kept=kept, single=30, buckets=16, classes=6).collect()
    c = Counter()
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for i, t in docs:
        if not is_held(i):
            c.update(brown.tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in docs:
        ws = brown.tokens(t)
        want[(i, is_held(i), len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 3))] += 1
    assert Counter((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in rows) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert brown.score_texts(df.where("false")).count() == 0


def test_class_model_is_a_distribution():
    words = [brown.END, b"aa", b"bb", b"cab", b"dab"]
    units = brown.Units(words, [5, 4, 3, 1, 1], 3, 4)
    pairs = np.random.default_rng(1).integers(0, 4, (7, 7))
    counts = np.zeros(7)
    np.add.at(counts, units.unit, units.counts)
    pairs[:] = np.outer(counts, counts) // counts.sum() + 0
    of = np.array([0, 1, 1, 2, 2, 0, 2])
    g = np.zeros(3)
    np.add.at(g, of, pairs.sum(0))
    model = brown.ClassModel(units, of, pairs, 3, np.bincount(units.unit, minlength=7), 0.4, 14, 5)
    assert np.allclose((10**model.step).sum(1), 1)


def test_perplexity_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in brown.score_texts(docs).collect() if r.held_out]
    n = sum(r.n_tokens for r in rows)
    model, base = (10 ** (-sum(x) / n) for x in ([r.score for r in rows], [r.base_score for r in rows]))
    assert model < 0.6 * base


def test_every_word_gets_its_own_class(spark):
    """Words far beyond `single` whose endings are shared: only their neighbours tell the two kinds apart."""
    rng = np.random.default_rng(4)
    names = [[f"{k}{i:03d}{'xyz'}" for i in range(150)] for k in "pq"]
    texts = [" ".join(names[j % 2][rng.integers(150)] for j in range(60)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = brown.Words(np.array([brown.xxhash.xxh64_intdigest(w.encode(), seed=42) for k in names for w in k], np.uint64).view(np.int64), 4)
    hashed = spark.createDataFrame([(names[0][0].encode(),)], "w binary").selectExpr("xxhash64(w) AS h").first().h
    assert words.hashes[words.numbers([names[0][0].encode()])[0]] == hashed
    table = brown.word_pairs(df, spark.sparkContext.broadcast(words), words.size, 3)
    start = np.random.default_rng(1).integers(0, 3, words.size)
    of, g = brown.cluster_words(table, start, 3, least=0.0)
    counts = np.zeros((words.size, words.size))
    for t in texts:
        u = words.numbers(brown.tokens(t))
        np.add.at(counts, (np.concatenate([u[-1:], u[:-1]]), u), 1)
    member = np.eye(3)[of]
    assert np.array_equal(g, member.T @ counts @ member)
    assert brown.class_likelihood(g) > likelihood(counts, start, 3) + 1e3
    p, q = (set(of[words.numbers([w.encode() for w in k])].tolist()) for k in names)
    assert not p & q
    rows = brown.score_texts(df, kept=50, single=10, buckets=4, classes=4).collect()
    held = [r for r in rows if r.held_out]
    n = sum(r.n_tokens for r in held)
    assert 10 ** (-sum(r.score for r in held) / n) < 0.6 * 10 ** (-sum(r.base_score for r in held) / n)


def test_ranges_cut_both_sides_at_the_same_words(monkeypatch):
    from trialnum.llm import brown

    rng = np.random.default_rng(3)
    owners = [np.sort(rng.integers(0, 50, 400)), np.sort(rng.integers(10, 60, 300))]
    for entries, words in ((1, 1000), (37, 1000), (10**6, 7), (10**6, 1000)):
        monkeypatch.setattr(brown, "RANGE_ENTRIES", entries)
        monkeypatch.setattr(brown, "RANGE_WORDS", words)
        found = list(brown._ranges(owners))
        for side, own in enumerate(owners):
            spans = [r[side] for r in found]
            assert spans[0][0] == 0 and spans[-1][1] == len(own) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        sets = [{int(w) for own, (a, z) in zip(owners, r) for w in own[a:z]} for r in found]
        assert sum(map(len, sets)) == len(set().union(*sets)) and all(len(x) <= words for x in sets)


def test_words_of_many_texts_are_found_at_once_as_those_of_each(monkeypatch):
    texts = [" A\tb\n\x0b\x0c\rC  b", None, "", "  ", "x\x1cy\x85z\xa0", "É É é", "b" * 70, "b"]
    for chunk, kind in ((8, brown.pa.string()), (8_000_000, brown.pa.string()), (8, brown.pa.large_string())):
        monkeypatch.setattr(brown, "CHUNK", chunk)
        found = []
        for words, at, n in brown.parted(brown.pa.array(texts, kind)):
            ws = words.to_pylist()
            assert len(set(ws)) == len(ws)
            found += [[ws[i] for i in part] for part in np.split(at, np.cumsum(n)[:-1])]
        assert found == [brown.tokens(t) for t in texts]
    assert not list(brown.parted(brown.pa.array([], brown.pa.string())))
