import random
import time

import numpy as np
import pyarrow as pa
import pytest

from trialnum.functions import number_sets as sets
from trialnum.operators.candidates import build_candidates, explode_candidates


def plain(numbers):
    values = [int(x) for x in numbers]
    others = lambda i: values[:i] + values[i + 1 :]
    pairs = {a + b for i, a in enumerate(values) for b in others(i)} if len(values) < 200 else None
    if pairs is None:
        known, twice = set(values), {v for v in set(values) if values.count(v) > 1}
        pairs = {t for t in known if any(t - a in known and (t != 2 * a or a in twice) for a in known)}
    return [
        float(f)
        for i, v in enumerate(values)
        for f in (v >= max(values), v in pairs, v in others(i), sum(x < v for x in values) / len(values))
    ]


def lists(seed, documents=400):
    rng, out = random.Random(seed), []
    for _ in range(documents):
        top = rng.choice([2, 15, 1000, 10**17, 10**18, 10**19, 10**24])
        out.append([rng.choice(["", "-", "+", "00"]) + str(rng.randrange(top)) for _ in range(rng.choice([0, 1, 2, 3, 9, 40]))])
    return [*out, None, ["1" * 50, "5", "1" * 49 + "6"], ["0", "-0", "5"], ["0", "5"], ["25", "50"], ["25", "25", "50"], [str(10**18), str(10**18 - 1), "1"]]


def equal(got, docs):
    return all((g or []) == (plain(d) if d else []) for g, d in zip(got.to_pylist(), docs))


def test_flags_equal_plain_integers():
    docs = lists(1)
    assert equal(sets.flags_of(pa.array(docs, pa.list_(pa.string()))), docs)
    assert sets.flags_of(pa.array([], pa.list_(pa.string()))).to_pylist() == []


@pytest.mark.parametrize("few", [0, 3])
def test_search_for_missing_parts_gives_the_same(monkeypatch, few):
    monkeypatch.setattr(sets, "PAIRWISE", few)
    monkeypatch.setattr(sets, "TOTALS", 5)
    monkeypatch.setattr(sets, "PARTS", 2)
    docs = lists(2, 150)
    assert equal(sets.flags_of(pa.array(docs, pa.list_(pa.string()))), docs)
    monkeypatch.setattr(sets, "PRIMES", [7])  # values that cannot be told apart by their rest
    assert equal(sets.flags_of(pa.array(docs, pa.list_(pa.string()))), docs)


def test_parts_of_a_list_make_the_whole():
    docs = lists(3, 60)
    array = pa.array(docs, pa.list_(pa.string()))
    found = [sets.sum_places(array, np.full(len(docs), k), np.full(len(docs), 4)).to_pylist() for k in range(4)]
    given = [None if of[0] is None else sum(of, []) for of in zip(*found)]
    assert equal(sets.flags_of(array, given), docs)


def test_a_document_of_very_many_numbers():
    rng = random.Random(4)
    dense = pa.array([[str(rng.randrange(10**6)) for _ in range(200_000)]])
    start = time.time()
    sets.flags_of(dense)
    assert time.time() - start < 30


def test_long_documents_are_spread_over_tasks_and_give_the_same(spark):
    rng = random.Random(5)
    texts = [" ".join(str(rng.randrange(10 ** rng.choice([2, 4, 20]))) for _ in range(n)) for n in (0, 3, 12, 5000, 5000)]
    rows = [(i, t) for i, t in enumerate([*texts, texts[3], None, "7 " * 40 + "9" * 60])]
    df = spark.createDataFrame(rows, "pmid long, abstract string")
    whole, spread = build_candidates(df), build_candidates(df, long_numbers=10)
    assert whole.columns == spread.columns
    pick = lambda docs: sorted(map(str, explode_candidates(docs).select("pmid", "idx", "num", "other").collect()))
    assert pick(whole) == pick(spread)
    plan = spread._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_key" in plan and "_part" in plan  # a part of a document's totals is a task of its own
    assert spread.count() == len(rows)
