import random
import zlib
from collections import Counter

import pytest

from trialnum.llm import spelling
from trialnum.llm.damage import misspelt_words
from trialnum.llm.spelling import near_words, variant_groups


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_force(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def table(spark, n):
    return spark.createDataFrame(sorted(n.items()), "word string, n long")


def some_words(alphabet, lengths, count, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.choice(lengths))) for _ in range(count)}
    return {w: rng.choice([2, 3, 20, 30, 300, 4000]) for w in words}


@pytest.mark.parametrize(
    "alphabet, lengths, count", [("ab", range(1, 9), 400), ("abcé\U0001f600", range(4, 7), 500), ("xyz", [11, 12], 300), ("abcdefgh", [7, 8], 800)]
)
def test_words_equal_a_plain_comparison_of_all_pairs(spark, alphabet, lengths, count):
    n = some_words(alphabet, lengths, count, 5)
    assert found(variant_groups(table(spark, n))) == brute_force(n)


@pytest.mark.parametrize("limit", [2, 40])
def test_groups_that_are_halved_give_the_same_pairs(spark, monkeypatch, limit):
    n = some_words("ab", [7, 8, 9, 10], 500, 6)
    monkeypatch.setattr(spelling, "GROUP_WORDS", limit)
    assert found(variant_groups(table(spark, n))) == brute_force(n)


def test_few_rows_at_a_time_give_the_same_pairs(monkeypatch):
    import numpy as np

    n = sorted(some_words("abc", [5], 200, 7))
    points, length = spelling._points(__import__("pyarrow").array(n))
    args = (points, length, np.zeros(len(n), int), np.ones(len(n), bool), length, np.ones(len(n), bool))
    want = {(i, j) for i, a in enumerate(n) for j, b in enumerate(n) if one_edit(a, b)}
    assert set(zip(*map(list, spelling.scan_sorted(*args)))) == want
    monkeypatch.setattr(spelling, "SCANNERS", 3)
    assert set(zip(*map(list, spelling.scan_sorted(*args)))) == want


def test_chains_ties_and_words_without_neighbours(spark):
    n = {"abcdefg": 5, "abcdefgh": 50, "abcdefghi": 600, "abcdefx": 50, "zzzzzzz": 2, "aaaaaaa": 3, "aaaaaaaa": 30}
    got = found(variant_groups(table(spark, n)))
    assert got == brute_force(n)
    assert got["abcdefg"] == ("abcdefgh", "abcdefghi", 5, 2, 50)
    assert got["zzzzzzz"] == (None, "zzzzzzz", 2, 0, None)


def test_empty_tables_nulls_and_very_long_words(spark):
    assert variant_groups(table(spark, {})).count() == 0
    assert near_words(spark.createDataFrame([(None, 3), ("", 3), ("a", 3)], "word string, n long")).count() == 0
    long = "ab" * 5000
    n = {long: 40, long + "c": 2, long[:700] + "x" + long[701:]: 3}
    assert found(variant_groups(table(spark, n))) == brute_force(n)


def test_damaged_words_of_texts(spark):
    rng = random.Random(8)
    words = ["Strasse", "Éclairement", "wonderful", "colourful", "Zuverein", "short", "strassen"]
    docs = [(i, " ".join(rng.choices(words, k=30)) + "-wonderful1colourfulé") for i in range(60)]
    docs += [(None, "wonderful wonderful"), (61, None), (62, ""), (0, "wonderful"), (0, "wonderful"), (63, "x" * 100_000 + " " + "x" * 100_000)]
    df = spark.createDataFrame([(i, t, "a", 9) for i, t in docs], "doc_id long, text string, word string, n long")
    import re

    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    assert {r["word"]: r["n"] for r in misspelt_words(df).collect()} == n
    assert found(variant_groups(misspelt_words(df))) == brute_force(n)
