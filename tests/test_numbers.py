import random

import pytest
from pyspark.sql import functions as F

from trialnum.functions import numbers as n


def apply(spark, function, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("t"))).collect()]


def test_thousands(spark):
    cases = {
        " 1,234 x": " 1234 x",
        " 1 234 x": " 1234 x",
        " 1 234 x": " 1234 x",
        " 1,234,567 ": " 1234,567 ",
        "1,000 at the start": "1,000 at the start",
        "at the end 1,000": "at the end 1,000",
        "x 12,3456 y": "x 12,3456 y",
        "": "",
    }
    assert apply(spark, n.join_thousands, cases) == list(cases.values())


def test_number_words(spark):
    cases = {
        "hundred": "0",
        "one, two": "3",
        "two hundred hundred": "20000",
        "one hundred and twenty three": "123",
        "Twenty-five": "25",
        "Fifty-two (one, two). And six thousand,": "55). And 6000,",
        "one And two": "1 And 2",
        "one and, two": "3",
        "one; two' three": "1; 2' 3",
        "one 5 two": "1 5 2",
        "ones stone someone": "ones stone someone",
        "one thousand two hundred thousand": "1200000",
        "three and": "3 and",
        "TWO THOUSAND THREE HUNDRED": "2300",
        "no word": "no word",
        "": "",
        "ſix six": "ſix 6",
        "İone": "İone",
    }
    assert apply(spark, n.replace_number_words, cases) == list(cases.values())
    assert apply(spark, n.replace_number_words, [None]) == [None]


def test_values_beyond_bigint_stay_exact(spark):
    cases = {
        "one " + "trillion " * 4: str(10**48),
        "nine trillion trillion and two trillion five": str(9 * 10**36 + 2 * 10**12 + 5),
        "two million five hundred thousand trillion": str(25 * 10**17),
        " ".join(["ninety trillion million"] * 12): None,
    }
    got = apply(spark, n.group_value, cases)
    for text, (want, value) in zip(cases, zip(cases.values(), got)):
        assert value == (want or str(brute_value(text.split())))


def brute_value(words):
    """Closed form: a word counts times all later scales that no larger scale in between closes."""
    total = 0
    for i, w in enumerate(words):
        if w in n.SCALE_EXPONENTS:
            continue
        exponent, top = 0, 0
        for later in words[i + 1 :]:
            e = n.SCALE_EXPONENTS.get(later)
            if e is not None and e >= top:
                exponent, top = exponent + e, e
        total += n.NUMBER_WORDS[w] * 10**exponent
    return total


def test_group_values_against_brute_force(spark):
    rng = random.Random(7)
    words = list(n.NUMBER_WORDS)
    groups = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(1500)]
    assert apply(spark, n.group_value, groups) == [str(brute_value(g.split())) for g in groups]


def in_words(x):
    names = {v: k for k, v in n.NUMBER_WORDS.items()}
    parts = []
    for scale in (10**12, 10**9, 10**6, 1000):
        if x >= scale:
            parts += in_words(x // scale) + [names[scale]]
            x %= scale
    if x >= 100:
        parts += [names[x // 100], "hundred"]
        x %= 100
    if x > 20:
        parts.append(names[x // 10 * 10])
        x %= 10
    if x:
        parts.append(names[x])
    return parts


def test_round_trip(spark):
    rng = random.Random(3)
    values = [rng.randint(1, 10 ** rng.randint(1, 14)) for _ in range(400)]
    texts = [" ".join(in_words(v)) for v in values]
    assert apply(spark, n.normalize_numbers, texts) == [str(v) for v in values]


def test_many_groups_in_one_text(spark):
    text = "seen in twenty one. " * 3000
    assert apply(spark, n.normalize_numbers, [text]) == ["seen in 21. " * 3000]


def test_annotated_numbers(spark):
    cases = {
        "1,234": 1234,
        "1 234": 1234,
        "1 234": 1234,
        "1 234": 1234,
        "fifty two": 52,
        "hundred": 0,
        "fifty patients": None,
        "about 50": None,
        "12.5": None,
    }
    assert apply(spark, n.annotated_number, cases) == list(cases.values())


@pytest.mark.parametrize("text,want", [("Total_Sample_SIZE", "Total_sample_size"), ("x", "X"), ("", "")])
def test_capitalize(spark, text, want):
    assert apply(spark, n.capitalize, [text]) == [want]


def test_very_long_runs_take_seconds(spark):
    import time

    for text, want in (("two " + "hundred " * 100_000, "2" + "0" * 200_000), ("seven trillion " * 20_000, "7" + "000000000007" * 19_999 + "0" * 12)):
        start = time.time()
        assert apply(spark, n.group_value, [text]) == [want]
        assert time.time() - start < 60
