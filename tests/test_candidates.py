import random
import time

import pytest
from pyspark.sql import functions as F

from trialnum.functions import features as feat
from trialnum.functions import tokens as tk
from trialnum.operators.candidates import build_candidates, explode_candidates, with_features
from trialnum.operators.labels import label_value, labelled_candidates, token_labels
from trialnum.operators.classifier import one_hot_tags
from trialnum.operators.lexicon import tagged
from trialnum.operators.lookup import LOOKUP_BYTES

EXAMPLE_TEXT = (
    "TITLE: Early oxygen in people with COVID-19. We enrolled 50 adults. Oxygen was given at "
    "20 l/min on day 1-5 and at 10 l/min on day 6-10. (P=0.500) 28-day"
)


def from_tokens(spark, docs):
    rows = [(i, t, t) for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "pmid long, raw_tokens array<string>, tokens array<string>")
    return explode_candidates(with_features(df)).orderBy("pmid", "idx").collect()


def other(row, name):
    return row["other"][feat.OTHER_FEATURES.index(name)]


def test_tokens(spark):
    text = "n=50) COVID-19-induced 0.036 20mg 1,000 été x"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(tk.document_tokens(F.col("t"))).first()[0]
    assert got == ["n=50", ")", "COVID-19", "-", "induced", "0.036", "20", "mg", "1,000", "été", "x"]


def test_n_equals(spark):
    df = spark.createDataFrame([(["n=50", "N=50", "(n=50)", "mean=4", "n=1=2", "x"],)], "t array<string>")
    assert df.select(tk.rewrite_n_equals(F.col("t"))).first()[0] == ["50", "50", "50", "4", "1", "x"]


def test_integers(spark):
    values = ["5", "+5", "-5", "5.7", "1_000", "５", "9223372036854775807", "99999999999999999999", "", "x"]
    df = spark.createDataFrame([(values,)], "t array<string>")
    got = df.select(F.transform("t", tk.token_number)).first()[0]
    assert got == [5, 5, -5, None, None, None, 2**63 - 1, 10**20 - 1, None, None]


def test_example_abstract_has_its_number(spark):
    df = spark.createDataFrame([(7, EXAMPLE_TEXT)], "pmid long, abstract string")
    nums = [r["num"] for r in explode_candidates(build_candidates(df)).collect()]
    assert 50 in nums and 19 not in nums and nums == [50, 20, 1, 5, 10, 6, 10, 28]


def test_edges(spark):
    rows = from_tokens(spark, [["7"], ["7", "b"], ["a", "7"], ["A", "B", "7", "C", "D"], ["a", "7", "b"]])
    words = [(r["left_word"], r["right_word"]) for r in rows]
    assert words == [
        (["BoS", "BoS"], ["", "LoS"]),
        (["BoS", "BoS"], ["", "b"]),
        (["BoS", "a"], ["", "LoS"]),
        (["a", "b"], ["d", "c"]),
        (["BoS", "a"], ["", "b"]),
    ]
    assert (rows[0]["left_pos"], rows[0]["right_pos"]) == ("XX", "XX")


def test_keyword_windows(spark):
    def doc(keyword, at, n=14, i=6):
        t = ["w"] * n
        t[i], t[at] = "9", keyword
        return t

    near = {0: 0.0, 1: 0.0, 2: 1.0, 5: 1.0, 7: 1.0, 11: 1.0, 12: 0.0}
    rows = from_tokens(spark, [doc("Years", at) for at in near])
    assert [other(r, "years_near") for r in rows] == list(near.values())
    follow = {5: 0.0, 7: 1.0, 10: 1.0, 11: 0.0}
    rows = from_tokens(spark, [doc("PATIENTS", at) for at in follow])
    assert [other(r, "patients_follow") for r in rows] == list(follow.values())
    # token 0 never counts, also inside the window
    assert [other(r, "years_near") for r in from_tokens(spark, [["year", "9", "w"]])] == [0.0]
    # the upper-case keyword can never match
    assert [other(r, "analysis_near") for r in from_tokens(spark, [["w", "9", "ITT"]])] == [0.0]


def test_number_features_against_brute_force(spark):
    rng = random.Random(5)
    docs = [[rng.randint(-3, 12) for _ in range(rng.randint(1, 9))] for _ in range(300)]
    docs += [[0, 50], [50], [25, 50], [25, 25, 50], [2**63 - 1, 1, 2**63 - 2], [-(2**63), 2**63 - 1, -1]]
    rows = iter(from_tokens(spark, [[str(x) for x in d] for d in docs]))
    for d in docs:
        sums = {d[a] + d[b] for a in range(len(d)) for b in range(a)}
        for x in d:
            r = next(rows)
            assert r["num"] == x
            assert other(r, "biggest") == float(x >= max(d))
            assert other(r, "looks_like_year") == 0.0
            assert other(r, "sum_of_two") == float(x in sums), (x, d)
            assert other(r, "repeated") == float(d.count(x) > 1)
            assert other(r, "rank_prop") == sorted(d).index(x) / len(d)


def test_years(spark):
    rows = from_tokens(spark, [["1939", "1940", "2022", "2023"]])
    assert [other(r, "looks_like_year") for r in rows] == [0.0, 1.0, 1.0, 0.0]


def test_documents_without_numbers_and_own_tokenizer(spark):
    df = spark.createDataFrame([(1, "no"), (2, None), (3, "a_7_b")], "pmid long, abstract string")
    own = build_candidates(df, tokenizer=lambda c: F.split(c, "_"))
    assert [r["num"] for r in explode_candidates(own, keep_empty=True).orderBy("pmid").collect()] == [None, None, 7]
    assert explode_candidates(build_candidates(df.filter("pmid < 3"))).count() == 0


def test_labels(spark):
    df = spark.createDataFrame(
        [(1, "50 of 050 and 51", 50), (2, "50", None)], "pmid long, abstract string, tt_sample_size long"
    )
    got = labelled_candidates(df).orderBy("pmid", "idx").select("num", "label").collect()
    assert [tuple(r) for r in got] == [(50, 1.0), (50, 1.0), (51, 0.0), (50, 0.0)]
    marks = spark.createDataFrame([(["50", "x", "51"],)], "t array<string>")
    marked = marks.select(token_labels(F.col("t"), F.lit(50)).alias("m"))
    assert marked.first()[0] == ["N", "O", "O"]
    assert marked.select(F.transform("m", label_value)).first()[0] == [1.0, 0.0, 0.0]


def test_training_keeps_number_words(spark):
    df = spark.createDataFrame([(1, "fifty of 51", 50)], "pmid long, abstract string, tt_sample_size long")
    assert [r["num"] for r in labelled_candidates(df).collect()] == [51]
    assert [r["num"] for r in labelled_candidates(df, normalize=True).orderBy("idx").collect()] == [50, 51]


def test_tags_small_and_large_lexicon(spark):
    df = spark.createDataFrame([(["The", "50", "(", "zzz", "1.5", "patients"],)], "t array<string>")
    assert df.select(tk.tag_tokens(F.col("t"))).first()[0] == ["DT", "CD", "-LRB-", "XX", "CD", "NNS"]
    large = {"NN": [f"word{i}" for i in range(800)] + ["zzz"], "DT": ["the"]}
    got = df.select(tk.tag_tokens(F.col("t"), large)).first()[0]
    assert got == ["DT", "CD", "-LRB-", "NN", "CD", "XX"]


@pytest.mark.parametrize("limit", [0, LOOKUP_BYTES])
def test_lexicon_table(spark, limit):
    table = spark.createDataFrame([("The", "DT"), ("zzz", "NN"), ("zzz", "JJ"), ("odd", "no tag"), (".", "NN"), ("7", "NN")], "token string, tag string")
    df = spark.createDataFrame([(["the", "ZZZ", "patients", "odd", ".", "7", "8.5", "The"],), ([],), (None,)], "t array<string>")
    got = [r["tags"] for r in tagged(df, "t", table, limit=limit).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [["DT", "JJ", "XX", "XX", ".", "NN", "CD", "DT"], [], None]))


def test_lexicon_of_a_million_words(spark):
    table = spark.range(1_000_000).selectExpr("concat('word', id) AS token", "CASE WHEN id % 2 = 0 THEN 'NN' ELSE 'VB' END AS tag")
    words = [f"Word{i}" for i in (3, 999_998, 1_000_000)]
    df = spark.createDataFrame([(words,)], "t array<string>")
    assert tagged(df, "t", table).first()["tags"] == ["VB", "NN", "XX"]
    table = table.unionByName(spark.createDataFrame([("aaa", "NN"), ("Bbb", "VB"), ("7", "SYM")], "token string, tag string"))
    docs = spark.createDataFrame([(1, "aaa 50 BBB 7"), (2, "none"), (3, "8")], "pmid long, abstract string")
    rows = explode_candidates(build_candidates(docs, lexicon=table)).orderBy("pmid", "idx").collect()
    assert [(r["num"], r["left_pos"], r["right_pos"]) for r in rows] == [(50, "NN", "VB"), (7, "VB", "XX"), (8, "XX", "XX")]


def test_pandas_tokenizer(spark):
    import pandas as pd

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return texts.str.split("_")

    df = spark.createDataFrame([(1, "fifty_of_60")], "pmid long, abstract string")
    rows = explode_candidates(build_candidates(df, tokenizer=words)).filter("num > 55").collect()
    assert [(r["idx"], r["num"]) for r in rows] == [(2, 60)]

    @F.pandas_udf("array<string>")
    def tags(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: [f"T{i}" for i in range(len(t))])

    tagged = build_candidates(df, tokenizer=words, array_tagger=tags)
    rows = explode_candidates(tagged).orderBy("idx").collect()
    assert [(r["num"], r["left_pos"], r["right_pos"]) for r in rows] == [(50, "XX", "T1"), (60, "T1", "XX")]


def test_filters_stop_at_the_candidates_and_ids_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "50 of 60")], "pmid long, abstract string").write.parquet(path)
    docs = build_candidates(spark.read.parquet(path))
    some = docs.filter((F.size("candidates") > 0) & (F.col("candidates")[0]["num"] > 1) & (F.col("pmid") < 5))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and len(plan) < 60_000
    assert "PushedFilters: [IsNotNull(pmid), LessThan(pmid,5)]" in plan
    assert some.count() == 1


def test_one_hot_of_unknown_tag_is_zero(spark):
    df = spark.createDataFrame([("NN", "nope"), ("XX", "``")], "left_pos string, right_pos string")
    rows = one_hot_tags(df).collect()
    assert rows[0]["left_hot"].toArray()[tk.TAGS.index("NN")] == 1.0
    assert rows[0]["right_hot"].toArray().sum() == 0.0 and rows[0]["right_hot"].size == 56
    assert rows[1]["right_hot"].toArray()[55] == 1.0


def test_features_are_computed_once_and_without_shuffle(spark):
    df = spark.createDataFrame([(1, "50 patients")], "pmid long, abstract string")
    rows = explode_candidates(build_candidates(df))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("regexp_extract_all(_text") == 1
    assert plan.count("ArrowEvalPython") == 1


def test_long_numbers_and_many_numbers(spark):
    big = "1234567890123456789012345"
    rows = from_tokens(spark, [[big, "60", "patients", "9" * 50, "60"]])
    assert [r["num"] for r in rows] == [int(big), 60, None, 60]
    assert [other(r, "biggest") for r in rows] == [0.0, 0.0, 1.0, 0.0]
    assert [other(r, "rank_prop") for r in rows] == [0.5, 0.0, 0.75, 0.0]
    assert [other(r, "repeated") for r in rows] == [0.0, 1.0, 0.0, 1.0]
    rng = random.Random(7)

    def seconds(n):
        df = spark.createDataFrame([(1, " ".join(str(rng.randrange(10**6)) for _ in range(n)))], "pmid long, abstract string")
        start = time.time()
        assert explode_candidates(build_candidates(df)).select("other").collect()
        return time.time() - start

    seconds(100)
    assert seconds(16_000) < 30


def test_no_features_are_built_where_none_are_asked_for(spark):
    df = spark.createDataFrame([(1, "50 of 60 and n=1,234 n=50.5 n=7")], "pmid long, abstract string")
    docs = build_candidates(df, features=False)
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "arrays_overlap" not in plan
    assert [r["num"] for r in explode_candidates(docs).collect()] == [50, 60, 1234, 7]
    assert [r["num"] for r in explode_candidates(build_candidates(df, normalize=False)).collect()] == [50, 60, 7]
