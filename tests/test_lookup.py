import random

import pytest
from pyspark.sql import functions as F

from trialnum.operators import lookup, tables, vocabulary
from trialnum.operators.candidates import build_candidates, explode_candidates
from trialnum.operators.numbering import number_rows
from trialnum.operators.tables import shared_folder


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lists(seed=1, n=300):
    rng = random.Random(seed)
    words = ["the", "", "\x00", "été", None] + [f"w{i}" for i in range(60)]
    rows = [(i, [rng.choice(words[:3] if rng.random() < 0.6 else words) for _ in range(rng.randrange(12))]) for i in range(n)]
    return [*rows, (n, None), (n + 1, []), (n + 2, ["the"] * 2000), (n + 2, ["the"] * 2000), (n + 3, ["a", "b\",\"c"]), (n + 3, ["a\",\"b", "c"])]


@pytest.mark.parametrize("hot", [1, 3, 1000])
@pytest.mark.parametrize("limit", [0, lookup.LOOKUP_BYTES])
def test_values_of_words_by_both_ways(spark, monkeypatch, limit, hot):
    monkeypatch.setattr(lookup, "HOT_WORDS", hot)
    rows, table = lists(), {"the": 1, "w5": 2, "w7": 3, "": 4, "été": 5, "nowhere": 6, "\x00": 7, "c": 8}
    df = spark.createDataFrame(rows, "i long, words array<string>").withColumn("token", F.lit("x"))
    known = spark.createDataFrame(sorted(table.items()), "token string, id int")
    got = lookup.looked_up(df, "words", known, "id", [0], "ids", limit)
    assert got.columns == ["i", "words", "token", "ids"]
    want = sorted(str((i, w, [table.get(x, 0) for x in w or []])) for i, w in rows)
    assert sorted(str((r["i"], r["words"], r["ids"])) for r in got.collect()) == want
    pairs = known.select("token", F.array(F.col("id").cast("float"), F.lit(0.5)).alias("vec"))
    wide = lookup.looked_up(df, "words", pairs, "vec", [0.0, -1.0], "v", limit)
    want = sorted(str((i, [v for x in w or [] for v in ((float(table[x]), 0.5) if x in table else (0.0, -1.0))])) for i, w in rows)
    assert sorted(str((r["i"], r["v"])) for r in wide.collect()) == want
    empty = known.limit(0)
    assert {x for r in lookup.looked_up(df, "words", empty, "id", [9], "ids", limit).collect() for x in r["ids"]} == {9}


def test_rows_move_once_and_words_that_are_frequent_do_not(spark):
    rows = [(i, ["the", f"w{i % 50}", f"u{i}"], "x" * 50) for i in range(2000)]
    df = spark.createDataFrame(rows, "i long, words array<string>, payload string")
    known = spark.createDataFrame([(f"w{i}", i) for i in range(50)] + [("the", 99)], "token string, id int")
    got = lookup.looked_up(df, "words", known, "id", [0], "ids", limit=0)
    assert all(r["ids"] == [99, r["i"] % 50, 0] for r in got.collect())
    found = plan(got).split("Initial Plan")[-1]
    moved = [line for line in found.splitlines() if "Exchange hashpartitioning" in line]
    # the only exchange of rows is the one above a projection that has their other columns
    carriers = [k for k, line in enumerate(found.splitlines()) if "Exchange hashpartitioning" in line and "payload" in found.splitlines()[k + 1]]
    assert len(carriers) == 1 and len(moved) > 1
    assert "BroadcastHashJoin" in found


def test_documents_and_rows_are_encoded_alike(spark):
    texts = ["We saw 50 patients and 7 of 9.", "none", None, "3", "12 12 BoS 4 LoS 5"]
    df = spark.createDataFrame(list(enumerate(texts)), "pmid long, abstract string")
    known = vocabulary.fit_vocabulary(df)
    full, light = build_candidates(df), build_candidates(df, features=False, neighbours=True)
    keep = ["pmid", "idx", "num", "left_word", "right_word"]
    rows = lambda d: sorted(map(str, explode_candidates(d).select(*keep).collect()))
    assert rows(full) == rows(light) and "ArrowEvalPython" not in plan(light)
    names = ["pmid", "idx", "left_ids", "right_ids"]
    by_row = vocabulary.encode_words(explode_candidates(full), known).select(*names)
    for limit in (0, lookup.LOOKUP_BYTES):
        by_document = explode_candidates(vocabulary.encode_documents(light, known, limit)).select(*names)
        assert sorted(map(str, by_row.collect())) == sorted(map(str, by_document.collect()))
    vectors = vocabulary.vocabulary_vectors(known, 3)
    names = ["pmid", "idx", "left_vec", "right_vec"]
    by_row = vocabulary.embed_words(explode_candidates(full), vectors, 3).select(*names)
    by_document = explode_candidates(vocabulary.embed_documents(light, vectors, 3, 0)).select(*names)
    assert sorted(map(str, by_row.collect())) == sorted(map(str, by_document.collect()))


def test_most_frequent_words_with_ties_and_all_of_them(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(40) ** 2 // 30}" for _ in range(900)] + [f"once{i}" for i in range(50)]
    rng.shuffle(words)
    docs = [(i, " ".join(words[i * 10 : i * 10 + 10])) for i in range(95)]
    df = spark.createDataFrame(docs, "pmid long, abstract string").repartition(5)
    order = {}
    for w in words:
        order.setdefault(w, [0, len(order)])[0] += 1
    want = [w for w, _ in sorted(order.items(), key=lambda x: (-x[1][0], x[1][1]))]
    for k in (1, 5, len(want) - 30, len(want), len(want) + 9, None):
        got = vocabulary.fit_vocabulary(df, max_features=k).orderBy("id").collect()
        assert [r["token"] for r in got] == want[:k] and [r["id"] for r in got] == list(range(1, len(got) + 1))
    assert vocabulary.fit_vocabulary(df.limit(0)).count() == 0
    assert "TakeOrdered" not in plan(vocabulary.fit_vocabulary(df, max_features=5))


def test_numbers_of_rows_in_any_order(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 1, rng.randrange(1000), None]), i, "x" * 20) for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, b long, text string").repartition(7)
    got = number_rows(df, F.col("a").desc_nulls_last(), "b", out="n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 3001))
    assert [(r["a"], r["b"]) for r in got] == sorted([r[:2] for r in rows], key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))


def test_a_cluster_has_to_name_its_shared_folder():
    class Conf:
        def get(self, name, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared_folder(Session())


def test_words_of_lists_are_made_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(lookup, "written", lambda df: kept.append(plan(df)) or tables.written(df))
    df = spark.createDataFrame([(i, ["the", f"w{i % 9}", None, "the"]) for i in range(300)], "i long, words array<string>")
    known = spark.createDataFrame([("w1", 1), ("the", 9)], "token string, id int")
    got = lookup.looked_up(df, "words", known, "id", [0], "ids", limit=0)
    assert all(r["ids"] == [9, int(r["i"] % 9 == 1), 0, 9] for r in got.collect())
    made = kept[0]
    assert made.count("ArrowEvalPython") and "Generate explode" in made
    assert "ArrowEvalPython" not in plan(got) and "Generate" not in plan(got)  # the list's words are read, not made again


def test_places_of_words(spark):
    rows = [(1, ["b", "a", "b"]), (2, []), (3, None), (4, [None, "", None])]
    got = spark.createDataFrame(rows, "i int, w array<string>").coalesce(1).select("i", lookup._places()("w").alias("p"))
    found = {r["i"]: {x["token"]: x["_places"] for x in r["p"]} for r in got.collect()}
    assert found == {1: {"b": [0, 2], "a": [1]}, 2: {}, 3: {}, 4: {None: [0, 2], "": [1]}}


def test_words_that_many_lists_share_are_looked_up_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(lookup, "written", lambda df: kept.append(tables.written(df)) or kept[-1])
    df = spark.createDataFrame([(i, ["the", f"w{i % 9}", None, "the", f"v{i % 300}"]) for i in range(600)], "i long, words array<string>").coalesce(2)
    known = spark.createDataFrame([("w1", 1), ("the", 9)], "token string, id int")
    got = lookup.looked_up(df, "words", known, "id", [0], "ids", limit=0)
    assert all(r["ids"] == [9, int(r["i"] % 9 == 1), 0, 9, 0] for r in got.collect())
    # a word a chunk, not one for each list, which would be 2,400 rows
    assert kept[0].count() <= 2 * (1 + 2 + 9 + 300)


@pytest.mark.parametrize("most", [1, 7, 1 << 18])
def test_lists_are_parted_again_whatever_the_chunk(spark, monkeypatch, most):
    monkeypatch.setattr(lookup, "CHUNK_WORDS", most)
    rows = lists(seed=2, n=80)
    table = {"the": [1.0, None], "w5": [2.0, 2.5], "": [4.0, 4.5]}
    df = spark.createDataFrame(rows, "i long, words array<string>").repartition(3)
    known = spark.createDataFrame(list(table.items()), "token string, vec array<double>")
    got = lookup.looked_up(df, "words", known, "vec", [0.0, -1.0], "v", limit=0)
    want = sorted(str((i, w, [v for x in w or [] for v in table.get(x, [0.0, -1.0])])) for i, w in rows)
    assert sorted(str((r["i"], r["words"], r["v"])) for r in got.collect()) == want
