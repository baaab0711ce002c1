import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trialnum.operators import evaluate as ev
from trialnum.operators import numbering, scoring, vocabulary
from trialnum.operators import annotations as ann

GOLD = "pmid long, tt_sample_size long, fold_id int"
PRED = "pmid long, pred_ss long"
LOOSE = "pmid long, total long, poss array<bigint>"


def reference_cells(gold, pred, same, by_fold=False, how="outer"):
    """Row-by-row outer join and counting, in plain Python."""
    rows = []
    for pmid, tt, fold in gold:
        hits = [p for p in pred if p[0] == pmid]
        rows += [(pmid, tt, fold, v) for _, v in hits]
        if not hits and how == "outer":
            rows.append((pmid, tt, fold, None))
    if how == "outer":
        known = {g[0] for g in gold}
        rows += [(p, None, None, v) for p, v in pred if p not in known]
    cells = {}
    for pmid, tt, fold, v in rows:
        key = fold if by_fold else None
        if by_fold and fold is None:
            continue
        c = cells.setdefault(key, Counter())
        s = same(pmid, tt, v)
        c["tp"] += s and tt is not None
        c["tn"] += tt is None and v is None
        c["fp"] += (not s) and v is not None
        c["fn"] += v is None and tt is not None
        c["joined_rows"] += 1
    for c in cells.values():
        c["gold_rows"] = c["joined_rows"] if by_fold else len(gold)
    return cells


def exact(pmid, tt, v):
    return tt == v


def loose_rule(annotations):
    table = {p: (t, s) for p, t, s in annotations}

    def rule(pmid, tt, v):
        if pmid not in table:
            return False
        total, poss = table[pmid]
        if v is None:
            return total is None
        if v in [x for x in poss if x is not None] or v == total:
            return True
        return total is not None and total * (1 - 0.1) <= v <= total * (1 + 0.1)

    return rule


def check(df, want, by_fold):
    names = ["tp", "tn", "fp", "fn", "joined_rows", "gold_rows"]
    got = {(r["fold_id"] if by_fold else None): {n: r[n] for n in names} for r in df.collect()}
    assert got == {k: {n: c[n] for n in names} for k, c in want.items()}


@pytest.fixture(scope="module")
def tables(spark):
    """Repeated keys on both sides, one of them with a third of all rows."""
    rng = random.Random(1)
    pick = lambda: rng.choice([None, 10, 11, 20, 50])
    gold = [(rng.randint(1, 40), pick(), rng.randint(0, 2)) for _ in range(120)] + [(7, pick(), 1) for _ in range(60)]
    pred = [(rng.randint(10, 60), pick()) for _ in range(120)] + [(7, pick()) for _ in range(60)]
    loose = [(p, pick(), [pick(), pick()]) for p in range(5, 55)]
    frames = [spark.createDataFrame(d, s) for d, s in ((gold, GOLD), (pred, PRED), (loose, LOOSE))]
    return gold, pred, loose, *frames


@pytest.mark.parametrize("by_fold", [False, True])
def test_exact_cells(tables, by_fold):
    gold, pred, _, g, p, _ = tables
    check(ev.confusion_exact(g, p, by_fold=by_fold), reference_cells(gold, pred, exact, by_fold), by_fold)


@pytest.mark.parametrize("by_fold", [False, True])
def test_loose_cells(tables, by_fold):
    gold, pred, loose, g, p, a = tables
    want = reference_cells(gold, pred, loose_rule(loose), by_fold)
    check(ev.confusion_loose(g, p, a, by_fold=by_fold), want, by_fold)


def test_inner_cells(tables):
    gold, pred, _, g, p, _ = tables
    check(ev.confusion_exact(g, p, how="inner"), reference_cells(gold, pred, exact, how="inner"), False)


@pytest.mark.parametrize("loose", [False, True])
def test_match_rows_agree_with_cells(tables, loose):
    gold, pred, ann_rows, g, p, a = tables
    rows = ev.match_rows(g, p, a if loose else None)
    same = loose_rule(ann_rows) if loose else exact
    want = reference_cells(gold, pred, same)[None]
    got = rows.agg(
        F.count(F.lit(1)), F.count_if(F.col("same") & ~F.col("no_ss")),
        F.count_if(~F.col("same") & ~F.col("no_pred_ss")),
    ).first()
    assert tuple(got) == (want["joined_rows"], want["tp"], want["fp"])


def test_every_null_combination(spark):
    g = spark.createDataFrame([(1, 5, 0), (2, 5, 0), (3, None, 0), (4, None, 0)], GOLD)
    p = spark.createDataFrame([(1, 5), (2, None), (3, 5), (4, None)], PRED)
    r = ev.confusion_exact(g, p).first()
    assert (r["tp"], r["fn"], r["fp"], r["tn"]) == (1, 1, 1, 1)
    m = ev.evaluate_exact(g, p).first()
    assert (m["precision"], m["recall"], m["accuracy"], m["f1"]) == (0.5, 0.5, 0.5, 0.5)


def test_no_rows_and_zero_divisors_give_null(spark):
    g = spark.createDataFrame([(1, None, 0)], GOLD)
    p = spark.createDataFrame([], PRED)
    m = ev.evaluate_exact(g, p).first()
    assert (m["precision"], m["recall"], m["accuracy"], m["f1"]) == (None, None, 1.0, None)


def test_loose_bounds_are_inclusive(spark):
    values = [(100, 90, True), (100, 110, True), (100, 89, False), (100, 111, False), (50, 55, True), (None, 3, False)]
    df = spark.createDataFrame([(i, t, v, w) for i, (t, v, w) in enumerate(values)], "i int, t long, v long, w boolean")
    same = ev.loose_match(F.col("t"), F.array().cast("array<bigint>"), F.col("v"), F.lit(True), 0.1)
    assert df.filter(same != F.col("w")).count() == 0


def test_fold_summary(spark):
    rows = [(0, 0.5, 1.0, None, 0.1), (1, 1.0, 0.0, None, 0.3)]
    df = spark.createDataFrame(rows, "fold_id int, precision double, recall double, accuracy double, f1 double")
    got = {r["metric"]: (r["min"], r["max"], r["mean"]) for r in ev.fold_summary(df).collect()}
    assert got["precision"] == (0.5, 1.0, 0.75) and got["accuracy"] == (None, None, None)


def test_top_candidate_ties_and_thresholds(spark):
    rows = [(1, 4, 10, 0.5), (1, 2, 20, 0.5), (2, 0, 7, 0.2), (3, 0, 8, 0.25), (3, 1, 9, 0.1)]
    scored = spark.createDataFrame(rows, "pmid long, idx int, num long, conf double")
    top = scoring.top_candidates(scored).orderBy("pmid").collect()
    assert [tuple(r) for r in top] == [(1, 2, 20, 0.5), (3, 0, 8, 0.25)]
    docs = spark.createDataFrame([(1,), (2,), (3,), (4,), (4,)], "pmid long")
    got = scoring.extract_documents(docs, scored, report=0.4).orderBy("pmid").collect()
    assert [tuple(r) for r in got] == [(1, 20, 0.5), (2, None, None), (3, None, 0.25), (4, None, None), (4, None, None)]


def test_best_in_row_keeps_every_row(spark):
    schema = "pmid long, candidates array<struct<idx:int,num:bigint>>"
    rows = [(1, [(4, 10), (2, 10)]), (1, [(0, 30)]), (2, []), (3, None), (4, [(0, 2)])]
    df = spark.createDataFrame(rows, schema)
    got = scoring.best_in_row(df, lambda c: c["num"] / 100.0, keep=0.1, report=0.2).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(
        map(str, [(1, None, 0.1), (1, 30, 0.3), (2, None, None), (3, None, None), (4, None, None)])
    )
    plan = scoring.best_in_row(df, lambda c: c["num"] / 100.0)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_vocabulary_order_unknowns_and_ids(spark):
    docs = spark.createDataFrame([(2, "b b A"), (1, "c, a! it's")], "pmid long, abstract string")
    vocab = vocabulary.fit_vocabulary(docs, max_features=3)
    assert [tuple(r) for r in vocab.orderBy("id").collect()] == [("a", 1, 2), ("b", 2, 2), ("c", 3, 1)]
    text = vocabulary.unknown_rewritten(docs, vocab).orderBy("pmid").select("rewritten").collect()
    assert [r[0] for r in text] == ["c a unkunk", "b b a"]
    cands = spark.createDataFrame([(["BoS", "a"], ["", "c"])], "left_word array<string>, right_word array<string>")
    r = vocabulary.encode_words(cands, vocab).first()
    assert (r["left_ids"], r["right_ids"]) == ([0, 1], [0, 3])


def test_vectors(spark):
    vocab = spark.createDataFrame([("a", 1, 9), ("b", 2, 5)], "token string, id int, cnt long")
    given = spark.createDataFrame([("a", [1.0, 2.0]), ("z", [3.0, 4.0])], "token string, vec array<float>")
    rows = {r["token"]: list(r["vec"]) for r in vocabulary.vocabulary_vectors(vocab, 2, given).collect()}
    assert rows["a"] == [1.0, 2.0] and all(-1 < x <= 1 for x in rows["b"])
    assert rows == {r["token"]: list(r["vec"]) for r in vocabulary.vocabulary_vectors(vocab, 2, given).collect()}


def test_row_numbers_follow_the_key(spark):
    keys = random.Random(2).sample(range(10**6), 3000)
    df = spark.createDataFrame([(k,) for k in keys], "pmid long").repartition(7)
    got = {r["pmid"]: r["row_no"] for r in numbering.number_rows(df, "pmid").collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}
    assert numbering.number_rows(df.limit(0), "pmid").count() == 0


def test_folds(spark):
    df = spark.range(1003).select(F.col("id").alias("pmid"))
    df = df.union(spark.range(500).select(F.lit(5).cast("long")))
    even = numbering.assign_even_folds(df, k=5)
    sizes = [r[0] for r in even.groupBy("fold_id").agg(F.count_distinct("pmid")).select("count(DISTINCT pmid)").collect()]
    assert sorted(sizes) == [200, 200, 201, 201, 201] and even.count() == 1503
    assert even.filter("pmid = 5").select("fold_id").distinct().count() == 1
    quick = numbering.assign_folds(df, k=5)
    assert quick.select("fold_id").distinct().count() == 5
    assert "Exchange" not in numbering.assign_folds(spark.range(9).toDF("pmid"))._jdf.queryExecution().executedPlan().toString()


def test_annotations(spark):
    lines = [
        ("1", 0, "T1\ttotal_sample_SIZE 3 5\tfifty"), ("1", 1, "T2\tTotal_sample_size 9 12\t1,250"),
        ("1", 2, "T3\tPoss_total_sample 1 2\tten"), ("1", 3, "T4\tPoss_total_sample 1 2\tsome"),
        ("1", 4, "R1\tpart_of Arg1:T3 Arg2:T12"), ("1", 5, "#1\tNote T1\tx"), ("2", 0, "T1\tOther 1 2\t7"),
        ("3", 0, "T1\tTotal_sample_size 1 2\t10"), ("3", 1, "T2\tTotal_sample_size 1 2\tunclear"),
    ]
    df = spark.createDataFrame(lines, "pmid string, line_no int, line string")
    ids = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "pmid string")
    entities = ann.entities(df)
    first = entities.filter("pmid = '1' AND line_no = 0").first()
    assert tuple(first)[2:] == (1, "Total_sample_size", 3, 5, "fifty")
    assert tuple(ann.relations(df).first()) == ("1", 4, 1, "part_of", 3, 12)
    gold = ann.gold_totals(entities, ids).collect()
    assert sorted(map(str, ((p, None if n is None else int(n)) for p, n in gold))) == sorted(
        map(str, [("1", 50), ("1", 1250), ("2", None), ("3", 10), ("3", None), ("4", None)])
    )
    loose = {r["pmid"]: (r["total"], r["poss"]) for r in ann.loose_totals(entities, ids).collect()}
    assert loose == {"1": (1250, [10]), "2": (None, []), "3": (None, []), "4": (None, [])}
    nested = {r["pmid"]: len(r["items"]) for r in ann.nested(entities, ids).collect()}
    assert nested == {"1": 4, "2": 1, "3": 2, "4": 0}


def test_assembled_abstracts(spark):
    titles = spark.createDataFrame([(5, "T5"), (2, "T2"), (9, "T9")], "pmid long, title string")
    sections = spark.createDataFrame(
        [(5, 2, None, "b"), (5, 1, "AIM", "a"), (9, 1, "X", "y")], "pmid long, pos int, label string, text string"
    )
    got = ann.assemble_abstracts(titles, sections).orderBy("record_no").collect()
    assert [(r["pmid"], r["abstract"], r["record_no"]) for r in got] == [
        (5, "TITLE: T5\nAIM: a\nb\n", 1), (9, "TITLE: T9\nX: y\n", 2),
    ]


def test_exact_cells_do_not_truncate_gold(spark):
    gold = spark.createDataFrame([(1, 50.7), (2, 50.0)], "pmid long, tt_sample_size double")
    pred = spark.createDataFrame([(1, 50), (2, 50)], "pmid long, pred_ss long")
    row = ev.confusion_exact(gold, pred).first()
    assert (row["tp"], row["fp"], row["fn"]) == (1, 1, 0)
    assert {r["pmid"]: r["same"] for r in ev.match_rows(gold, pred).collect()} == {1: False, 2: True}


def test_cells_read_each_table_once(spark, tmp_path):
    path = lambda name: str(tmp_path / name)
    spark.createDataFrame([(1, 5, 0), (1, 5, 1), (2, None, 0)], "pmid long, tt_sample_size long, fold_id int").write.parquet(path("g"))
    spark.createDataFrame([(1, 5), (3, 4)], "pmid long, pred_ss long").write.parquet(path("p"))
    spark.createDataFrame([(1, 5, [7])], "pmid long, total long, poss array<long>").write.parquet(path("a"))
    g, p, a = (spark.read.parquet(path(n)) for n in "gpa")
    for by_fold in (False, True):
        plans = [ev.confusion_exact(g, p, by_fold=by_fold), ev.confusion_loose(g, p, a, by_fold=by_fold)]
        scans = [df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") for df in plans]
        assert scans == [2, 3]
        assert "Join" not in plans[0]._jdf.queryExecution().executedPlan().toString()
    assert [r["tp"] for r in ev.confusion_exact(g, p, by_fold=True).orderBy("fold_id").collect()] == [1, 1]
