from collections import Counter

import pytest
from pyspark.sql import functions as F

from trialnum.llm.exact_dedup import drop_duplicates, duplicate_classes
from trialnum.llm.mixing import mix_sources

ROWS = [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (None, "a"), (None, "z"), (5, "b" * 100_000), (6, "b" * 100_000), (7, "A"), (8, "b" * 99_999 + "c")]


@pytest.mark.parametrize("digest", [None, lambda t: F.encode((F.length(t) % 2).cast("string"), "utf-8")])
@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_classes_compare_bytes_whatever_the_hash(spark, keep, digest):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in ROWS], "doc_id long, text string, key string, group_size int")
    rows = duplicate_classes(df, keep=keep, **({"digest": digest} if digest else {})).collect()
    best = min if keep == "smallest" else max
    assert len(rows) == len(ROWS)
    groups = {}
    for i, t in ROWS:
        groups.setdefault(t or "", []).append(i)
    want = Counter((i, best((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""])) for i, t in ROWS)
    assert Counter((r.id, r.keep_id, r.group_size) for r in rows) == want
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter({r.text_sha256: 1 for r in rows})
    assert all(r.id == r.keep_id for r in rows if r.kept)
    assert sorted(r.text or "" for r in drop_duplicates(df, keep=keep).collect()) == sorted(groups)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert duplicate_classes(df).count() == 0 and drop_duplicates(df).count() == 0 and mix_sources(df).count() == 0


def test_mix_meets_its_targets_and_repeats(spark):
    rows = [(i, "w " * (i % 50 + 1), f"s{i % 3}" if i % 7 else None) for i in range(4000)] + [(1, None, "s0"), (1, "x", "s0"), (1, "x", "s0"), (9, " \n", "empty")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, source string, size string, target int").repartition(7)
    got = mix_sources(df).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, mix_sources(df.repartition(3)).collect()))
    assert len(got) == len(rows) and all(0 <= r.copies <= 2 for r in got)
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, target = 1.5 * sum(size.values()), {}
    open_ = set(names)
    while True:  # water filling
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * size[s]}
        if not full:
            break
        for s in full:
            target[s] = 2 * size[s]
            left -= target[s]
        open_ -= full
    target |= {s: weight[s] * level for s in open_}
    by_size = {r.source_size: r.target for r in got}
    assert {size[s]: pytest.approx(target[s]) for s in names} == by_size
    taken = Counter()
    for r in got:
        taken[r.source_size] += r.copies * r.size
    assert all(abs(taken[size[s]] - target[s]) <= 50 for s in names)
