import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from trialnum.llm import simhash
from trialnum.llm.components import components


def brute_classes(codes, budget=3):
    label = {c: c for c in codes}

    def find(c):
        while label[c] != c:
            c = label[c]
        return c

    for i, a in enumerate(codes):
        for b in codes[:i]:
            if bin(a ^ b).count("1") <= budget:
                label[find(a)] = find(b)
    groups = {}
    for c in codes:
        groups.setdefault(find(c), set()).add(c)
    return sorted(map(sorted, groups.values()))


def some_codes(n, seed):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        c = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 1, 6, 40])):
            out.add(c)
            for _ in range(rng.randint(1, 4)):
                c ^= 1 << rng.randrange(64)
    return sorted(out)


def plain_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_trie_join_finds_the_classes_of_all_pairs():
    for seed in range(5):
        codes = some_codes(400, seed)
        x = np.array(codes, np.uint64)
        label = simhash.TrieJoin(x, 3).run(np.array([0]), np.array([len(x)]), 0)
        groups = {}
        for c, k in zip(codes, label.tolist(), strict=True):
            groups.setdefault(k, []).append(c)
        assert sorted(map(sorted, groups.values())) == brute_classes(codes)


def test_links_connect_the_same_classes_also_in_cut_nodes(spark, monkeypatch):
    codes = some_codes(500, 9)
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    for node in (20_000, 10):
        monkeypatch.setattr(simhash, "NODE", node)
        roots = components(simhash.hamming_links(spark.createDataFrame([(c,) for c in signed], "fp long"))).collect()
        groups = {c: {c} for c in signed}
        for r in roots:
            groups[r.root] = groups.get(r.root, {r.root}) | {r.u}
            if r.u != r.root:
                groups.pop(r.u, None)
        unsigned = sorted(sorted(x % 2**64 for x in g) for g in groups.values())
        assert unsigned == brute_classes(codes)


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(300)] + [(7, 7)]
    roots = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert roots == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(300)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_documents(spark, small):
    texts = ["", None, " \n", "One", "one", "Two words", "É a b", "x " * 70_000]
    docs = [(i, t) for i, t in enumerate(texts, 1)] + [(3, " \n"), (None, "one"), (None, "solo text here")]
    docs += [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in docs], "doc_id long, text string, fp string, hash int")
    rows = simhash.near_duplicate_classes(df).withColumn("sha", F.col("hash")).collect()
    assert len(rows) == len(docs)
    want = {}
    for _, t in docs:
        want[t] = plain_fingerprint(t)
    got = {(r.id, r.fp % 2**64) for r in rows}
    assert got == {(i, want[t]) for i, t in docs}
    ids = {}
    for i, t in docs:
        ids.setdefault(want[t], []).append(i)
    least = {}
    for group in brute_classes(sorted(set(want.values()))):
        members = [i for c in group for i in ids[c] if i is not None]
        least |= {c: min(members, default=None) for c in group}
    assert {(r.id, r.component_id) for r in rows} == {(i, least[want[t]]) for i, t in docs}
    kept = simhash.drop_near_duplicates(df).collect()
    assert len(kept) == len(brute_classes(sorted(set(want.values()))))
    assert simhash.drop_near_duplicates(df.where("false")).count() == 0
