import hashlib
import zlib

import numpy as np
import public_tokenizers
from test_simhash import brute_classes, plain_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from trialnum.llm.quality import quality_scores


def plain_mix(rows):
    """Copies of (doc_id, text, source) rows by water filling and systematic sampling, in plain Python."""
    size = {}
    for _, text, source in rows:
        size[source] = size.get(source, 0) + len((text or "").encode().split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(size.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * size[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= full
    out = []
    for s in names:
        own = sorted(((len((t or "").encode().split()), i, t) for i, t, x in rows if x == s), key=lambda r: r[:2])
        rate = target[s] / size[s] if size[s] else 0.0
        u = int(hashlib.md5(("42/" + ("n" if s is None else "s" + s)).encode()).hexdigest()[:8], 16) / 2**32
        for rank, (_, i, t) in enumerate(own):
            out += [(i, t)] * int(np.floor(rate * (rank + 1) + u) - np.floor(rate * rank + u))
    return out


def test_stages_equal_a_plain_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    held = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small).persist()
        held.append((name, docs))
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    rows = {name: [tuple(r) for r in df.collect()] for name, df in held}
    every = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    labels = spark.read.parquet(f"{small}/labels.parquet")
    good = {r.id for r in quality_scores(spark.read.parquet(f"{small}/documents.parquet"), labels).collect() if r.predicted}
    assert 0 < len(good) < len(every) and sorted(rows["quality"]) == sorted(r for r in every if r[0] in good)

    last = {}
    for r in rows["quality"]:
        last[r[1]] = max(last.get(r[1], r), r)
    assert sorted(rows["exact dedup"]) == sorted(last.values())

    of = {r[0]: plain_fingerprint(r[1]) for r in rows["exact dedup"]}
    first = {min(i for i, c in of.items() if c in group) for group in map(set, brute_classes(sorted(set(of.values()))))}
    assert {r[0] for r in rows["near dedup"]} == first and len(rows["near dedup"]) == len(first)

    mixed = plain_mix([(r[0], r[1], r[3]) for r in rows["near dedup"]])
    assert sorted((r[0], r[1]) for r in rows["mixing"]) == sorted(mixed)

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, text in mixed:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        want += [(i, k, a, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048)) for p in [ids[a : a + 2048]]]
    assert sorted(r[:5] for r in rows["packing"]) == sorted(want)
    load = {}
    for r in rows["packing"]:
        load.setdefault(r[5], []).append((r[6], r[3]))
    for places in load.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert sorted(r[:5] for r in map(tuple, corpus_pipeline.run(spark, small).collect())) == sorted(want)
