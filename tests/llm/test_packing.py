import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trialnum.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, item string, len int"


def test_sweep_gives_each_gap_the_largest_item_left():
    size = np.array([2, 4, 5, 6, 7, 9, 11])  # items 1 2, gap 2, item 3, gaps 3 4 5
    i, g = packing.sweep(size, size % 2 == 1)
    assert sorted(zip(i.tolist(), g.tolist(), strict=True)) == [(0, 5), (1, 2), (3, 4)]


def test_flows_match_ranges_like_one_sweep():
    rng = random.Random(1)
    for _ in range(200):
        parts = [(k, rng.randrange(4), rng.randrange(4)) for k in range(6)]
        depth = matched = 0
        for _, gaps, items in parts:
            take = min(depth, gaps)
            matched += take
            depth += items - take
        out = packing.flows(parts)
        assert sum(f[4] for f in out) == matched and len(out) <= 12
        taken = [(f[0], r) for f in out for r in range(f[1], f[1] + f[4])]
        assert len(set(taken)) == len(taken)


@pytest.mark.parametrize("local", [0, 10**6])
@pytest.mark.parametrize("lens", [[1] * 300, [64] * 40 + [31] * 9, [40] * 50 + [24] * 50, list(range(1, 64)) * 3, []])
def test_best_fit_fills_within_capacity(spark, monkeypatch, lens, local):
    monkeypatch.setattr(packing, "LOCAL", local)
    items = spark.createDataFrame(list(enumerate(lens)), "item long, len long").repartition(5)
    items = items.where("len < 64")
    rows = packing.best_fit(items, 64).collect()
    lens = [n for n in lens if n < 64]
    assert sorted(r["len"] for r in rows) == sorted(lens) and len({r["item"] for r in rows}) == len(lens)
    load = {}
    for r in rows:
        load[r["seq"]] = load.get(r["seq"], 0) + r["len"]
    assert all(v <= 64 for v in load.values())
    assert len(load) <= 1.1 * -(-sum(lens) // 64) + 2


def test_pack_equals_whole_text_encoding(spark, small):
    texts = ["", None, "a", "It's 42% !! <|endoftext|> x\x1cy İ é  ́z\n", "word " * 5000, "a", "été " * 3]
    docs = [(i, t) for i, t in enumerate(texts)] + [(2, "a"), (None, "n")]
    docs += [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS)
    rows = packing.pack(df, PATH).collect()
    plain = Tokenizer.from_file(PATH)
    want = []
    for i, t in docs:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(i, k, a, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048)) for p in [ids[a : a + 2048]]]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r[:5]) for r in rows), key=key) == sorted(want, key=key)
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(at) <= 1.05 * sum(w[3] for w in want) / 2048 + 2


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_a_small_cache_changes_nothing(monkeypatch):
    texts = ["one two, three", "four five six. seven", "one two eight", None] * 40
    want = list(packing.WordEncoder(PATH).encode(texts))
    monkeypatch.setattr(packing, "CACHE", 6)
    assert list(packing.WordEncoder(PATH).encode(texts)) == want
