import random
import zlib

import numpy as np

from trialnum.llm import language, toxicity


def plain_bits(counts, raw, width):
    """Code length by walking up the context tree for each byte."""

    def chance(context, byte):
        own = {}
        for run, n in counts.items():
            if run[:-1].endswith(context):
                own[run[-1]] = own.get(run[-1], 0) + n
        shorter = chance(context[1:], byte) if context else 1 / 256
        if not own:
            return shorter
        n, q = sum(own.values()), len(own)
        return (own.get(byte, 0) + q * shorter) / (n + q)

    return -sum(np.log2(chance(raw[i - 3 : i], raw[i])) for i in range(3, len(raw)))


def test_tables_give_the_code_lengths_of_the_tree():
    texts = {"aa": "the cat sat on the mat", "bb": "der hund und die katze", "cc": "étè ça"}
    counts, runs = {}, {}
    for lang, t in texts.items():
        code, n = np.unique(language.grams(language.folded(t)), return_counts=True)
        counts[lang] = (code, n.astype(float))
        runs[lang] = {int(c).to_bytes(4, "big"): int(k) for c, k in zip(code, n, strict=True)}
    model = language.ContextTrees(counts)
    for probe in ("The cat", "Hund", "zq xx the é", ""):
        want = [plain_bits(runs[x], language.folded(probe), model.width) for x in model.langs]
        assert np.allclose(model.lengths(probe), want, rtol=1e-4)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame(
        [(10**6, None, "en"), (10**6 + 1, " 12 !", "de"), (None, "the thing", None), (10**6 + 2, "the of " * 400_000, "en"), (10**6 + 2, "x", None)], "doc_id long, text string, lang string"
    )
    all_docs = docs.select("doc_id", "text", "lang").unionByName(extra).selectExpr("*", "1 AS id", "'x' AS score")
    rows = language.identify_languages(all_docs).collect()
    assert len(rows) == docs.count() + 5
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows if r.held_out and r.id in truth]
    assert sum(r.lang_pred == truth[r.id] for r in held) / len(held) > 0.97
    assert all(r.held_out == (r.id is not None and zlib.crc32(str(r.id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.id in (10**6, 10**6 + 1)} == {"und"}
    assert language.identify_languages(all_docs.where("false")).count() == 0
    assert {r.lang_pred for r in language.identify_languages(all_docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang").limit(5)).collect()} == {"und"}


def test_block_max_search_is_exact():
    rng = random.Random(3)
    vectors = []
    for _ in range(500):
        v = {rng.randrange(40): rng.choice([1.0, 2.0, 0.5]) for _ in range(rng.randrange(6))}
        norm = sum(w * w for w in v.values()) ** 0.5
        vectors.append({t: w / norm for t, w in v.items()})
    index = toxicity.BlockMaxIndex(vectors, 40)
    for q in vectors[:80]:
        sims = [sum(w * v.get(t, 0) for t, w in q.items()) for v in vectors]
        want = sorted((i for i in range(500) if sims[i] > 0), key=lambda i: (-round(sims[i], 12), i))[:7]
        ids, got = index.nearest(q, 7)
        assert ids.tolist() == want and np.allclose(got, [sims[i] for i in want])


def test_toxic_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    extra = spark.createDataFrame([(10**7, None), (10**7, None), (None, ""), (10**7 + 1, "fine words " * 200_000)], "doc_id long, text string")
    rows = toxicity.toxicity_scores(docs.unionByName(extra).selectExpr("*", "1 AS score", "2 AS label"), labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r, truth[r.id]) for r in rows if r.held_out and r.id in truth]
    caught = [r.predicted for r, y in held if y]
    clean = [r.predicted for r, y in held if not y]
    assert len(rows) == docs.count() + 4 and sum(caught) / len(caught) > 0.9 and sum(clean) / len(clean) < 0.04
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert {r.predicted for r in rows if r.id is None or r.id >= 10**7} == {0}
    assert toxicity.toxicity_scores(docs.where("false"), labels).count() == 0
    assert {r.score for r in toxicity.toxicity_scores(extra, labels.where("false")).collect()} == {0.5}


def test_terms_that_all_examples_have_and_ids_with_many_texts(spark):
    docs = spark.createDataFrame([(i, f"same word{j}") for i in range(30) for j in range(40 if i < 2 else 1)] + [(0, "same word0")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    assert toxicity.toxicity_scores(docs, labels).count() == docs.count()
    one = labels.where("doc_id = 1")
    assert toxicity.toxicity_scores(docs.where("doc_id = 1").limit(1), one).count() == 1
    rows, share = toxicity.labelled_sample(docs, labels, "toxic", 15, "doc_id", "text")
    found = rows.collect()
    assert all(sum(r.label == k for r in found) == 15 for k in (0, 1)) and len(set(found)) == 30 and min(share.values()) > 1
