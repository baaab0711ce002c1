import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, hash string, size int, _key int, fp long"
EXTRA = (1, "h", 2, 3, 4)


@pytest.fixture(scope="module")
def rows(small, spark):
    plain = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 40").collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in plain]
    rows += [(None, "a text without an id", None, None, None), (9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "word " * 50_000, "en", "s", 1)]
    return rows + [(9004, "the same text in many rows", "en", "s", 1)] * 2 + [(9005, "the same text in many rows", "en", "s", 1)]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_rows_of_every_kind(spark, small, rows, stage):
    name, run = stage
    docs = spark.createDataFrame([r + EXTRA for r in rows], SCHEMA)
    out = run(spark, docs, small)
    if name == "packing":
        ids = [r["doc_id"] for r in out.where("piece = 0").collect()]
        assert sorted(map(str, ids)) == sorted(str(r[0]) for r in rows)
        return
    assert out.columns == corpus_pipeline.COLUMNS
    found = [tuple(r) for r in out.collect()]
    assert set(found) <= set(rows)
    odd = sorted((r[0] for r in found if r[0] is None or r[0] > 9000), key=str)
    if name == "exact dedup":
        assert odd == [9002, 9003, 9005, None]
    if name == "near dedup":
        assert odd == [9001, 9003, 9004, None]
    if name == "quality":
        assert odd.count(9004) in (0, 2)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_empty_table(spark, small, stage):
    assert stage[1](spark, spark.createDataFrame([], SCHEMA), small).count() == 0
