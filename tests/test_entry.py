import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows

QUICK = [
    "number_words", "number_normalize_documents", "n_equals", "features", "features_documents",
    "extract_all_docs", "confusion_loose_cv", "vocab_topk", "encode_words", "loose_dict", "assemble_sections",
]


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS FROM '{small}/{t}.parquet'")
    return con


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_oracle(spark, small, con, name):
    df = entry.queries()[name](spark, small)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["pmid", "pred_ss", "conf"] and df.count() > 0
