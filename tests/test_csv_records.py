import random

import pytest

from trialnum.sources import documents as d
from trialnum.sources.csv_records import LineStates, csv_records

SCHEMA = "pmid string, abstract string"


def by_spark(spark, path, schema=SCHEMA):
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
    return sorted(map(str, spark.read.schema(schema).options(**options).csv(path).collect()))


def by_splits(spark, path, schema=SCHEMA):
    return sorted(map(str, d.read_csv(spark, path, schema).collect()))


@pytest.fixture
def split_bytes(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]

    def put(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield put
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def test_lines_lead_from_state_to_state():
    after = LineStates(",").after
    for line, outside, inside in [
        ("a,b", 0, 1), ('a,"b', 1, 0), ('a,"b"', 0, 0), ('"a ""b"', 0, 0), ('"a ""b', 1, 0), ('x"', 0, 0), ('5" pipe,"x', 1, 1), ('","', 0, 1),
        ('a "q" b', 0, 0), ('""', 0, 1), ('"', 1, 0), ('""""', 0, 1), ('c","d', 1, 1), ('","a","', 1, 1),
    ]:
        assert (after(0, line), after(1, line)) == (outside, inside), line


def test_quotes_and_line_ends_at_every_border_of_splits(spark, tmp_path, split_bytes):
    path = tmp_path / "in.csv"
    path.write_text('pmid,abstract\n1,"a ""b"",\nc\n"\n2,plain\n\n3,"""\n"""\n4,""\n5,"é\n\n,"\n6,"x\ny\nz\n"\n7,last')
    want = by_spark(spark, str(path))
    assert len(want) == 7
    for size in (1, 2, 3, 5, 8, 13, 21, 34, 1000):
        split_bytes(size)
        assert by_splits(spark, str(path)) == want, size


def test_random_files_equal_sparks_reader(spark, tmp_path, split_bytes):
    rng = random.Random(6)
    pieces = ['""', "\n", ",", "text ", "\n\n", "é", "50 patients", " "]
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(3):
        rows = []
        for i in range(200):
            quoted = rng.random() < 0.6
            text = "".join(rng.choices(pieces, k=rng.randrange(9)))
            rows.append(f'{k}-{i},"{text}"' if quoted else f"{k}-{i},plain {i}")
        (folder / f"{k}.csv").write_text("pmid,abstract\n" + "\n".join(rows) + ("\n" if k else ""))
    want = by_spark(spark, str(folder))
    for size in (97, 1024, 1 << 20):
        split_bytes(size)
        assert by_splits(spark, str(folder)) == want
    assert csv_records(spark, str(folder)).where("first").count() == 3


def test_a_record_over_many_splits_and_windows_line_ends(spark, tmp_path, split_bytes):
    path = tmp_path / "long.csv"
    body = "line of a long text\n" * 3000
    path.write_bytes(("pmid,abstract\r\n1,short\r\n2,\"" + body + "\"\r\n3,\"x\r\ny\"\r\n").encode())
    split_bytes(4096)
    got = d.read_csv(spark, str(path), "pmid bigint, abstract string")
    assert {r["pmid"]: r["abstract"] for r in got.collect()} == {1: "short", 2: body, 3: "x\r\ny"}
    assert csv_records(spark, str(path)).rdd.getNumPartitions() > 5


def test_empty_and_header_only_files(spark, tmp_path):
    (tmp_path / "h.csv").write_text("pmid,abstract\n")
    assert d.read_csv(spark, str(tmp_path / "h.csv"), SCHEMA).count() == 0
    (tmp_path / "e.csv").write_text("")
    assert d.read_csv(spark, str(tmp_path / "e.csv"), SCHEMA).count() == 0
