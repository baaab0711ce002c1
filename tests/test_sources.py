from decimal import Decimal

from pyspark.sql import functions as F

from trialnum.operators.candidates import build_candidates
from trialnum.operators.scoring import best_in_row
from trialnum.plans.annotation import annotation_tables
from trialnum.sources import documents as d
from trialnum.sources import small_files, standoff


def test_csv_with_quotes_lines_and_index(spark, tmp_path):
    path = tmp_path / "gold.csv"
    path.write_text(',pmid,tt_sample_size,fold_id\n0,11,50.0,0\n1,12,,3\n')
    got = d.read_csv(spark, str(path), d.GOLD, index=True).orderBy("pmid").collect()
    assert [tuple(r) for r in got] == [(11, 50, 0), (12, None, 3)]
    docs = tmp_path / "docs.csv"
    docs.write_text('pmid,abstract\n7,"A ""quoted"" word,\nnext line"\n')
    assert tuple(d.read_csv(spark, str(docs), d.DOCUMENTS).first()) == (7, 'A "quoted" word,\nnext line')


def test_round_trips(spark, tmp_path):
    pred = spark.createDataFrame([(1, Decimal(50), 0.5), (2, None, None), (3, Decimal(10**25 + 1), 0.25)], d.PREDICTIONS)
    d.write_csv(pred, str(tmp_path / "csv"))
    d.write_parquet(pred, str(tmp_path / "pq"))
    for got in (
        d.read_csv(spark, str(tmp_path / "csv"), d.PREDICTIONS),
        d.read_parquet(spark, str(tmp_path / "pq"), d.PREDICTIONS),
    ):
        assert sorted(map(str, got.collect())) == sorted(map(str, pred.collect()))
    text = spark.createDataFrame([(1, 'a "b"\n, c')], d.DOCUMENTS)
    d.write_csv(text, str(tmp_path / "text"))
    assert d.read_csv(spark, str(tmp_path / "text"), d.DOCUMENTS).collect() == text.collect()
    loose = spark.createDataFrame([(1, None, [Decimal(5), Decimal(10**30)]), (2, Decimal(3), [])], d.LOOSE)
    d.write_parquet(loose, str(tmp_path / "loose"))
    back = d.read_parquet(spark, str(tmp_path / "loose"), d.LOOSE)
    assert sorted(map(str, back.collect())) == sorted(map(str, loose.collect()))


def test_standoff_folder(spark, tmp_path):
    (tmp_path / "1-100.ann").write_text(
        "T1\tTotal_sample_size 3 5\tfifty\nT2\tPoss_total_sample 9 11\t40\nR1\tpart_of Arg1:T2 Arg2:T1\n"
    )
    (tmp_path / "2-200.ann").write_text("")
    (tmp_path / "3-300.ann").write_bytes(b"T1\tTotal_sample_size 3 5\t1 200\r\nT2\tOther 1 2\tx\r\n")
    for i in (1, 2, 3):
        (tmp_path / f"{i}-{i}00.txt").write_text("TITLE: x\n")
    (tmp_path / "4-400.csv").write_text("T1\tTotal_sample_size 1 2\t9\n")
    tables = annotation_tables(spark, str(tmp_path))
    gold = {r["pmid"]: r["tt_sample_size"] for r in tables["gold"].collect()}
    assert gold == {"100": 50, "200": None, "300": 1200}
    loose = {r["pmid"]: (r["total"], r["poss"]) for r in tables["loose"].collect()}
    assert loose == {"100": (50, [40]), "200": (None, []), "300": (1200, [])}
    assert {r["pmid"]: len(r["items"]) for r in tables["entities_nested"].collect()} == {"100": 2, "200": 0, "300": 2}
    assert tables["relations"].count() == 1
    words = {r["word"] for r in tables["entities"].collect()}
    assert words == {"fifty", "40", "1 200", "x"}


def test_articles(spark, tmp_path):
    article = """<PubmedArticle><MedlineCitation><PMID Version="1">{0}</PMID><Article>
      <ArticleTitle>T {0}</ArticleTitle>{1}</Article></MedlineCitation></PubmedArticle>"""
    body = '<Abstract><AbstractText Label="AIM">a &lt; b</AbstractText><AbstractText>c</AbstractText></Abstract>'
    path = tmp_path / "a.xml"
    path.write_text("<Set>" + article.format(9, body) + article.format(3, "") + article.format(4, body) + "</Set>")
    articles = standoff.read_articles(spark, str(path))
    assert "xml" not in articles._jdf.queryExecution().executedPlan().toString()  # parsed once, when it is read
    got = articles.orderBy("record_no").collect()
    assert [(r["record_no"], r["pmid"]) for r in got] == [(1, 4), (2, 9)]
    assert got[1]["abstract"] == "TITLE: T 9\nAIM: a < b\nc\n"


def test_articles_keep_text_in_and_after_markup(spark, tmp_path):
    path = tmp_path / "b.xml"
    path.write_text(
        '<Set><PubmedArticle><MedlineCitation><PMID Version="1">7</PMID><Article><ArticleTitle>On <i>n</i>-back &amp; H<sub>2</sub>O</ArticleTitle>'
        '<Abstract><AbstractText Label="AIM">We gave H<sub>2</sub>O to <i>n</i>=50 patients; P&lt;0.05.</AbstractText><AbstractText Label="NONE"/>'
        "<AbstractText>x <b>y</b>\nz</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>"
        '<PubmedArticle><MedlineCitation><PMID Version="1">8</PMID><Article><Abstract><AbstractText>Only.</AbstractText></Abstract></Article>'
        "</MedlineCitation></PubmedArticle></Set>"
    )
    got = {r["pmid"]: r["abstract"] for r in standoff.read_articles(spark, str(path)).collect()}
    assert got[7] == "TITLE: On n-back & H2O\nAIM: We gave H2O to n=50 patients; P<0.05.\nNONE: \nx y\nz\n"
    assert got[8] == "TITLE: \nOnly.\n"


def test_empty_annotation_file_is_known_from_the_documents(spark, tmp_path):
    (tmp_path / "1-100.ann").write_text("T1\tTotal_sample_size 3 5\tfifty\n")
    (tmp_path / "2-200.ann").write_text("")
    documents = spark.createDataFrame([(100,), (200,)], "pmid long")
    tables = annotation_tables(spark, str(tmp_path), documents)
    assert {r["pmid"]: r["tt_sample_size"] for r in tables["gold"].collect()} == {"100": 50, "200": None}


def test_empty_annotation_file_is_a_document(spark, tmp_path):
    (tmp_path / "1-100.ann").write_text("T1\tTotal_sample_size 3 5\tfifty\n")
    (tmp_path / "2-78.ann").write_text("")
    for folder in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}"):
        tables = annotation_tables(spark, folder)
        assert {r["pmid"]: r["tt_sample_size"] for r in tables["gold"].collect()} == {"100": 50, "78": None}
    (tmp_path / "none").mkdir()
    assert annotation_tables(spark, str(tmp_path / "none"))["gold"].count() == 0


def test_small_files_are_dealt_out_by_size_and_listed_once(spark, tmp_path, monkeypatch):
    sizes = [0, 10, 9000, 0, 200, 30_000, 5, 0]
    for i, size in enumerate(sizes):
        (tmp_path / f"{i}-{i}.ann").write_bytes(b"\xc3\xa9" * (size // 2))
    (tmp_path / "x.ann.bak").write_text("second name part counts")
    (tmp_path / "y.bak").write_text("not wanted")
    monkeypatch.setattr(small_files, "PARTITION_BYTES", 16_000)
    reader = small_files.SmallFilesReader({"path": str(tmp_path), "extensions": "ann"})
    parts = reader.partitions()
    assert [len(p.paths) for p in parts] == [2, 1, 2, 1, 3]
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert {r["name"]: len(r["text"]) for r in rows} == {f"{i}-{i}.ann": s // 2 for i, s in enumerate(sizes)} | {"x.ann.bak": 23}
    assert [len(p.paths) for p in small_files.SmallFilesReader({"path": str(tmp_path), "content": "false"}).partitions()] == [3, 3, 3, 1]
    got = small_files.read_small_files(spark, str(tmp_path), "ann")
    assert got.count() == 9 and got.where("name = '5-5.ann'").first()["text"] == "é" * 15_000


def test_what_the_engine_writes_it_reads(spark, tmp_path):
    docs = spark.createDataFrame([(1, f"{10**24 + 7} patients"), (2, "none"), (3, "We saw 12.")], d.DOCUMENTS)
    found = best_in_row(build_candidates(docs, features=False), lambda c: F.lit(0.9))
    d.write_parquet(found, str(tmp_path / "pred"))
    d.write_csv(found, str(tmp_path / "pred_csv"))
    want = {1: 10**24 + 7, 2: None, 3: 12}
    for got in (d.read_parquet(spark, str(tmp_path / "pred"), d.PREDICTIONS), d.read_csv(spark, str(tmp_path / "pred_csv"), d.PREDICTIONS)):
        assert {r["pmid"]: r["pred_ss"] for r in got.collect()} == want
    folder = tmp_path / "ann"
    folder.mkdir()
    (folder / "1-7.ann").write_text(f"T1\tTotal_sample_size 3 5\t{10**24 + 7}\nT2\tPoss_total_sample 9 11\t40\n")
    tables = annotation_tables(spark, str(folder))
    for name in ("loose", "gold"):
        d.write_parquet(tables[name], str(tmp_path / name))
    loose = d.read_parquet(spark, str(tmp_path / "loose"), d.LOOSE).first()
    assert tuple(loose) == (7, 10**24 + 7, [40])
    assert d.read_parquet(spark, str(tmp_path / "gold"), "pmid bigint, tt_sample_size decimal(38,0)").first()[1] == 10**24 + 7
    wide = spark.createDataFrame([(5, 9)], "pmid bigint, tt_sample_size bigint").withColumn("fold_id", F.lit(1))
    d.write_parquet(wide, str(tmp_path / "narrow"))
    assert d.read_parquet(spark, str(tmp_path / "narrow"), d.GOLD).first()["tt_sample_size"] == 9
