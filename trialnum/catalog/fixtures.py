"""Trial texts, predictions and annotations derived from the driver tables.

The driver's ``documents`` hold no number words, keywords or sample sizes, so
tables with them are derived from every row of ``orders``. The SQL is plain and
runs unchanged in Spark and DuckDB; ``{orders}`` stands for the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialnum.operators.tables import spread

TRIALS = """
SELECT o_orderkey AS pmid, 20 + o_custkey % 180 AS a, 10 + o_custkey % 90 AS b,
  10 + (o_custkey % 180) - (o_custkey % 90) AS c
FROM {orders}
"""

# number by word group, as it stands in the text and as it should be read
WORDS = """CASE pmid % 6 WHEN 0 THEN 'Twenty-five' WHEN 1 THEN 'one hundred and twenty three'
  WHEN 2 THEN 'two thousand three hundred' WHEN 3 THEN 'one, two' WHEN 4 THEN 'hundred'
  ELSE '1 250' END"""
DIGITS = """CASE pmid % 6 WHEN 0 THEN '25' WHEN 1 THEN '123' WHEN 2 THEN '2300'
  WHEN 3 THEN '3' WHEN 4 THEN '0' ELSE '1250' END"""

_ABSTRACTS = """
SELECT pmid,
 concat('TITLE: Trial of COVID-19 care. A total of ', CAST(a AS VARCHAR(20)),
  ' patients were enrolled between 2019 and 2021. ', {words},
  ' subjects completed the analysis (n=', CAST(b AS VARCHAR(20)), ') and ',
  CAST(c AS VARCHAR(20)),
  ' adults aged 18 to 65 years were screened; P=0.036, dose 20 mg.', {tail}) AS abstract,
 CASE WHEN pmid % 7 = 0 THEN NULL ELSE a END AS tt_sample_size,
 pmid % 5 AS fold_id
FROM ({trials}) t
"""
# further numbers, among them one beyond BIGINT, parted ones after n=, and some at the very end
TAIL = """CASE pmid % 12 WHEN 1 THEN ' Register 1234567890123456789012345 (n=1,234), n=50.5, N=7,5'
  WHEN 2 THEN ' 8' WHEN 3 THEN ' 40 patients 40 years n=40' WHEN 4 THEN ' -3 +3 1234567890123456789012345'
  ELSE '' END"""
NORMAL_TAIL = TAIL.replace("1,234", "1234")
TRIAL_ABSTRACTS = _ABSTRACTS.replace("{words}", WORDS).replace("{tail}", TAIL).replace("{trials}", TRIALS)
NORMAL_ABSTRACTS = _ABSTRACTS.replace("{words}", DIGITS).replace("{tail}", NORMAL_TAIL).replace("{trials}", TRIALS)

# exact, within ten per cent, far off, another number, none, row missing, no gold
PREDICTIONS = """
SELECT CASE WHEN pmid % 10 = 9 THEN -pmid ELSE pmid END AS pmid,
 CASE WHEN pmid % 10 < 4 THEN a WHEN pmid % 10 = 4 THEN a + CAST(floor(a / 20) AS BIGINT) WHEN pmid % 10 = 5 THEN a * 3
  WHEN pmid % 10 = 6 THEN c WHEN pmid % 10 = 7 THEN NULL ELSE a END AS pred_ss,
 CAST((pmid * 13) % 100 AS DOUBLE) / 100 AS conf
FROM ({trials}) t WHERE pmid % 10 <> 8
""".replace("{trials}", TRIALS)

# loose-match numbers; the possible ones in two columns, NULL where there is none
LOOSE_NUMBERS = """
SELECT pmid, CASE WHEN pmid % 7 = 0 THEN NULL ELSE a END AS total,
 CASE WHEN pmid % 3 = 0 THEN b WHEN pmid % 3 = 1 THEN c END AS poss_1,
 CASE WHEN pmid % 3 = 0 THEN c END AS poss_2
FROM ({trials}) t WHERE pmid % 17 <> 0
""".replace("{trials}", TRIALS)

# one to five standoff lines per document, none for every eleventh
STANDOFF_LINES = """
SELECT pmid, 0 AS line_no, concat('T1', chr(9), 'Total_sample_size 43 46', chr(9),
  CASE pmid % 6 WHEN 0 THEN CAST(a AS VARCHAR(20)) WHEN 1 THEN 'one hundred and twenty three'
   WHEN 2 THEN '1,234' WHEN 3 THEN '1 250' WHEN 4 THEN 'about fifty' ELSE 'hundred' END) AS line
FROM ({trials}) t WHERE pmid % 11 <> 0 AND pmid % 7 <> 0
UNION ALL
SELECT pmid, 1, concat('T2', chr(9), 'total_Sample_size 100 109', chr(9), 'Fifty-two')
FROM ({trials}) t WHERE pmid % 11 <> 0 AND pmid % 5 = 0
UNION ALL
SELECT pmid, 2, concat('T3', chr(9), 'POSS_total_sample 130 133', chr(9), CAST(b AS VARCHAR(20)))
FROM ({trials}) t WHERE pmid % 11 <> 0 AND pmid % 3 <> 1
UNION ALL
SELECT pmid, 3, concat('T4', chr(9), 'Poss_total_sample 150 153', chr(9), CAST(c AS VARCHAR(20)))
FROM ({trials}) t WHERE pmid % 11 <> 0 AND pmid % 3 = 0
UNION ALL
SELECT pmid, 4, concat('R1', chr(9), 'part_of Arg1:T3 Arg2:T', CAST(1 + pmid % 2 AS VARCHAR(20)))
FROM ({trials}) t WHERE pmid % 11 <> 0 AND pmid % 3 = 0
UNION ALL
SELECT pmid, 5, concat('A1', chr(9), 'Checked T1') FROM ({trials}) t WHERE pmid % 11 <> 0
""".replace("{trials}", TRIALS)

TITLES = """
SELECT pmid, CASE WHEN pmid % 19 <> 0 THEN concat('Trial ', CAST(pmid AS VARCHAR(20))) END AS title FROM ({trials}) t
""".replace("{trials}", TRIALS)

# up to three sections, some without label or text; none at all for every thirteenth document
SECTIONS = """
SELECT pmid, 2 AS pos, 'RESULTS' AS label, CASE WHEN pmid % 17 <> 1 THEN concat(CAST(a AS VARCHAR(20)), ' were enrolled.') END AS text
FROM ({trials}) t WHERE pmid % 13 <> 0
UNION ALL
SELECT pmid, 1, CASE WHEN pmid % 4 = 0 THEN NULL ELSE 'AIMS' END, 'To study care.'
FROM ({trials}) t WHERE pmid % 13 <> 0 AND pmid % 2 = 0
UNION ALL
SELECT pmid, 3, NULL, concat('We found ', CAST(c AS VARCHAR(20)), '.')
FROM ({trials}) t WHERE pmid % 13 <> 0 AND pmid % 3 = 0
""".replace("{trials}", TRIALS)


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return spark.sql(sql, orders=spread(orders, "o_orderkey"))


def trial_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TRIAL_ABSTRACTS)


def other_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial texts of another table, to train on beforehand."""
    people = spark.read.parquet(f"{sf_dir}/customer.parquet")
    keys = people.select(F.col("c_custkey").alias("o_orderkey"), (F.col("c_custkey") * 7).alias("o_custkey"))
    return spark.sql(TRIAL_ABSTRACTS, orders=spread(keys, "o_orderkey"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's documents as ``(pmid, abstract)``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spread(docs.select(F.col("doc_id").alias("pmid"), F.col("text").alias("abstract")), "pmid")


def loose_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = view(spark, sf_dir, LOOSE_NUMBERS)
    poss = F.filter(F.array("poss_1", "poss_2"), lambda p: p.isNotNull())
    return numbers.select("pmid", "total", poss.alias("poss"))
