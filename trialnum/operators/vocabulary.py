"""Vocabulary, unknown-word rewriting, word ids and word vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialnum.functions.tokens import vocabulary_words
from trialnum.operators.lookup import LOOKUP_BYTES, looked_up
from trialnum.operators.numbering import number_rows
from trialnum.operators.tables import written

MAX_FEATURES = 10_000
UNKNOWN_WORD, UNKNOWN_ID = "unkunk", 0


def word_counts(df: DataFrame, key: str = "pmid", text: str = "abstract", copies: bool = False) -> DataFrame:
    """Count and first place of every word; ``key`` is a whole number.

    Words are counted in the map tasks first, so a word that makes up a large part
    of the corpus reaches the shuffle as one row per task. Document and position are
    packed into one decimal: a struct could not be updated in place, and the whole
    corpus would be sorted to be aggregated. With ``copies`` equal texts are parted once: each counts as often as it
    occurs, and its first place is that in the first document.
    """
    doc, times = F.col(key).cast("decimal(20,0)"), F.lit(1).cast("bigint")
    if copies:
        df = df.groupBy(text).agg(F.min(doc).alias("_first"), F.count(F.lit(1)).alias("_copies"))
        doc, times = F.col("_first"), F.col("_copies")
    words = df.select(
        doc.alias("doc"), times.alias("times"),
        F.posexplode(vocabulary_words(F.col(text))).alias("pos", "token"),
    )
    place = F.col("doc") * F.lit(2**31).cast("decimal(10,0)") + F.col("pos")
    return words.groupBy("token").agg(
        F.coalesce(F.sum("times"), F.lit(0)).cast("bigint").alias("cnt"), F.min(place).alias("first_seen")
    )


def fit_vocabulary(
    df: DataFrame, key: str = "pmid", text: str = "abstract", max_features: int | None = MAX_FEATURES, copies: bool = False
) -> DataFrame:
    """The ``max_features`` most frequent words (None: all) as ``(token, id, cnt)``, ids from 1.

    Ties go to the word seen first. A histogram of the counts tells the least count that is needed; only words
    that have it are sorted, by ranges, and numbered. The histogram has at most as many rows as there are
    different counts, which is the root of twice the number of words in the corpus.
    """
    counts = word_counts(df, key, text, copies)
    if max_features is not None:
        counts = written(counts)  # one row per distinct word: read for the histogram and for the words
        histogram = counts.groupBy("cnt").agg(F.count(F.lit(1)).alias("words"))
        above = Window.orderBy(F.col("cnt").desc()).rowsBetween(Window.unboundedPreceding, -1)
        needed = histogram.withColumn("above", F.coalesce(F.sum("words").over(above), F.lit(0))).where(F.col("above") < max_features)
        least = needed.agg(F.min("cnt").alias("_least"))
        counts = counts.crossJoin(F.broadcast(least)).where(F.col("cnt") >= F.col("_least")).drop("_least")
    numbered = number_rows(counts, F.col("cnt").desc(), F.col("first_seen"), out="id")
    numbered = numbered.select("token", F.col("id").cast("int").alias("id"), "cnt")
    return numbered if max_features is None else numbered.where(F.col("id") <= max_features)


def unknown_rewritten(
    df: DataFrame, vocabulary: DataFrame, text: str = "abstract", out: str = "rewritten", limit: int = LOOKUP_BYTES
) -> DataFrame:
    """Texts as vocabulary words joined by blanks, unknown ones replaced; null text gives an empty one."""
    known = vocabulary.select("token", F.lit(1).alias("is"))
    df = df.withColumn("_words", vocabulary_words(F.col(text)))
    df = looked_up(df, "_words", known, "is", [0], "_known", limit)
    # words are made again, as a text is smaller than its words where rows move
    kept = F.zip_with(vocabulary_words(F.col(text)), "_known", lambda w, k: F.when(k == 1, w).otherwise(UNKNOWN_WORD))
    return df.withColumn(out, F.coalesce(F.array_join(kept, " "), F.lit(""))).drop("_words", "_known")


def vocabulary_vectors(
    vocabulary: DataFrame, dim: int, vectors: DataFrame | None = None, seed: int = 0
) -> DataFrame:
    """``(token, id, vec)`` for every vocabulary word.

    Words missing from ``vectors (token, vec)`` get values in (-1, 1] from a hash of
    word and position, the same in every run. The large side is the vector table:
    it is cut down to the vocabulary before anything else; how they meet is left to the optimizer, which knows their sizes.
    """

    def hashed(j: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.col("token"), j, F.lit(seed)), 11)
        return (F.lit(1.0) - F.lit(2.0) * bits / F.lit(float(2**53))).cast("float")

    drawn = F.transform(F.sequence(F.lit(1), F.lit(dim)), hashed)
    if vectors is None:
        return vocabulary.select("token", "id", drawn.alias("vec"))
    wanted = (
        vectors.join(vocabulary.select("token"), "token", "left_semi")
        .groupBy("token")
        .agg(F.min("vec").alias("given"))
    )
    return vocabulary.join(wanted, "token", "left").select(
        "token", "id", F.coalesce("given", drawn).alias("vec")
    )


def neighbour_words() -> Column:
    """Both left and both right words of a candidate row; of a row without a candidate four that no table knows."""
    none = F.array(*[F.lit(None).cast("string")] * 4)
    return F.coalesce(F.concat("left_word", "right_word"), none)


def encode_words(candidates: DataFrame, vocabulary: DataFrame, limit: int = LOOKUP_BYTES) -> DataFrame:
    """Adds ``left_ids`` and ``right_ids`` to candidate rows; words outside the vocabulary get ``UNKNOWN_ID``."""
    rows = candidates.withColumn("_four", neighbour_words())
    rows = looked_up(rows, "_four", vocabulary.select("token", "id"), "id", [UNKNOWN_ID], "_ids", limit)
    left, right = F.slice("_ids", 1, 2), F.slice("_ids", 3, 2)
    return rows.withColumn("left_ids", left).withColumn("right_ids", right).drop("_four", "_ids")


def embed_words(candidates: DataFrame, vectors: DataFrame, dim: int, limit: int = LOOKUP_BYTES) -> DataFrame:
    """Adds ``left_vec`` and ``right_vec`` to candidate rows, the vectors of both words one after the other.

    Unknown words get zeros.
    """
    rows = candidates.withColumn("_four", neighbour_words())
    rows = looked_up(rows, "_four", vectors.select("token", "vec"), "vec", [0.0] * dim, "_vec", limit)
    left, right = F.slice("_vec", 1, 2 * dim), F.slice("_vec", 2 * dim + 1, 2 * dim)
    return rows.withColumn("left_vec", left).withColumn("right_vec", right).drop("_four", "_vec")


def encode_documents(documents: DataFrame, vocabulary: DataFrame, limit: int = LOOKUP_BYTES) -> DataFrame:
    """Documents whose ``candidates`` array has neighbours -> the same with ``left_ids`` and ``right_ids`` in each struct.

    All neighbours of a document are looked up together, before anything is exploded.
    """
    return _along(documents, vocabulary.select("token", "id"), "id", [UNKNOWN_ID], ("left_ids", "right_ids"), limit)


def embed_documents(documents: DataFrame, vectors: DataFrame, dim: int, limit: int = LOOKUP_BYTES) -> DataFrame:
    """As ``encode_documents``, with ``left_vec`` and ``right_vec``; unknown words get zeros."""
    return _along(documents, vectors.select("token", "vec"), "vec", [0.0] * dim, ("left_vec", "right_vec"), limit)


def _along(documents: DataFrame, table: DataFrame, value: str, default: list, names: tuple[str, str], limit: int) -> DataFrame:
    width = 2 * len(default)
    words = F.flatten(F.transform("candidates", lambda c: F.concat(c["left_word"], c["right_word"])))
    rows = looked_up(documents.withColumn("_all", words), "_all", table, value, default, "_values", limit)

    def side(k: Column, right: int) -> Column:
        return F.slice("_values", k * 2 * width + right * width + 1, width)

    with_values = F.transform(
        "candidates", lambda c, k: c.withField(names[0], side(k, 0)).withField(names[1], side(k, 1))
    )
    return rows.withColumn("candidates", with_values).drop("_all", "_values")
