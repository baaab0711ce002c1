"""Candidate numbers of each document with their features.

A document stays one row throughout, its candidates an array: building features
needs no shuffle and cannot skew, and the text itself is dropped before anything
is exchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialnum.functions import features as feat
from trialnum.functions import number_sets as sets
from trialnum.functions.numbers import join_thousands, replace_number_words
from trialnum.functions.tokens import (
    NUMBER,
    UNKNOWN_TAG,
    document_tokens,
    is_integer,
    rewrite_n_equals,
    tag_token,
)
from trialnum.operators.lexicon import lexicon_codes, tag_from_code
from trialnum.operators.lookup import looked_up

ColumnFunction = Callable[[Column], Column]


def with_tokens(
    df: DataFrame,
    text: str = "abstract",
    normalize: bool = True,
    tokenizer: ColumnFunction | None = None,
    digits_only: bool = False,
) -> DataFrame:
    """Adds ``raw_tokens`` and, with ``n=`` rewritten, ``tokens``.

    ``digits_only`` leaves both empty for texts without any digit, which hold no
    candidate; used where only candidates are wanted, with the own tokenizer.
    """
    if normalize:
        df = df.withColumn("_joined", join_thousands(F.col(text)))
        df = df.withColumn("_text", replace_number_words(F.col("_joined"))).drop("_joined")
    else:
        df = df.withColumn("_text", F.col(text))
    if tokenizer is not None:
        # fenced on both sides: a Python UDF can neither take the text's array expressions
        # as its argument nor be moved into those that follow
        df = fenced(df, "_text")
        df = fenced(df.withColumn("raw_tokens", tokenizer(F.col("_text"))), "raw_tokens")
        return df.withColumn("tokens", rewrite_n_equals(F.col("raw_tokens"))).drop("_text")
    raw = document_tokens(F.col("_text"))
    if digits_only:
        raw = F.when(F.col("_text").rlike("[0-9]"), raw).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("raw_tokens", raw)
    rewritten = F.when(
        F.lower("_text").contains("n="), rewrite_n_equals(F.col("raw_tokens"))
    ).otherwise(F.col("raw_tokens"))
    return df.withColumn("tokens", rewritten).drop("_text")


def number_positions(tokens: Column) -> Column:
    """Positions of the tokens written as whole numbers, in order."""
    at = F.transform(tokens, lambda t, i: F.when(is_integer(t), i))
    return F.filter(at, lambda i: i.isNotNull())


def numbers_at(tokens: Column, positions: Column) -> Column:
    """Position, value and digits as written at the given positions."""
    return F.transform(
        positions,
        lambda i: F.struct(
            i.alias("idx"), F.get(tokens, i).try_cast(NUMBER).alias("num"), F.get(tokens, i).alias("written")
        ),
    )


def with_numbers(df: DataFrame) -> DataFrame:
    """``tokens`` give ``candidates`` of position and value only, for whoever needs no features."""
    tokens = F.col("tokens")
    hits = numbers_at(tokens, number_positions(tokens))
    pairs = F.transform(hits, lambda c: F.struct(c["idx"].alias("idx"), c["num"].alias("num")))
    return fenced(df.withColumn("candidates", pairs), "candidates")


def with_neighbours(df: DataFrame) -> DataFrame:
    """``tokens`` give ``candidates`` of position, value and the four words around, for whoever needs no other features."""
    tokens = F.col("tokens")
    df = df.withColumn("_hits", numbers_at(tokens, number_positions(tokens))).withColumn("_n", F.size(tokens))
    df = df.withColumn("_lowered", F.when(F.size("_hits") > 0, F.transform(tokens, F.lower)))

    def around(c: Column) -> Column:
        words = (feat.left_words(F.col("_lowered"), c["idx"]), feat.right_words(F.col("_lowered"), c["idx"], F.col("_n")))
        return F.struct(c["idx"].alias("idx"), c["num"].alias("num"), words[0].alias("left_word"), words[1].alias("right_word"))

    candidates = F.transform("_hits", around)
    return fenced(df.withColumn("candidates", candidates).drop("_hits", "_n", "_lowered"), "candidates")


def with_number_flags(df: DataFrame) -> DataFrame:
    """Adds ``_flags`` along ``_written``: ``number_sets.FLAGS`` of each number, one after the other."""
    # fenced on both sides, as the tokenizer is
    return fenced(fenced(df, "_written").withColumn("_flags", sets.number_flags()(F.col("_written"))), "_flags")


def with_spread_number_flags(df: DataFrame, long_numbers: int, part_numbers: int = 2000) -> DataFrame:
    """As ``with_number_flags``; sums of documents with more than ``long_numbers`` numbers are found over many tasks.

    Which numbers are sums of two takes the square of their number in the worst case, so every
    ``part_numbers`` of such a document are looked for in a task of their own, against all of its numbers. Documents
    with the same numbers share the work. All others stay in their row, without a shuffle. The input is
    read once for them, and twice for the long ones.
    """
    df = fenced(df, "_written")
    size = F.coalesce(F.size("_written"), F.lit(0))
    short, long = df.where(size <= long_numbers), df.where(size > long_numbers)
    long = long.withColumn("_key", F.sha2(F.array_join("_written", " "), 256))
    lists = long.select("_key", "_written").dropDuplicates(["_key"])
    parts = F.ceil(F.size("_written") / part_numbers).cast("int")
    work = lists.select("_key", "_written", parts.alias("_parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    work = work.repartition("_key", "_part")
    work = work.select("_key", sets.found_sums()("_written", "_part", "_parts").alias("_found"))
    found = work.groupBy("_key").agg(F.flatten(F.collect_list("_found")).alias("_places"), F.count("_found").alias("_counted"))
    places = F.when(F.col("_counted") > 0, F.col("_places"))
    long = long.join(found.select("_key", places.alias("_places")), "_key", "left").drop("_key")
    long = long.withColumn("_flags", sets.number_flags_with_sums()("_written", "_places")).drop("_places")
    return fenced(short.withColumn("_flags", sets.number_flags()(F.col("_written"))).unionByName(long), "_flags")


def with_features(
    df: DataFrame,
    tagger: ColumnFunction | None = tag_token,
    tags: str | None = None,
    long_numbers: int | None = None,
    lexicon: DataFrame | None = None,
) -> DataFrame:
    """``raw_tokens`` and ``tokens`` give ``candidates``, one struct per integer token.

    Each step is a column of its own that later steps use more than once, so the
    optimizer keeps it and evaluates it once per document.

    Tags come from ``tags`` (an array column along the tokens) or from ``tagger``,
    which is evaluated for the two neighbours of a candidate only, or from a ``lexicon`` table, where the
    neighbours of all candidates of a document are looked up together. ``long_numbers`` see
    ``with_spread_number_flags``.
    """

    def tag_at(i: Column, place: Column) -> Column:
        if lexicon is not None:
            return tag_from_code(F.get(F.col("raw_tokens"), i), F.get(F.col("_codes"), place))
        if tags is not None:
            return F.get(F.col(tags), i)
        if tagger is None:
            return F.lit(UNKNOWN_TAG)
        return tagger(F.get(F.col("raw_tokens"), i))

    tokens = F.col("tokens")
    df = df.withColumn("_hits", numbers_at(tokens, number_positions(tokens)))
    df = df.withColumn("_written", F.transform("_hits", lambda c: c["written"]))
    if lexicon is not None:
        raw = F.col("raw_tokens")
        beside = F.transform("_hits", lambda c: F.array(F.lower(F.get(raw, c["idx"] - 1)), F.lower(F.get(raw, c["idx"] + 1))))
        df = fenced(df.withColumn("_beside", F.flatten(beside)), "_beside")
        df = fenced(looked_up(df, "_beside", lexicon_codes(lexicon), "code", [0], "_codes"), "_codes").drop("_beside")
    df = with_number_flags(df) if long_numbers is None else with_spread_number_flags(df, long_numbers)
    df = df.withColumn("_n", F.size(tokens))
    df = df.withColumn("_lowered", F.when(F.size("_hits") > 0, F.transform(tokens, F.lower)))
    n, lowered = F.col("_n"), F.col("_lowered")

    def windows(c: Column) -> Column:
        return F.struct(
            c["idx"].alias("idx"),
            c["num"].alias("num"),
            feat.words_around(lowered, c["idx"], n).alias("around"),
            feat.words_ahead(lowered, c["idx"], n).alias("ahead"),
        )

    def features(c: Column, k: Column) -> Column:
        i, num = c["idx"], c["num"]
        flags = {name: F.get("_flags", k * len(sets.FLAGS) + j) for j, name in enumerate(sets.FLAGS)}
        return F.struct(
            i.alias("idx"),
            num.alias("num"),
            feat.left_words(lowered, i).alias("left_word"),
            feat.right_words(lowered, i, n).alias("right_word"),
            F.when(i == 0, UNKNOWN_TAG).otherwise(tag_at(i - 1, 2 * k)).alias("left_pos"),
            F.when(i == n - 1, UNKNOWN_TAG).otherwise(tag_at(i + 1, 2 * k + 1)).alias("right_pos"),
            feat.other_features(num, c["around"], c["ahead"], flags).alias("other"),
        )

    helpers = ["_hits", "_written", "_flags", "_n", "_lowered", "_codes"]
    # windows first, as each is searched for several keyword lists
    candidates = F.transform(F.transform("_hits", windows), features)
    return fenced(df.withColumn("candidates", candidates).drop(*helpers), "candidates")


def fenced(df: DataFrame, column: str) -> DataFrame:
    """The same table; filters on values made from ``column`` stay above its computation.

    Predicate pushdown would otherwise copy the whole feature expression into the
    filter once per reference, level by level, until planning itself is too large.
    A generator of one row is where such filters stop; filters on other columns
    still reach the scan.
    """
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.explode_outer(F.array(column)).alias(column))


def build_candidates(
    df: DataFrame,
    text: str = "abstract",
    normalize: bool = True,
    tokenizer: ColumnFunction | None = None,
    tagger: ColumnFunction | None = tag_token,
    array_tagger: ColumnFunction | None = None,
    keep_text: bool = False,
    features: bool = True,
    long_numbers: int | None = None,
    neighbours: bool = False,
    lexicon: DataFrame | None = None,
) -> DataFrame:
    """One row per document with its ``candidates`` array (empty if it has no integer).

    ``normalize=False`` leaves number words as they stand, as for training rows. A
    ``tagger`` made of built-in functions tags single tokens; an ``array_tagger``
    tags all tokens of a document at once and may, like ``tokenizer``, be a UDF; a ``lexicon (token, tag)`` of
    any size takes the place of both.
    ``features=False`` makes ``idx`` and ``num`` only: the optimizer cannot leave out fields of
    an array's structs, so whoever needs no features asks for none; with ``neighbours`` the
    words around are there all the same. ``long_numbers`` is for
    corpora with documents of very many numbers, see ``with_spread_number_flags``.
    """
    df = with_tokens(df, text, normalize, tokenizer, digits_only=array_tagger is None or not features)
    if not features:
        df = (with_neighbours(df) if neighbours else with_numbers(df)).drop("raw_tokens", "tokens")
        return df if keep_text else df.drop(text)
    if array_tagger is not None:
        df = fenced(df, "raw_tokens")
        df = fenced(df.withColumn("_tags", array_tagger(F.col("raw_tokens"))), "_tags")
    df = with_features(df, tagger, "_tags" if array_tagger is not None else None, long_numbers, lexicon)
    df = df.drop("raw_tokens", "tokens", "_tags")
    return df if keep_text else df.drop(text)


def explode_candidates(df: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per candidate; ``keep_empty`` keeps documents without any, as one row of NULLs.

    Always the outer form: the plain one makes the optimizer add a size filter
    below the features, which would compute them twice.
    """
    others = [c for c in df.columns if c != "candidates"]
    rows = df.select(*others, F.explode_outer("candidates").alias("_c")).select(*others, "_c.*")
    return rows if keep_empty else rows.filter(F.col("idx").isNotNull())
