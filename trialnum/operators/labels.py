"""Training labels for candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialnum.functions.tokens import NUMBER, tag_token, token_number
from trialnum.operators.candidates import ColumnFunction, build_candidates, explode_candidates

POSITIVE, NEGATIVE = "N", "O"


def token_labels(tokens: Column, gold: Column) -> Column:
    """``N`` for every token that is the gold number, ``O`` for all others."""
    number = gold.cast(NUMBER)
    return F.transform(
        tokens,
        lambda t: F.when(token_number(t) == number, POSITIVE).otherwise(NEGATIVE),
    )


def label_value(label: Column) -> Column:
    return F.when(label == POSITIVE, 1.0).otherwise(0.0)


def candidate_label(num: Column, gold: Column) -> Column:
    """1.0 where the candidate is the gold number; a missing gold number labels nothing."""
    return F.coalesce((num == gold.cast(NUMBER)).cast("double"), F.lit(0.0))


def labelled_candidates(
    df: DataFrame,
    gold: str = "tt_sample_size",
    normalize: bool = False,
    tokenizer: ColumnFunction | None = None,
    tagger: ColumnFunction | None = tag_token,
    array_tagger: ColumnFunction | None = None,
    features: bool = True,
    lexicon: DataFrame | None = None,
) -> DataFrame:
    """One row per candidate with features (or position and number only) and ``label``.

    ``normalize=False`` trains on number words as written.
    """
    docs = build_candidates(
        df, normalize=normalize, tokenizer=tokenizer, tagger=tagger, array_tagger=array_tagger, features=features,
        lexicon=lexicon,
    )
    rows = explode_candidates(docs)
    return rows.withColumn("label", candidate_label(F.col("num"), F.col(gold)))
