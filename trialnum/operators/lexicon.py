"""Part-of-speech tags from a lexicon table of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialnum.functions.tokens import PUNCTUATION_TAGS, TAGS, UNKNOWN_TAG
from trialnum.operators.lookup import LOOKUP_BYTES, looked_up


def lexicon_codes(lexicon: DataFrame) -> DataFrame:
    """``(token, code)`` of a lexicon ``(token, tag)``: lower-case words and the place of their tag, 0 for tags that are none.

    Of several tags of a word the first in order is taken.
    """
    words = lexicon.groupBy(F.lower("token").alias("token")).agg(F.min("tag").alias("tag"))
    place = F.coalesce(F.array_position(F.array(*map(F.lit, TAGS)), F.col("tag")), F.lit(0))
    return words.select("token", place.cast("int").alias("code"))


def tag_from_code(token: Column, code: Column) -> Column:
    """Tag of a token: punctuation, the lexicon's, number, else unknown."""
    marks = F.create_map(*[F.lit(x) for pair in PUNCTUATION_TAGS.items() for x in pair])
    mark = F.when(F.length(token) == 1, F.try_element_at(marks, token))
    known = F.when(code > 0, F.element_at(F.array(*map(F.lit, TAGS)), F.greatest(code, F.lit(1))))
    number = F.when(token.rlike("^[0-9]+([.,][0-9]+)*$"), "CD")
    return F.coalesce(mark, known, number, F.lit(UNKNOWN_TAG))


def tagged(df: DataFrame, tokens: str, lexicon: DataFrame, out: str = "tags", limit: int = LOOKUP_BYTES) -> DataFrame:
    """Adds ``out``: tags along the array ``tokens``. The words of the texts meet the lexicon as in ``looked_up``."""
    rows = df.withColumn("_lower", F.transform(tokens, F.lower))
    rows = looked_up(rows, "_lower", lexicon_codes(lexicon), "code", [0], "_codes", limit)
    return rows.withColumn(out, F.zip_with(tokens, "_codes", tag_from_code)).drop("_lower", "_codes")
