"""Document tokens, ``n=`` rewriting, vocabulary words and part-of-speech tags."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# n=50 and n=1,234 | COVID-19 | 0.036 and 1,000 | words | any other visible character.
# Possessive throughout: every token is found in one forward pass.
DOCUMENT_TOKEN_PATTERN = r"[nN]=[0-9]++(?:[.,][0-9]++)*+|\p{L}++(?:-[0-9]++)*+|[0-9]++(?:[.,][0-9]++)*+|\S"

NUMBER = "decimal(38,0)"

# Characters that part vocabulary words.
VOCABULARY_SEPARATORS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n"

# The tag set, in index order.
TAGS = [
    '""', "#", "$", "''", ",", "-LRB-", "-RRB-", ".", ":", "ADD", "AFX", "BES", "CC", "CD",
    "DT", "EX", "FW", "GW", "HVS", "HYPH", "IN", "JJ", "JJR", "JJS", "LS", "MD", "NFP", "NIL",
    "NN", "NNP", "NNPS", "NNS", "PDT", "POS", "PRP", "PRP$", "RB", "RBR", "RBS", "RP", "SP",
    "SYM", "TO", "UH", "VB", "VBD", "VBG", "VBN", "VBP", "VBZ", "WDT", "WP", "WP$", "WRB",
    "XX", "``",
]
UNKNOWN_TAG = "XX"

# Punctuation and its tag.
PUNCTUATION_TAGS = {
    ".": ".", "?": ".", "!": ".", ",": ",", ":": ":", ";": ":", "(": "-LRB-", ")": "-RRB-",
    "[": "-LRB-", "]": "-RRB-", "-": "HYPH", "$": "$", "#": "#", "%": "NN", "'": "''",
    '"': "''", "`": "``", "=": "SYM", "<": "SYM", ">": "SYM", "+": "SYM", "/": "SYM",
}

# Default lexicon: frequent function words and the nouns and verbs that the
# keyword features look for. A caller's own lexicon table replaces it.
DEFAULT_LEXICON = {
    "DT": ["a", "an", "the", "this", "these", "all", "each", "no"],
    "IN": ["of", "in", "for", "with", "by", "from", "at", "on", "between", "among", "after", "during"],
    "CC": ["and", "or", "but"],
    "TO": ["to"],
    "PRP": ["we", "it", "they"],
    "MD": ["may", "can", "will", "should"],
    "VBD": ["was", "were", "had"],
    "VBZ": ["is", "has"],
    "VBP": ["are", "have"],
    "VBN": ["enrolled", "recruited", "randomized", "screened", "completed", "aged", "analyzed"],
    "NN": ["trial", "study", "group", "care", "dose", "total", "analysis", "placebo", "mg"],
    "NNS": ["patients", "subjects", "participants", "adults", "years", "individuals", "people"],
}


def document_tokens(text: Column) -> Column:
    """All tokens of a document, in order."""
    return F.regexp_extract_all(text, F.lit(DOCUMENT_TOKEN_PATTERN), F.lit(0))


def is_integer(token: Column) -> Column:
    """The token is written as a whole number."""
    return token.rlike("^[+-]?[0-9]+$")


def token_number(token: Column) -> Column:
    """Integer value of a token, NULL if it is not a whole number.

    Tested before it is cast: a failing cast builds an exception, a thousand times
    the price of the test. DECIMAL(38, 0) is the widest exact type; a longer number has no
    value of this type, though it stays a candidate and takes part in all features.
    """
    return F.when(is_integer(token), token.try_cast(NUMBER))


def rewrite_n_equals(tokens: Column) -> Column:
    """Tokens holding ``n=`` shrink to what follows the first ``=``, without ``)``."""

    def rewrite(token: Column) -> Column:
        value = F.replace(F.get(F.split(token, "="), F.lit(1)), F.lit(")"), F.lit(""))
        return F.when(F.lower(token).contains("n="), value).otherwise(token)

    return F.transform(tokens, rewrite)


def vocabulary_words(text: Column) -> Column:
    """Lower-cased words parted by punctuation and blanks; apostrophes stay."""
    blanks = " " * len(VOCABULARY_SEPARATORS)
    spaced = F.translate(F.lower(text), VOCABULARY_SEPARATORS, blanks)
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def tag_token(token: Column, lexicon: Mapping[str, list[str]] | None = None) -> Column:
    """Tag of a token: punctuation, lexicon word, number, else unknown.

    ``lexicon`` maps a tag to its lower-case words, which are one hashed set per tag: no
    join and no shuffle.
    """
    lexicon = DEFAULT_LEXICON if lexicon is None else lexicon
    tag_of = {word: tag for tag, words in reversed(lexicon.items()) for word in words}
    tag_of.update(PUNCTUATION_TAGS)
    sets: dict[str, list[str]] = {}
    for word, tag in tag_of.items():
        sets.setdefault(tag, []).append(word)

    def choose(lowered: Column) -> Column:
        chosen = F.lit(None).cast("string")
        for tag, words in sets.items():
            chosen = F.when(lowered.isin(words), F.lit(tag)).otherwise(chosen)
        return chosen

    # one-element array, so that the lower-casing is done once
    known = F.get(F.transform(F.array(F.lower(token)), choose), F.lit(0))
    number = F.when(token.rlike("^[0-9]+([.,][0-9]+)*$"), "CD")
    return F.coalesce(known, number, F.lit(UNKNOWN_TAG))


def tag_tokens(tokens: Column, lexicon: Mapping[str, list[str]] | None = None) -> Column:
    """Tags of a token array, position by position."""
    return F.transform(tokens, lambda t: tag_token(t, lexicon))
