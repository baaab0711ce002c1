"""Features of one integer token from its document's arrays.

``i`` is the 0-based token position, ``n`` the number of tokens. Every function
reads the per-document arrays in place: no explode, no window, no shuffle. What a number
is among its document's numbers is found for all of them at once, by ``number_sets``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword lists, compared with lower-cased tokens.
YEAR_WORDS = ["years", "year"]
PATIENT_WORDS = ["patients", "subjects", "participants"]
PEOPLE_WORDS = [
    "population", "size", "people", "individuals", "adults",
    "outpatients", "volunteers", "respondents", "providers",
]
ENROLL_WORDS = ["enroll", "enrolled", "recruit", "recruited", "randomized", "screen", "screened"]
ANALYSIS_WORDS = [
    "assessment", "assessments", "analysis", "analysed", "analyzed", "completed",
    "ITT", "intention-to-treat", "intention",
]

# Window sizes, year range, markers at the document edges.
AROUND = 5
AHEAD = 4
FIRST_YEAR, LAST_YEAR = 1940, 2022
BEFORE_FIRST, AFTER_LAST = "BoS", "LoS"

OTHER_FEATURES = [
    "biggest", "years_near", "looks_like_year", "patients_follow", "people_follow",
    "enroll_near", "analysis_near", "sum_of_two", "repeated", "rank_prop",
]


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def _words(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def window_bounds(i: Column, n: Column, size: int) -> tuple[Column, Column]:
    """First and last position of the window around ``i``, clipped to the document."""
    return F.greatest(F.lit(0), i - size), F.least(i + size, n - 1)


def words_around(lowered: Column, i: Column, n: Column) -> Column:
    """Tokens of the window around ``i``; its lower bound itself is left out."""
    low, high = window_bounds(i, n, AROUND)
    return F.slice(lowered, low + 2, high - low)


def words_ahead(lowered: Column, i: Column, n: Column) -> Column:
    """Tokens of the window after ``i``."""
    _, high = window_bounds(i, n, AHEAD)
    return F.slice(lowered, i + 2, high - i)


def has_keyword(window: Column, words: list[str]) -> Column:
    return _flag(F.arrays_overlap(window, _words(words)))


def left_words(lowered: Column, i: Column) -> Column:
    second = F.when(i <= 1, BEFORE_FIRST).otherwise(F.get(lowered, i - 2))
    first = F.when(i == 0, BEFORE_FIRST).otherwise(F.get(lowered, i - 1))
    return F.array(second, first)


def right_words(lowered: Column, i: Column, n: Column) -> Column:
    """Second word to the right is empty where there is none, the first gets the marker."""
    second = F.when(i >= n - 2, "").otherwise(F.get(lowered, i + 2))
    first = F.when(i == n - 1, AFTER_LAST).otherwise(F.get(lowered, i + 1))
    return F.array(second, first)


def looks_like_year(num: Column) -> Column:
    return _flag(num.between(FIRST_YEAR, LAST_YEAR))


def other_features(num: Column, around: Column, ahead: Column, flags: dict[str, Column]) -> Column:
    """The ten numeric features, in ``OTHER_FEATURES`` order; ``flags`` as named by ``number_sets.FLAGS``."""
    return F.array(
        flags["biggest"],
        has_keyword(around, YEAR_WORDS),
        looks_like_year(num),
        has_keyword(ahead, PATIENT_WORDS),
        has_keyword(ahead, PEOPLE_WORDS),
        has_keyword(around, ENROLL_WORDS),
        has_keyword(around, ANALYSIS_WORDS),
        flags["sum_of_two"],
        flags["repeated"],
        flags["rank_prop"],
    )
