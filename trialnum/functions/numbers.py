"""Number words and digit groups in running text.

All functions are Column -> Column, row-local and free of Python UDFs, so they
add no shuffle and run inside the scan stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words and their values; hundred and above scale what stands before.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5,
    "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15,
    "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20,
    "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70,
    "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000,
    "million": 1000000, "billion": 1000000000, "trillion": 1000000000000,
}
SCALE_EXPONENTS = {"hundred": 2, "thousand": 3, "million": 6, "billion": 9, "trillion": 12}

# Whitespace as Unicode defines it plus the four ASCII separators 1C-1F.
_SPACE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Fixed value: three digits after a space or comma belong to the one to three digits before.
THOUSANDS_PATTERN = r"([^\p{Nd}][0-9]{1,3})[" + _SPACE + r",]([0-9]{3}[^\p{Nd}])"

# Characters of a word token: ASCII letters and digits, and the four letters
# whose case folding meets them (dotted I, dotless i, long s, Kelvin sign).
_WORD_CHARS = r"A-Za-z0-9\x{130}\x{131}\x{17F}\x{212A}"
TOKEN_PATTERN = r"[.,;']|[" + _WORD_CHARS + r"]+"

_START = f"(?<![{_WORD_CHARS}])"
_END = f"(?![{_WORD_CHARS}])"
# The first letter is tested before anything else: most positions end there.
NUMBER_WORD_PATTERN = (
    f"(?=[befhmnostBEFHMNOST]){_START}"
    f"(?i:{'|'.join(sorted(NUMBER_WORDS, key=len, reverse=True))}){_END}"
)
# What may stand between two words of one group: anything that is no token,
# the comma, and the lower-case word "and". Possessive, so no backtracking and
# no recursion on long texts.
_BETWEEN = rf"(?:[^{_WORD_CHARS}.;']++|{_START}and{_END})++"
NUMBER_GROUP_PATTERN = f"{NUMBER_WORD_PATTERN}(?:{_BETWEEN}{NUMBER_WORD_PATTERN})*+"


def join_thousands(text: Column) -> Column:
    """``1,234`` and ``1 234`` become ``1234``, one pass, non-digits needed on both sides."""
    return F.regexp_replace(text, THOUSANDS_PATTERN, "$1$2")


def number_tokens(text: Column) -> Column:
    """Word and punctuation tokens used for number tagging, without ``and`` and ``,``."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))
    return F.filter(tokens, lambda t: ~t.isin("and", ","))


def number_word_value(word: Column) -> Column:
    """Value of one number word in any case, NULL for other words."""
    pairs = [F.lit(x) for w, v in NUMBER_WORDS.items() for x in (w, v)]
    return F.try_element_at(F.create_map(*pairs).cast("map<string,bigint>"), F.lower(word))


def number_groups(text: Column) -> Column:
    """Maximal runs of consecutive number words, as they stand in the text."""
    return F.regexp_extract_all(text, F.lit(NUMBER_GROUP_PATTERN), F.lit(0))


LIMB = 12  # decimal digits that are added up together


def group_value(group: Column) -> Column:
    """Decimal digits (as text) of one run of number words, exact at every length.

    Read from right to left, every plain word counts times the scale words open at
    that point; a larger scale word closes smaller ones. So the run is parted at its largest scale word, the parts at the
    next one, and so on: a word counts times 10 to the scale words of each kind to its right in its part. These (exponent,
    value) terms are sorted, added up by twelve digits, and carried once.
    """
    words = F.array_join(F.regexp_extract_all(F.lower(group), F.lit(NUMBER_WORD_PATTERN), F.lit(0)), " ")
    scales = sorted(SCALE_EXPONENTS.items(), key=lambda x: -x[1])
    return _digits(F.array_sort(_terms(words, scales, F.lit(0))))


def _terms(words: Column, scales: list[tuple[str, int]], exponent: Column) -> Column:
    """(exponent, value) of all plain words of a text in which no other scale words than ``scales`` are left."""
    if not scales:
        plain = F.filter(F.split(words, " "), lambda w: w != "")
        return F.transform(plain, lambda w: F.struct(exponent.alias("e"), number_word_value(w).alias("v")))
    (scale, power), smaller = scales[0], scales[1:]

    def of_parts(parts: Column) -> Column:
        # as many scale words stand to the right of a part as parts do
        return F.flatten(
            F.transform(parts, lambda p, k: _terms(p, smaller, exponent + F.lit(power) * (F.size(parts) - 1 - k)))
        )

    # one-element array, so that the parts are made once
    return F.get(F.transform(F.array(F.split(words, scale)), of_parts), F.lit(0))


def _digits(terms: Column) -> Column:
    """The sum of sorted (exponent, value) terms as decimal digits.

    A limb's sum stays below 90 * 10^11 times the number of words, which BIGINT holds for a million words.
    """
    base = F.lit(10**LIMB).cast("bigint")
    powers = F.array(*[F.lit(10**e) for e in range(LIMB)]).cast("array<bigint>")
    limb_text = lambda x: F.lpad(x.cast("string"), LIMB, "0")
    over = lambda x, y: F.call_function("div", x, y)
    start = F.struct(F.lit(0).cast("bigint").alias("limb"), F.lit(0).cast("bigint").alias("sum"), F.lit("").alias("digits"))

    def step(acc: Column, term: Column) -> Column:
        place = over(term["e"], F.lit(LIMB)).cast("bigint")
        added = term["v"] * F.get(powers, term["e"] % LIMB)
        gap, carry = place - acc["limb"], over(acc["sum"], base)
        lowest = F.concat(limb_text(acc["sum"] % base), acc["digits"])
        between = F.concat(F.repeat(F.lit("0"), (LIMB * (gap - 2)).cast("int")), limb_text(carry), lowest)
        return (
            F.when(gap == 0, F.struct(place.alias("limb"), (acc["sum"] + added).alias("sum"), acc["digits"].alias("digits")))
            .when(gap == 1, F.struct(place.alias("limb"), (carry + added).alias("sum"), lowest.alias("digits")))
            .otherwise(F.struct(place.alias("limb"), added.alias("sum"), between.alias("digits")))
        )

    def shown(acc: Column) -> Column:
        return F.regexp_replace(F.concat(acc["sum"].cast("string"), acc["digits"]), "^0+(?=[0-9])", "")

    return F.aggregate(terms, start, step, shown)


def replace_number_words(text: Column) -> Column:
    """Every run of number words becomes its digits; the rest of the text is kept."""
    values = F.transform(number_groups(text), group_value)
    gaps = F.split(text, NUMBER_GROUP_PATTERN, -1)
    # one gap more than groups; zipped, so that both arrays are made once
    pieces = F.zip_with(gaps, values, lambda gap, value: F.concat(gap, F.coalesce(value, F.lit(""))))
    merged = F.array_join(pieces, "")
    return F.when(text.rlike(NUMBER_WORD_PATTERN), merged).otherwise(text)


def normalize_numbers(text: Column) -> Column:
    """Thousands groups joined, then number words as digits."""
    return replace_number_words(join_thousands(text))


# Spaces that annotated numbers may hold (thin, punctuation, no-break, narrow no-break).
EXOTIC_SPACES = "\u2009\u2008\u00a0\u202f"


def whole_number(text: Column) -> Column:
    """Value of a text that is one whole number, blanks around it allowed, else NULL."""
    return F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), text.try_cast("decimal(38,0)"))


def annotated_number(word: Column) -> Column:
    """Annotated text as a number, NULL if it is none.

    Text that starts with a letter keeps its words apart; digits lose spaces and commas.
    """
    spaced = F.translate(word, EXOTIC_SPACES, " " * len(EXOTIC_SPACES))
    packed = F.translate(word, " ," + EXOTIC_SPACES, "")
    cleaned = F.when(word.rlike(r"^\p{L}"), spaced).otherwise(packed)
    # most are plain digits already, which rewriting would leave as they are
    return F.coalesce(whole_number(cleaned), whole_number(normalize_numbers(cleaned)))


def normalized_number(word: Column) -> Column:
    """Text with numbers as digits, and its integer value where it is one."""
    norm = normalize_numbers(word)
    return F.struct(norm.alias("norm"), whole_number(norm).alias("num"))


def capitalize(text: Column) -> Column:
    """First character upper, all others lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))
