"""What each whole number of a document is among the document's numbers, for all documents of a batch at once.

Numbers are two columns of 18 digits each, so sums are exact up to 36 digits; documents with longer numbers are
worked out with Python's integers. All numbers of a batch are sorted once by (document, value). Sums of few numbers are
made for all documents together, pairs at the same distance in the order of one sort at a time; documents
with many numbers look for the missing part of each total, in blocks, until it is found. The functions name nothing
else of this package, so workers need only this module, NumPy and Arrow.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

FLAGS = ["biggest", "sum_of_two", "repeated", "rank_prop"]  # in this order, for each number
DIGITS = 18
BASE = 10**DIGITS
PAIRWISE = 256  # distinct numbers of a document up to which all pairs of them are made
TOTALS, PARTS = 4096, 64  # totals and parts that are looked up together
PRIMES = [(1 << 61) - 1, (1 << 59) - 55, (1 << 58) - 27, (1 << 57) - 13]


class _Numbers:
    """Distinct (document, value) of a batch, sorted, with how often each occurs and where every number went."""

    def __init__(self, written: pa.Array, document: np.ndarray) -> None:
        self.high, self.low = _columns(written)
        order = np.lexsort((self.low, self.high, document))
        d, h, w = document[order], self.high[order], self.low[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (w[1:] != w[:-1])
        starts = np.flatnonzero(new)
        self.document, self.high, self.low = d[starts], h[starts], w[starts]
        self.times = np.diff(np.append(starts, len(d)))
        self.of = np.empty(len(d), np.int64)  # a number's place among the distinct ones
        self.of[order] = np.cumsum(new) - 1
        firsts = np.flatnonzero(np.r_[True, self.document[1:] != self.document[:-1]]) if len(starts) else starts
        size = np.diff(np.append(firsts, len(starts)))
        self.first, self.size = np.repeat(firsts, size), np.repeat(size, size)
        self.end = self.first + self.size
        before = starts[firsts] if len(starts) else starts
        total = np.diff(np.append(before, len(d)))
        self.rank = (starts - np.repeat(before, size)) / np.repeat(total, size)


def _columns(written: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """high * BASE + low of numbers of up to 36 digits, 0 <= low < BASE."""

    def whole(text: pa.Array) -> np.ndarray:
        return pc.cast(pc.if_else(pc.equal(text, ""), "0", text), pa.int64()).to_numpy(zero_copy_only=False)

    digits = pc.ascii_ltrim(pc.ascii_ltrim(written, "+-"), "0")
    longest = pc.max(pc.binary_length(digits)).as_py() or 0
    low = whole(pc.utf8_slice_codeunits(digits, -DIGITS) if longest > DIGITS else digits)
    high = whole(pc.utf8_slice_codeunits(digits, -2 * DIGITS, -DIGITS)) if longest > DIGITS else np.zeros(len(low), np.int64)
    below = pc.starts_with(written, "-").to_numpy(zero_copy_only=False)
    if below.any():
        borrow = below & (low > 0)
        high = np.where(below, -high - borrow, high)
        low = np.where(borrow, BASE - low, low)
    return high, low


def _added(high: np.ndarray, low: np.ndarray, more_high: np.ndarray, more_low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = low + more_low
    carry = low >= BASE
    return high + more_high + carry, low - carry * BASE


def _keys(document: np.ndarray, high: np.ndarray, low: np.ndarray, seed: int) -> np.ndarray:
    factors = np.random.default_rng(seed).integers(1 << 62, 1 << 63, 3).astype(np.uint64) | np.uint64(1)
    parts = (x.astype(np.int64).view(np.uint64) * f for x, f in zip((document, high, low), factors))
    return sum(parts, np.zeros(len(low), np.uint64))


def _pair_sums(n: _Numbers, few: np.ndarray) -> np.ndarray:
    """Which distinct numbers are a sum of two of their document, for documents of few numbers."""
    found = np.zeros(len(n.low), bool)
    seed = 0
    while True:  # keys that tell all distinct numbers apart; what is looked up by key is compared afterwards
        keys = _keys(n.document, n.high, n.low, seed)
        order = np.argsort(keys)
        ordered = keys[order]
        if not (ordered[1:] == ordered[:-1]).any():
            break
        seed += 1
    least, most = n.first, n.end - 1
    i, distance = np.flatnonzero(few & (n.times > 1)), 0
    while True:
        j = i + distance
        high, low = _added(n.high[i], n.low[i], n.high[j], n.low[j])
        top, bottom = most[i], least[i]
        inside = (high < n.high[top]) | ((high == n.high[top]) & (low <= n.low[top]))
        inside &= (high > n.high[bottom]) | ((high == n.high[bottom]) & (low >= n.low[bottom]))
        at, high, low = i[inside], high[inside], low[inside]
        place = np.minimum(np.searchsorted(ordered, _keys(n.document[at], high, low, seed)), len(order) - 1)
        hit = order[place]
        same = (n.document[hit] == n.document[at]) & (n.high[hit] == high) & (n.low[hit] == low)
        found[hit[same]] = True
        if distance == 0:
            i = np.flatnonzero(few)
        distance += 1
        i = i[i + distance < n.end[i]]
        if not len(i):
            return found


def _searched_sums(high: np.ndarray, low: np.ndarray, times: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Places among ``totals`` (places of distinct, sorted numbers of one document) that are a sum of two of the numbers."""
    values = [h * BASE + w for h, w in zip(high.tolist(), low.tolist())]
    for prime in PRIMES:
        rest = np.array([v % prime for v in values], np.int64)
        order = np.argsort(rest)
        ordered = rest[order]
        if not (ordered[1:] == ordered[:-1]).any():
            break
    else:
        known = set(values)
        twice = {v for v, t in zip(values, times) if t > 1}
        return np.array([k for k in totals if any(values[k] - a in known and (values[k] != 2 * a or a in twice) for a in values)], np.int64)
    ahead = len(values) and values[0] >= 0  # parts of a total are not larger than it
    found = []
    for begin in range(0, len(totals), TOTALS):
        open_totals = totals[begin : begin + TOTALS]
        for first in range(0, len(values), PARTS):
            if ahead:
                open_totals = open_totals[open_totals >= first]
            if not len(open_totals):
                break
            part = np.arange(first, min(first + PARTS, len(values)))
            missing = (rest[open_totals][:, None] - rest[part][None, :]) % prime
            place = np.minimum(np.searchsorted(ordered, missing), len(order) - 1)
            row, column = np.nonzero(ordered[place] == missing)
            a, b, t = part[column], order[place[row, column]], open_totals[row]
            h, w = _added(high[a], low[a], high[b], low[b])
            good = (h == high[t]) & (w == low[t]) & ((a != b) | (times[a] > 1))
            hit = np.zeros(len(open_totals), bool)
            hit[row[good]] = True
            found.append(open_totals[hit])
            open_totals = open_totals[~hit]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _plain_flags(texts: list[str]) -> np.ndarray:
    """The flags of one document, with integers of any length."""
    sys.set_int_max_str_digits(0)
    values = [int(t) for t in texts]
    ordered = sorted(values)
    rank = {v: k for k, v in reversed(list(enumerate(ordered)))}
    counts: dict[int, int] = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1

    def is_sum(total: int) -> bool:
        return any(total - a in counts and (total != 2 * a or counts[a] > 1) for a in counts)

    sums = {v: is_sum(v) for v in counts}
    return np.array([[v >= ordered[-1], sums[v], counts[v] > 1, rank[v] / len(values)] for v in values], float)


def flags_of(lists: pa.ListArray, given: list | None = None) -> pa.ListArray:
    """Four flags for each number of each list, one after the other, in the order of ``FLAGS``.

    ``given`` holds for some lists the places of the sums among their distinct numbers in order, as
    ``sum_places`` finds them.
    """
    written = lists.flatten()
    length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(length)])
    document = np.repeat(np.arange(len(lists)), length)
    flags = np.zeros((len(written), len(FLAGS)))
    # a sign and leading zeros count too, so a few short numbers go the plain way as well
    far = document[np.flatnonzero(pc.greater(pc.binary_length(written), 2 * DIGITS).to_numpy(zero_copy_only=False))]
    plain = np.unique(far)
    for k in plain:
        flags[at[k] : at[k + 1]] = _plain_flags(written.slice(at[k], length[k]).to_pylist())
    ordinary = ~np.isin(document, plain)
    rows = np.flatnonzero(ordinary)
    if len(rows):
        n = _Numbers(written if len(rows) == len(written) else written.take(pa.array(rows)), document[rows])
        sums = np.zeros(len(n.low), bool)
        told = np.isin(n.document, [k for k, places in enumerate(given) if places is not None]) if given else np.zeros(len(n.low), bool)
        few = (n.size <= PAIRWISE) & ~told
        if few.any():
            sums |= _pair_sums(n, few)
        for first in np.unique(n.first[~few]):
            of = slice(first, n.end[first])
            known = given[n.document[first]] if given else None
            if known is None:
                known = _searched_sums(n.high[of], n.low[of], n.times[of], np.arange(n.size[first]))
            sums[first + np.asarray(known, np.int64)] = True
        biggest = np.arange(len(n.low)) == n.end - 1
        flags[rows] = np.column_stack([biggest, sums, n.times > 1, n.rank])[n.of]
    return pa.ListArray.from_arrays(pa.array((at * len(FLAGS)).astype(np.int32)), pa.array(flags.ravel()))


def sum_places(lists: pa.ListArray, part: np.ndarray, parts: np.ndarray) -> pa.ListArray:
    """For each list, of every ``parts``-th distinct number beginning with ``part``: the places of those that are a sum of two.

    None for lists with a number of more than 36 digits, whose flags are made without.
    """
    out = []
    for k in range(len(lists)):
        written = lists.slice(k, 1).flatten()
        if not len(written) or pc.max(pc.binary_length(written)).as_py() > 2 * DIGITS:
            out.append(None)
            continue
        n = _Numbers(written, np.zeros(len(written), np.int64))
        out.append(_searched_sums(n.high, n.low, n.times, np.arange(part[k], len(n.low), parts[k])))
    return pa.array(out, pa.list_(pa.int64()))


def number_flags():
    """Arrow UDF: the whole numbers of a document, as written, to four flags for each, one after the other."""

    @F.arrow_udf("array<double>")
    def run(numbers: pa.Array) -> pa.Array:
        return flags_of(numbers)

    return run


def number_flags_with_sums():
    """As ``number_flags``, with the places of sums given as a second array; null where they are not."""

    @F.arrow_udf("array<double>")
    def run(numbers: pa.Array, places: pa.Array) -> pa.Array:
        return flags_of(numbers, places.to_pylist())

    return run


def found_sums():
    """Arrow UDF of (numbers, part, parts), see ``sum_places``."""

    @F.arrow_udf("array<bigint>")
    def run(numbers: pa.Array, part: pa.Array, parts: pa.Array) -> pa.Array:
        return sum_places(numbers, part.to_numpy(zero_copy_only=False), parts.to_numpy(zero_copy_only=False))

    return run
