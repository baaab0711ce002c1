"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists.

Two words differ by one inserted, deleted or replaced code point. All words that could meet in an
edit between two places of a word share what stands before and behind these places, so they form a
group. A group's words are sorted, and every word of it scans that list: it keeps the rows of its
edit matrix for the prefix it stands at (a band of two diagonals, as the scanning word is never the
longer one), takes over the rows that the next word's longest common prefix covers, and jumps over
the whole range of words that share a prefix no row of which is within one edit.

Spark deals out the groups. First the two halves of a word are the places of the edit; a group of
many words is halved again, down to single places, where it cannot be larger than the alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialnum.llm.shared import materialize

GROUP_WORDS = 20_000  # a group of more words is halved
CHUNK_ROWS = 50_000  # rows of whole groups that are scanned together
SCANNERS = 20_000  # words that scan side by side
FOUND = "word string, n_near long, near_n long, near string"


def _common_prefixes(points: np.ndarray, at: np.ndarray, length: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Longest common prefix of each row with the row before; -1 at the start of a group."""
    n = len(length)
    lcp = np.full(n, -1, np.int64)
    same = np.flatnonzero(np.r_[False, group[1:] == group[:-1]])
    lcp[same] = 0
    depth = 0
    while len(same):
        same = same[(length[same] > depth) & (length[same - 1] > depth)]
        same = same[points[at[same] + depth] == points[at[same - 1] + depth]]
        depth += 1
        lcp[same] = depth
    return lcp


def _range_ends(lcp: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For row i and depth d, at place at[i] + d: the first later row that does not share i's first d + 1 points."""
    ends = np.empty(int(length.sum()) + 1, np.int64)
    rows = np.arange(len(length))
    for depth in range(int(length.max(initial=0))):
        rows = rows[length[rows] > depth]
        breaks = np.append(np.flatnonzero(lcp <= depth), len(length))
        ends[at[rows] + depth] = breaks[np.searchsorted(breaks, rows, side="right")]
    return ends


def scan_sorted(
    points: np.ndarray, length: np.ndarray, group: np.ndarray, scans: np.ndarray, size: np.ndarray, last: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (scanning row, found row) one edit apart, within groups of sorted strings.

    ``points`` are the code points of all strings one after the other, ``scans`` marks the rows that
    scan; their strings have ``size`` points, all others of a group have that or one more. A string
    that only adds a point at its end is found where ``last``, as otherwise the edit belongs to the
    group of the places that follow.
    """
    at = np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64) if len(length) else np.zeros(0, np.int64)
    lcp = _common_prefixes(points, at, length, group)
    ends = _range_ends(lcp, at, length)
    first = np.maximum.accumulate(np.where(lcp < 0, np.arange(len(length)), 0)) if len(length) else at
    stop = np.append(np.flatnonzero(lcp < 0), len(length))
    stop = stop[np.searchsorted(stop, np.arange(len(length)), side="right")]
    padded = np.append(points, 0)
    found_by, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    scanning = np.flatnonzero(scans)
    for begin in range(0, len(scanning), SCANNERS):
        x = scanning[begin : begin + SCANNERS]
        lx = size[x]
        # rows of the matrix by depth: with as many points of both, and with one more of the found string
        base = np.concatenate([[0], np.cumsum(lx + 2)[:-1]])
        even = np.zeros(int((lx + 2).sum()), np.int8)
        more = np.full(len(even), 2, np.int8)
        xa, to = at[x], stop[x]
        y, depth = first[x].copy(), np.zeros(len(x), np.int64)
        while len(x):
            here = at[y] + depth
            c = padded[here]
            a = even[base + depth] + ((depth >= lx) * 2 + (padded[np.minimum(xa + depth, len(points))] != c))
            b = more[base + depth] + (padded[xa + np.maximum(depth - 1, 0)] != c)
            b = np.minimum(b, even[base + depth] + 1)
            dead = (a > 1) & (b > 1)
            depth += 1
            even[base + depth] = np.minimum(a, 2)
            more[base + depth] = np.minimum(b, 2)
            whole = ~dead & (depth == length[y])
            if whole.any():
                k = np.flatnonzero(whole)
                longer = length[y[k]] > lx[k]
                ends_with_it = (even[base[k] + lx[k]] == 0) & ~last[x[k]]
                hit = np.where(longer, (b[k] == 1) & ~ends_with_it, a[k] == 1)
                found_by.append(x[k[hit]])
                found.append(y[k[hit]])
            moves = dead | whole
            nxt = np.where(dead, ends[here], y + 1)
            y = np.where(moves, nxt, y)
            on = y < to
            # rows up to the common prefix with the word before stay valid
            depth = np.where(moves & on, lcp[np.minimum(y, len(length) - 1)], depth)
            if not on.all():
                x, lx, base, xa, to, y, depth = x[on], lx[on], base[on], xa[on], to[on], y[on], depth[on]
    return np.concatenate(found_by), np.concatenate(found)


def _points(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings, and the length of each."""
    joined = "".join(strings.to_pylist())
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32), pc.utf8_length(strings).to_numpy().astype(np.int64)


def _scan_chunk(rows: pa.Table) -> pa.RecordBatch:
    """Near words of whole groups: per word their number and the most frequent one."""
    rows = rows.combine_chunks()
    keys = rows["key"].combine_chunks().dictionary_encode() if rows.num_rows else None
    group = keys.indices.to_numpy()
    middle = rows["middle"].combine_chunks()
    points, length = _points(middle)
    pairs = scan_sorted(
        points, length, group, rows["scans"].to_numpy(zero_copy_only=False), rows["size"].to_numpy().astype(np.int64),
        rows["last"].to_numpy(zero_copy_only=False),
    )
    # both ways: equal lengths find each other, a longer word is found by the shorter one only
    longer = length[pairs[1]] > length[pairs[0]]
    left = np.concatenate([pairs[0], pairs[1][longer]])
    right = np.concatenate([pairs[1], pairs[0][longer]])
    count, word = rows["n"].to_numpy(), rows["word"].combine_chunks()
    rank = np.empty(len(word), np.int64)
    rank[pc.sort_indices(word).to_numpy()] = np.arange(len(word))  # by UTF-8 bytes, which is by code points
    order = np.lexsort((rank[right], -count[right], left))
    left, right = left[order], right[order]
    owner, start, n_near = np.unique(left, return_index=True, return_counts=True)
    best = right[start]
    columns = [word.take(pa.array(owner)), pa.array(n_near), pa.array(count[best]), word.take(pa.array(best))]
    return pa.RecordBatch.from_arrays(columns, ["word", "n_near", "near_n", "near"])


def scan_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of a sorted partition, some whole ones at a time; one group has at most GROUP_WORDS rows or an alphabet."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < CHUNK_ROWS:
            continue
        rows = pa.Table.from_batches(held)
        keys = rows["key"].combine_chunks()
        inner = pc.indices_nonzero(pc.not_equal(keys, keys[len(keys) - 1]))
        cut = inner[len(inner) - 1].as_py() + 1 if len(inner) else 0
        if cut:
            yield _scan_chunk(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
    if held:
        yield _scan_chunk(pa.Table.from_batches(held))


def _groups(words: DataFrame) -> DataFrame:
    """Rows (word, n, m, low, high) made to group rows with key and middle.

    ``m`` is the length of the shorter word of a pair; the edit lies at a place from ``low`` to
    before ``high``, so the first ``low`` and the last ``m - high`` points are shared.
    """
    length = F.length("word")
    tail = F.col("m") - F.col("high")
    start = F.substring("word", F.lit(1), F.col("low"))
    end = F.substring("word", length - tail + 1, tail)
    head = F.concat_ws("/", "m", "low", "high", start, end)
    return words.select(
        "word", "n", "m", "low", "high", head.alias("key"),
        F.substring("word", F.col("low") + 1, length - F.col("low") - tail).alias("middle"),
        (length == F.col("m")).alias("scans"), (F.col("high") - F.col("low")).alias("size"),
        (F.col("high") == F.col("m")).alias("last"),
    )


def _halves(low: Column, high: Column) -> Column:
    middle = ((low + high) / 2).cast("int")
    return F.array(F.struct(low.alias("low"), middle.alias("high")), F.struct(middle.alias("low"), high.alias("high")))


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n)`` of distinct words -> ``(word, n_near, near_n, near)`` of those with a word one edit apart.

    ``near`` is the most frequent near word, of equals the first in code point order, ``near_n`` how
    often it occurs. Words without a near word give no row; empty and null words are left out.
    """
    length = F.length("word")
    both = F.filter(F.array(length, length - 1), lambda m: m >= 1)
    rows = words.where("word <> ''").select("word", "n", F.explode(both).alias("m"))
    # a pair whose shorter word is a single point has one place; all others start with two halves
    halves = F.when(F.col("m") > 1, _halves(F.lit(0), F.col("m"))).otherwise(
        F.array(F.struct(F.lit(0).alias("low"), F.col("m").alias("high")))
    )
    rows = rows.select("word", "n", "m", F.inline(halves))
    found = []
    while True:
        grouped = _groups(rows)
        large = grouped.where("high - low > 1").groupBy("key").count().where(F.col("count") > GROUP_WORDS)
        large = materialize(large.select("key"))  # a GROUP_WORDS-th of all rows at most
        split = not large.isEmpty()
        ready = grouped.join(F.broadcast(large), "key", "left_anti") if split else grouped
        dealt = ready.select("key", "middle", "word", "n", "scans", "size", "last").repartition("key")
        found.append(dealt.sortWithinPartitions("key", "middle").mapInArrow(scan_groups, FOUND))
        if not split:
            break
        rows = grouped.join(F.broadcast(large), "key", "left_semi").select("word", "n", "m", F.inline(_halves(F.col("low"), F.col("high"))))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    first = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    best = pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first"))
    return best.select("word", "n_near", (-F.col("first.less")).alias("near_n"), F.col("first.near").alias("near"))


def variant_groups(words: DataFrame, times: int = 10) -> DataFrame:
    """``(word, n)`` of distinct words -> ``(word, form, root, n, n_near, form_n)``, one row per word.

    A word's form is its near word of largest n if that is at least ``times`` its own n; its root is
    the last word that forms lead to. Forms grow at least ``times``-fold, so a chain has a few steps;
    it is followed by doubling. A word of many variants is a join key with at most its near words
    for a row, which adaptive execution splits. An empty table gives no rows.
    """
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")))
    near = near_words(words)
    has_form = F.col("near_n") >= F.lit(times) * F.col("n")
    table = materialize(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has_form, F.col("near")).alias("form"), F.when(has_form, F.col("near_n")).alias("form_n"),
        )
    )
    links = table.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(links.join(further, "root", "left"))
        links = step.select("word", F.coalesce("next", "root").alias("root"))
        if step.where("next IS NOT NULL").isEmpty():
            break
    joined = table.join(links, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def letter_runs(text: Column, letters: str, least: int) -> Column:
    """Maximal runs of ``letters`` (a character class) with ``least`` code points or more; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[{letters}]{{{least},}}+"), F.lit(0))


def without_point(word: Column, place: Column) -> Column:
    """A word without its code point at ``place`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))
