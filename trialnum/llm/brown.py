"""Language-model scores by Brown class n-grams: exchange clustering, class transitions and word emissions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialnum.llm.shared import materialize, text_bytes

END = b""  # the token after a text's last word, and the state before its first
HELD = 500_000  # distinct words whose numbers are held
CHUNK = 8_000_000  # bytes of texts whose words are found together; a single text may have more
BANDS = 16  # bands of counts to a factor of two
PAIRS = 4_000_000  # pairs of words that a task holds before it passes them on
SLICE = 100_000  # entries of words whose moves are weighed at once
RANGE_ENTRIES, RANGE_WORDS = 400_000, 50_000  # entries and words of a range that is unpacked at once; a single word may have more


def tokens(text: str | None) -> list[bytes]:
    """Lower-case (A-Z) words at the six ASCII spaces, and the end."""
    return [*text_bytes(text).lower().split(), END]


def parted(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """`tokens` of some texts after the other: distinct words, each token's place among them, and how many tokens each text has.

    Every text ends with the end, so the token before is also that before a text's first, which is the end too.
    """
    texts = pc.fill_null(texts, "")
    lot = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // CHUNK
    first = np.flatnonzero(np.diff(lot, prepend=-1)).tolist()
    for a, z in pairwise([*first, len(texts)]):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(a, z - a)))
        found = lists.flatten().dictionary_encode()
        words, place = found.dictionary.cast(pa.binary()), found.indices.to_numpy()
        end = pc.index(words, pa.scalar(END, pa.binary())).as_py()  # blanks at the edges of a text make empty words
        if end < 0:
            end, words = len(words), pa.concat_arrays([words, pa.array([END], pa.binary())])
        of = np.repeat(np.arange(z - a), pc.list_value_length(lists).to_numpy())
        real = place != end
        n = np.bincount(of[real], minlength=z - a) + 1
        at = np.full(n.sum(), end, np.int64)
        inner = np.ones(len(at), bool)
        inner[np.cumsum(n) - 1] = False
        at[inner] = place[real]
        yield words, at, n


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 7 == 2, F.lit(False))


def bucket(word: bytes, buckets: int) -> int:
    return zlib.crc32(word[-3:]) % buckets


def bucket_column(word: Column, buckets: int) -> Column:
    return F.crc32(F.substring(word, -3, 3)) % buckets


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of all tokens of `text`, counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, at, _ in parted(batch.column(0)):
                yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(at, minlength=len(words)))], names=["word", "n"])

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Units:
    """What exchange clustering sorts into classes: frequent words, and endings of all others.

    Word numbers and counts of `words` are kept for scoring; the first `single` of them
    are units of their own. Any other word is of the unit of its last three bytes, hashed.
    """

    def __init__(self, words: list[bytes], counts: list[int], single: int, buckets: int):
        self.number = {w: i for i, w in enumerate(words)}
        self.counts = np.array(counts, np.int64)
        self.single, self.buckets = min(single, len(words)), buckets
        self.size = self.single + buckets
        self.unit = np.array([i if i < self.single else self.single + bucket(w, buckets) for i, w in enumerate(words)], np.int64)

    def units_of(self, words: list[bytes]) -> np.ndarray:
        at = np.array([self.number.get(w, -1) for w in words], np.int64)
        units = self.unit[at] if len(self.unit) else np.zeros(len(words), np.int64)
        for i in np.flatnonzero(at < 0).tolist():
            units[i] = self.single + bucket(words[i], self.buckets)
        return units


def unit_pairs(texts: DataFrame, units, size: int) -> np.ndarray:
    """How often unit v follows unit u: a matrix of a fixed size, summed in the tasks and then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for words, at, _ in parted(batch.column(0)):
                u = units.value.units_of(words.to_pylist())[at]
                total += np.bincount(np.roll(u, 1) * size + u, minlength=size * size)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], names=["pair", "n"])

    t = texts.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size, np.int64)
    out[t.column("pair").to_numpy()] = t.column("n").to_numpy()
    return out.reshape(size, size)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int, sweeps: int = 8) -> np.ndarray:
    """Class of each unit by exchange clustering.

    Units, the most frequent first, start dealt out over the classes; then each in turn moves to the
    class that raises the likelihood of the class bigrams most, until a sweep moves none.
    """
    size = len(pairs)
    often = pairs.sum(1) + pairs.sum(0)
    order = np.argsort(-often, kind="stable")
    of = np.zeros(size, np.int64)
    of[order] = np.arange(size) % classes
    pairs = pairs.astype(float)
    member = np.zeros((size, classes))
    member[np.arange(size), of] = 1
    g = member.T @ pairs @ member
    for _ in range(sweeps):
        moved = 0
        for w in order[often[order] > 0].tolist():
            a, own = of[w], pairs[w, w]
            right, left = pairs[w] @ member, pairs[:, w] @ member
            right[a] -= own
            left[a] -= own
            g[a] -= right
            g[:, a] -= left
            g[a, a] -= own
            rows, columns = g.sum(1), g.sum(0)
            grown = _f(g + right) - _f(g)
            across = _f(g + left[:, None]) - _f(g)
            k = np.arange(classes)
            gain = grown.sum(1) + across.sum(0) - grown[k, k] - across[k, k]
            gain += _f(g[k, k] + right + left + own) - _f(g[k, k])
            gain -= _f(rows + right.sum() + own) - _f(rows) + _f(columns + left.sum() + own) - _f(columns)
            b = int(np.argmax(np.round(gain, 6)))
            b = a if gain[b] <= gain[a] + 1e-6 else b
            g[b] += right
            g[:, b] += left
            g[b, b] += own
            if b != a:
                moved += 1
                of[w] = b
                member[w, a], member[w, b] = 0, 1
        if not moved:
            break
    return of


class Words:
    """Numbers of all clustered words, by the rank of their 64-bit hash; all other words are numbered by their ending."""

    def __init__(self, hashes: np.ndarray, buckets: int):
        self.hashes, self.buckets = np.unique(hashes), buckets
        self.size = len(self.hashes) + buckets
        self.held: dict[bytes, int] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": {}}

    def numbers(self, ws: list[bytes]) -> np.ndarray:
        found = list(map(self.held.get, ws))
        if None in found:
            new = list({w for w, x in zip(ws, found, strict=True) if x is None})
            if len(self.held) + len(new) > HELD:
                self.held, new = {}, list(set(ws))
            self.held.update(zip(new, self.look_up(new).tolist(), strict=True))
            found = list(map(self.held.__getitem__, ws))
        return np.array(found, np.int64)

    def look_up(self, new: list[bytes]) -> np.ndarray:
        h = np.array([xxhash.xxh64_intdigest(w, seed=42) for w in new], np.uint64).view(np.int64)
        at = np.searchsorted(self.hashes, h)
        known = np.zeros(len(new), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == h[inside]
        for i in np.flatnonzero(~known).tolist():
            at[i] = len(self.hashes) + bucket(new[i], self.buckets)
        return at


def _packed(code: np.ndarray, n: np.ndarray) -> bytes:
    return pa.compress(np.concatenate([np.diff(code, prepend=0), n]).tobytes(), "zstd", asbytes=True)


def _unpacked(count: int, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(pa.decompress(blob, count * 16, "zstd", asbytes=True), np.int64)
    return np.cumsum(both[:count]), both[count:]


def _summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    return code[first], np.add.reduceat(n, first) if len(first) else n


def _ranges(owners: list[np.ndarray]) -> Iterator[list[tuple[int, int]]]:
    """Cuts sorted lists at the same words, so that about RANGE_ENTRIES of all and at most RANGE_WORDS words lie between."""
    ws = np.unique(np.concatenate(owners))
    ends = [np.searchsorted(own, ws, "right") for own in owners]
    lot = np.maximum(sum(ends) // RANGE_ENTRIES, 0)
    first = np.flatnonzero(np.diff(lot, prepend=-1) != 0)
    cuts = np.unique(np.concatenate([first, np.arange(0, len(ws), RANGE_WORDS)])).tolist()
    for k, to in zip(cuts, [*cuts[1:], len(ws)], strict=True):
        yield [(int(end[k - 1]) if k else 0, int(end[to - 1])) for end in ends]


def word_pairs(texts: DataFrame, words, size: int, parts: int) -> DataFrame:
    """(count, before, after_count, after): each word's neighbours before and after it, packed by ranges of words."""

    def batch_of(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def out(codes: list[np.ndarray]) -> pa.RecordBatch:
        code, n = np.unique(np.concatenate(codes or [np.zeros(0, np.int64)]), return_counts=True)
        rows = []
        for side, own in ((0, code), (1, code % size * size + code // size)):
            own, k = _summed(own, n)
            ends = np.searchsorted(own, -(-np.arange(parts + 1) * size // parts) * size)
            rows += [(p, side, int(z - a), _packed(own[a:z], k[a:z])) for p, (a, z) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if a < z]
        return batch_of(rows, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), ["part", "side", "count", "pairs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held = [], 0
        for batch in batches:
            for distinct, at, _ in parted(batch.column(0)):
                u = words.value.look_up(distinct.to_pylist())[at]
                codes.append(u * size + np.roll(u, 1))
                held += len(u)
                if held > PAIRS:
                    yield out(codes)
                    codes, held = [], 0
        yield out(codes)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        for batch in batches:
            for p, side, count, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.setdefault((p, side), []).append((count, blob))
        for p in sorted({p for p, _ in found}):
            sides = [_summed(*(np.concatenate(x) for x in zip(*[_unpacked(*b) for b in found.pop((p, side))], strict=True))) for side in (0, 1)]
            for ranges in _ranges([code // size for code, _ in sides]):
                row: tuple = ()
                for (code, n), (a, z) in zip(sides, ranges, strict=True):
                    row += (z - a, _packed(code[a:z], n[a:z]))
                yield batch_of([row], (pa.int64(), pa.binary()) * 2, ["count", "before", "after_count", "after"])

    packed = texts.select("text").mapInArrow(run, "part int, side int, count long, pairs binary")
    return materialize(packed.repartition(parts, "part").mapInArrow(merge, "count long, before binary, after_count long, after binary"))


def class_pairs(pairs: DataFrame, of, size: int, classes: int) -> np.ndarray:
    """How often class v follows class u."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros(classes * classes)
        for batch in batches:
            for count, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                code, n = _unpacked(count, blob)
                g += np.bincount(of.value[code % size].astype(np.int64) * classes + of.value[code // size], n, classes * classes)
        at = np.flatnonzero(g)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(g[at].astype(np.int64))], names=["pair", "n"])

    t = pairs.select("count", "before").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(classes * classes)
    out[t.column("pair").to_numpy()] = t.column("n").to_numpy()
    return out.reshape(classes, classes)


def class_likelihood(g: np.ndarray) -> float:
    return float(_f(g).sum() - _f(g.sum(1)).sum() - _f(g.sum(0)).sum())


def move_gains(sides: dict[int, tuple[np.ndarray, np.ndarray]], of: np.ndarray, g: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, class, gain): the best class of each word that another class suits better, all other words staying."""
    classes = len(g)
    ws = np.unique(np.concatenate([code // size for code, _ in sides.values()]))
    a = of[ws].astype(np.int64)
    gain = np.zeros((len(ws), classes))
    for side, (code, n) in sides.items():
        at = np.searchsorted(ws, code // size)
        met = np.bincount(at * classes + of[code % size], n, len(ws) * classes)
        key = np.flatnonzero(met)
        at, c, n = key // classes, key % classes, met[key]
        cells = g if side == 0 else np.ascontiguousarray(g.T)  # by class of the neighbour, class of the word
        known = _f(cells)
        own = a[at]
        ends = np.searchsorted(at, np.arange(len(ws) + 1))
        cut = 0
        while cut < len(ws):  # whole words, about SLICE entries
            to = max(cut + 1, int(np.searchsorted(ends, ends[cut] + SLICE, "right")) - 1)
            x, z = ends[cut], ends[to]
            if x < z:
                row = cells[c[x:z]]
                grown = _f(row + n[x:z, None]) - known[c[x:z]]
                mine = row[np.arange(z - x), own[x:z]]
                grown[np.arange(z - x), own[x:z]] = known[c[x:z], own[x:z]] - _f(np.maximum(mine - n[x:z], 0))
                first = np.flatnonzero(np.diff(at[x:z], prepend=-1))
                gain[at[x:z][first]] += np.add.reduceat(grown, first)
            cut = to
        k = np.bincount(at, n, len(ws))
        total = cells.sum(0)
        margin = _f(total + k[:, None]) - _f(total)
        margin[np.arange(len(ws)), a] = _f(total[a]) - _f(np.maximum(total[a] - k, 0))
        gain -= margin
    gain -= gain[np.arange(len(ws)), a][:, None]
    best = gain.argmax(1)
    more = gain[np.arange(len(ws)), best]
    up = more > 1e-6
    return ws[up], best[up], more[up]


def word_moves(pairs: DataFrame, of, g, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`move_gains` of all words, weighed in tasks against the class pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                count, before, after_count, after = (c[k].as_py() for c in batch.columns)
                w, c, gain = move_gains({0: _unpacked(count, before), 1: _unpacked(after_count, after)}, of.value, g.value, size)
                yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)), pa.array(c.astype(np.int16)), pa.array(gain.astype(np.float32))], names=["word", "class", "gain"])

    t = pairs.mapInArrow(run, "word int, class short, gain float").toArrow()
    return t.column("word").to_numpy(), t.column("class").to_numpy(), t.column("gain").to_numpy()


def cluster_words(pairs: DataFrame, of: np.ndarray, classes: int, least: float = 0.002) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all words, and the class pairs, by rounds of moves until they gain no more.

    In each round all words find their best move by themselves. Moves that hinder each other are told by the
    likelihood: one that does not gain takes back all but the better half of its moves. A round that gains less than
    the part `least` of all gained, or has no move left, is the last.
    """
    context = pairs.sparkSession.sparkContext
    size, kind = len(of), np.uint8 if classes <= 256 else np.int32
    of = of.astype(kind)
    sent = context.broadcast(of)
    g = class_pairs(pairs, sent, size, classes)
    now = begun = class_likelihood(g)
    while True:
        cells = context.broadcast(g)
        w, c, gain = word_moves(pairs, sent, cells, size)
        cells.unpersist()
        order = np.lexsort((w, -gain))
        step = 0.0
        while len(order):
            new = of.copy()
            new[w[order]] = c[order]
            try_sent = context.broadcast(new)
            h = class_pairs(pairs, try_sent, size, classes)
            if (step := class_likelihood(h) - now) > 0:
                sent.unpersist()
                of, sent, g, now = new, try_sent, h, now + step
                break
            try_sent.unpersist()
            order = order[: len(order) // 2]
        if not len(order) or step < least * (now - begun):
            return of.astype(np.int64), g


class ClassModel:
    """log10 P(text) = sum of log10 P(class | class before) and log10 P(word | class).

    Transitions are relative counts, smoothed to the classes' own (Witten-Bell). Emissions take an
    absolute discount off each word's count; what a class saves that way is the chance of the one
    word of it that training does not know.
    """

    def __init__(self, units: Units, of: np.ndarray, pairs: np.ndarray, classes: int, distinct: np.ndarray, discount: float, total: int, types: int, words: Words | None = None):
        self.units, self.of, self.discount, self.words = units, of, discount, words
        if words is None:
            member = np.zeros((len(of), classes), np.int64)
            member[np.arange(len(of)), of] = 1
            pairs = member.T @ pairs @ member
        g = pairs.astype(float)  # of the classes already, where there are `words`
        n, kinds = g.sum(1, keepdims=True), (g > 0).sum(1, keepdims=True)
        own = (g.sum(0) + 1) / (g.sum() + classes)
        with np.errstate(invalid="ignore", divide="ignore"):
            self.step = np.log10(np.where(n > 0, (g + kinds * own) / (n + kinds), own))
        known = np.maximum(np.bincount(of, distinct, classes), 1)
        tokens_of = np.maximum(g.sum(0), 1)
        self.size = np.log10(tokens_of)  # of the class
        self.unknown = np.log10(discount * known)
        self.emit = np.append(np.log10(units.counts - discount), 0.0)  # the last is that of words not kept
        self.base = np.append(np.log10(units.counts + 1.0), 0.0)
        self.floor = float(np.log10(total + types + 1))

    def start(self, words: pa.Array, at: np.ndarray, n: np.ndarray) -> list[pa.Array]:
        """Of `parted` texts: tokens, known ones so far, base and class score so far, and the words whose counts are still to come."""
        ws = words.to_pylist()
        number = np.array([self.units.number.get(w, -1) for w in ws], np.int64)
        k, c = number[at], self.of[self.words.look_up(ws)][at]
        first = np.cumsum(n) - n
        summed = lambda x: np.add.reduceat(x, first)
        score = summed(self.step[np.roll(c, 1), c] - self.size[c] + self.emit[k])
        rest = k < 0
        left, times = np.unique(np.repeat(np.arange(len(n)), n)[rest] * len(ws) + at[rest], return_counts=True)
        ends = np.searchsorted(left, np.arange(len(n) + 1) * len(ws)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (words.take(pa.array(left % len(ws))), pa.array(times, pa.int64()))]
        return [*map(pa.array, (n, summed((~rest).astype(np.int64)), summed(self.base[k]) - n * self.floor, score)), *lists]


def score_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept: int = 200_000, single: int = 512, buckets: int = 512, classes: int = 64, often: int = 5,
) -> DataFrame:
    """One row per document: (id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity).

    All training documents are counted: words, and each word's neighbours, into tables that grow with them. Every word that is
    there `often` times or more is sorted into one of `classes` by Spark rounds of exchange moves; rarer words share the class of their ending,
    which moves too. The rounds start from the classes of `single` + `buckets` units, clustered on the driver. Nine bytes
    for each clustered word are sent to the tasks. At most `kept` words with their counts, those of the highest counts, are sent to the tasks; the counts of all others are joined
    to the documents' remaining words, which are few rows each by the same choice.

    Null texts are empty: one end token. Null ids are training rows. With nothing to learn from every token is
    unknown and the scores stay finite. Repeated rows are scored and learned each; an empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    training = rows.where(~F.col("held_out"))
    band = F.floor(F.log2("n") * BANDS).cast("int")
    counts = materialize(word_counts(training).withColumn("band", band))
    bands = counts.groupBy("band").agg(F.count(F.lit(1)), F.sum("n"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).collect()
    bands = sorted(map(tuple, bands), reverse=True)  # one for each sixteenth of a doubling
    types, total, ones, twos = (sum(b[k] for b in bands) for k in range(1, 5))
    discount = ones / (ones + 2 * twos) if ones and twos else 0.5
    edge, taken = 10**6, 0
    for b in bands:
        if taken + b[1] > kept:
            break
        edge, taken = b[0], taken + b[1]
    top = counts.where(F.col("band") >= edge).select("word", "n").toArrow().to_pydict()
    top = sorted(zip(top["word"], top["n"], strict=True), key=lambda x: (x[0] != END, -x[1], x[0]))
    units = Units([w for w, _ in top], [n for _, n in top], single, buckets)
    shared = spark.sparkContext.broadcast(units)
    pairs = unit_pairs(training, shared, units.size)
    of = exchange(pairs, classes)
    rare = counts.where(F.col("band") < edge)
    hashes = counts.where(F.col("n") >= often).select(F.xxhash64("word").alias("h"), bucket_column(F.col("word"), buckets).cast("int").alias("b")).toArrow()
    words = Words(hashes.column("h").to_numpy(), buckets)
    start = np.concatenate([np.zeros(len(words.hashes), np.int64), of[units.single :]])
    start[np.searchsorted(words.hashes, hashes.column("h").to_numpy())] = of[units.single + hashes.column("b").to_numpy().astype(np.int64)]
    start[words.numbers([w for w, n in top[: units.single] if n >= often])] = of[[i for i, (_, n) in enumerate(top[: units.single]) if n >= often]]
    word_table = word_pairs(training, spark.sparkContext.broadcast(words), words.size, max(12, total // 4_000_000))
    of, pairs = cluster_words(word_table, start, classes)
    distinct = np.ones(words.size, np.int64)
    distinct[len(words.hashes) :] = 0
    for b, n in counts.where(F.col("n") < often).groupBy(bucket_column(F.col("word"), buckets)).count().collect():
        distinct[len(words.hashes) + b] += n
    model = spark.sparkContext.broadcast(ClassModel(units, of, pairs, classes, distinct, discount, total, types, words))
    unknown = F.array(*[F.lit(float(x)) for x in model.value.unknown[of[len(words.hashes) :]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for some in parted(batch.column(2)):
                z = len(some[2])
                ids, marks = (batch.column(k).slice(first, z) for k in (0, 1))
                first += z
                yield pa.RecordBatch.from_arrays([ids, marks, *model.value.start(*some)], names=["id", "held_out", "n_tokens", "kept", "base", "score", "words", "times"])

    parts = "id long, held_out boolean, n_tokens long, kept long, base double, score double, words array<binary>, times array<long>"
    parts = materialize(rows.mapInArrow(run, parts).withColumn("row", F.monotonically_increasing_id()))
    left = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("k"))
    left = left.join(rare.select("word", "n"), "word", "left")
    new = F.element_at(unknown, (bucket_column(F.col("word"), buckets) + 1).cast("int"))
    sums = left.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("k"))).alias("more"),
        F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("more_base"),
        F.sum(F.col("k") * F.when(F.col("n").isNotNull(), F.log10(F.col("n") - F.lit(discount))).otherwise(new)).alias("more_score"),
    )
    joined = parts.drop("words", "times").join(sums, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    score = plus("score", "more_score")
    return joined.select(
        "id", "held_out", "n_tokens", plus("kept", "more").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        plus("base", "more_base").alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
