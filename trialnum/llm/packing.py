"""Packing token sequences: cutting at the capacity and bulk-synchronous best-fit."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialnum.llm.shared import materialize, text_bytes

LOCAL = 50_000  # items and gaps left that one task finishes, in the same rounds
CACHE = 800_000  # encodings of distinct words that a Python worker keeps
# a run of Latin-1 letters and perhaps one of signs: one or two parts for the vocabulary's splitter
PLAIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+([.,;:!?#$%&*|]+)?")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SWEPT = "part int, item long, len long, seq long, gap long, rank long"
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of a text as little-endian bytes, word by word.

    The vocabulary's normaliser and splitter never look across white space, so a text's ids are
    those of its words (split at the six ASCII spaces) in a row. Encodings of words are kept, up
    to a bound. Unseen plain words of a batch are encoded in one call and told apart by the ids
    that end a word; others one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def learn(self, new: list[bytes]) -> None:
        if len(self.known) + len(new) > CACHE:  # frequent words came first
            self.known = dict(islice(self.known.items(), CACHE // 2))
        parts = list(map(PLAIN.fullmatch, new))
        for w in (w for w, m in zip(new, parts, strict=True) if not m):
            self.known[w] = self.ids(w.decode())
        plain = [(w, 2 if m[1] else 1) for w, m in zip(new, parts, strict=True) if m]
        for i in range(0, len(plain), 2000):
            some = plain[i : i + 2000]
            text = b" ".join(w for w, _ in some).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.is_end[ids]) + 1
            cut = ends[np.cumsum([n for _, n in some]) - 1].tolist()
            raw = ids.tobytes()
            for (w, _), a, b in zip(some, [0, *cut], cut, strict=False):
                self.known[w] = raw[4 * a : 4 * b]

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        for i in range(0, len(texts), 64):
            split = [text_bytes(t).split() for t in texts[i : i + 64]]
            found = [list(map(self.known.get, ws)) for ws in split]
            new = {w for ws, ids in zip(split, found, strict=True) if None in ids for w, x in zip(ws, ids, strict=True) if x is None}
            if new:
                self.learn(list(new))
            for ws, ids in zip(split, found, strict=True):
                if None in ids:
                    ids = [self.known[w] if x is None else x for w, x in zip(ws, ids, strict=True)]
                yield b"".join(ids)


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as token pieces of at most `capacity`: (doc_id, piece, start, length, ids_crc32).

    A document is the ids of its whole text and `end_id`; only longer ones are cut, all pieces but
    the last being full. Null and empty texts are the end id alone. Repeated rows give repeated pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    out.append((doc, k, a // 4, len(part) // 4, zlib.crc32(part)))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def sweep(size: np.ndarray, is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (items, gaps) of the successor matching of rows in ascending size.

    Items open and gaps close, as brackets: each gap takes the largest item that fits and no
    smaller gap took. Brackets that face each other on one level are a match.
    """
    step = np.where(is_gap, -1, 1)
    depth = np.cumsum(step)
    level = np.where(is_gap, depth + 1, depth)
    order = np.argsort(level, kind="stable")
    lv, g = level[order], is_gap[order]
    hit = (lv[:-1] == lv[1:]) & ~g[:-1] & g[1:]
    return order[:-1][hit], order[1:][hit]


def _arrow(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()], names=list(columns))


def _swept(part: int, item, length, seq, gap, rank) -> pa.RecordBatch:
    n = max(len(x) for x in (item, seq) if x is not None)
    none = pa.nulls(n, pa.int64())
    col = lambda x: none if x is None else pa.array(x, pa.int64())
    return _arrow(part=pa.array(np.full(n, part), pa.int32()), item=col(item), len=col(length), seq=col(seq), gap=col(gap), rank=col(rank))


def sweep_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of one range of sizes, then the gaps and the items left, ranked from the range's edges inward."""
    read = [b for b in batches if b.num_rows]
    if not read:
        return
    t = pa.Table.from_batches(read)
    size, uid, part = (t.column(i).to_numpy() for i in range(3))
    is_gap = size % 2 == 1
    i, g = sweep(size, is_gap)
    value = size // 2
    p = int(part[0])
    if len(i):
        yield _swept(p, uid[i], value[i], uid[g], value[g], None)
    free = np.ones(len(size), bool)
    free[i] = free[g] = False
    left = np.flatnonzero(free & is_gap)
    if len(left):
        yield _swept(p, None, None, uid[left], value[left], np.arange(len(left)))
    left = np.flatnonzero(free & ~is_gap)
    if len(left):
        yield _swept(p, uid[left], value[left], None, None, np.arange(len(left))[::-1])


def flows(parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Where items left in one range meet gaps left in a later one.

    `parts` has (range, gaps left, items left) in order. Gives (item range, first item rank, gap
    range, first gap rank, how many); items are ranked from the last, gaps from the first. One
    entry of `parts` per Spark partition, and at most two flows for each.
    """
    out, stack = [], []
    for part, gaps, items in parts:
        at = 0
        while at < gaps and stack:
            other, first, n = stack.pop()
            take = min(n, gaps - at)
            out.append((other, first, part, at, take))
            at += take
            if take < n:
                stack.append((other, first + take, n - take))
        if items:
            stack.append((part, 0, items))
    return out


def one_round(items: DataFrame, gaps: DataFrame) -> tuple[DataFrame, int, int, int | None, int]:
    """One bulk-synchronous round: (item, len, seq, gap) rows, matched if both item and seq are set.

    Also how many rows matched, and of the items left the sum and the least of their lengths and their number.
    """
    sized = items.select((F.col("len") * 2).alias("size"), F.col("item").alias("uid")).unionByName(
        gaps.select((F.col("gap") * 2 + 1).alias("size"), F.col("seq").alias("uid"))
    )
    ranged = sized.repartitionByRange("size", "uid").sortWithinPartitions("size", "uid").withColumn("part", F.spark_partition_id())
    swept = materialize(ranged.mapInArrow(sweep_partition, SWEPT))
    is_item, is_gap = F.col("item").isNotNull(), F.col("seq").isNotNull()
    length = F.when(~is_gap, F.col("len"))
    of_part = swept.groupBy("part").agg(
        F.count_if(is_gap & ~is_item), F.count_if(is_item & ~is_gap), F.count_if(is_item & is_gap), F.sum(length), F.min(length)
    )
    parts = sorted(tuple(r) for r in of_part.collect())
    matched = sum(p[3] for p in parts)
    across = flows([p[:3] for p in parts])
    if not across:
        return swept, matched, sum(p[4] or 0 for p in parts), min((p[5] for p in parts if p[5]), default=None), sum(p[2] for p in parts)
    plan = swept.sparkSession.createDataFrame(
        [(k, *f) for k, f in enumerate(across)], "flow long, item_part int, item_rank long, gap_part int, gap_rank long, n long"
    )
    plan = F.broadcast(plan)  # two rows for each Spark partition at most

    def within(side: str):
        rank = F.col("rank") - F.col(f"{side}_rank")
        return (F.col("part") == F.col(f"{side}_part")) & (rank >= 0) & (rank < F.col("n"))

    place = lambda side: ("flow", (F.col("rank") - F.col(f"{side}_rank")).alias("at"))
    a = swept.where(is_item & ~is_gap).join(plan, within("item"), "left").select(*place("item"), "item", "len")
    b = swept.where(is_gap & ~is_item).join(plan, within("gap"), "left").select(*place("gap"), "seq", "gap")
    lone = F.col("flow").isNull()
    met = a.where(~lone).join(b.where(~lone), ["flow", "at"]).select("item", "len", "seq", "gap")
    none = F.lit(None).cast("long")
    alone = a.where(lone).select("item", "len", none.alias("seq"), none.alias("gap")).unionByName(
        b.where(lone).select(none.alias("item"), none.alias("len"), "seq", "gap")
    )
    out = materialize(swept.where(is_item & is_gap).select("item", "len", "seq", "gap").unionByName(met).unionByName(alone))
    left = out.agg(F.sum(length), F.min(length), F.count_if(~is_gap)).first()
    return out, matched + sum(f[4] for f in across), left[0] or 0, left[1], left[2]


def bundles(small: DataFrame, most: int) -> DataFrame:
    """Small items put together to bundles of at most `most`: (item, len, bundle), wherever the items lie."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, room = None, 0
        for batch in batches:
            item, length = (batch.column(i).to_pylist() for i in range(2))
            names = []
            for i, n in zip(item, length, strict=True):
                if n > room:
                    head, room = i, most
                room -= n
                names.append(head)
            yield _arrow(item=pa.array(item, pa.int64()), len=pa.array(length, pa.int64()), bundle=pa.array(names, pa.int64()))

    return small.select("item", "len").mapInArrow(fill, "item long, len long, bundle long")


def finish(capacity: int, opened: int, turn: int):
    """The rounds of `best_fit` over what is left in one task, of LOCAL rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), schema=pa.schema([(c, pa.int64()) for c in ("item", "len", "seq", "gap")]))
        item, length, seq, gap = (t.column(i).to_numpy() for i in range(4))
        is_item = ~np.isnan(item.astype(float))
        item, length = item[is_item].astype(np.int64), length[is_item].astype(np.int64)
        seq, gap = seq[~is_item].astype(np.int64), gap[~is_item].astype(np.int64)
        bins, at, matched = opened, turn, len(gap)
        while len(item):
            if not matched:
                more = -(-int(length.sum()) // capacity)
                seq = np.concatenate([seq, -1 - np.arange(bins, bins + more)])
                gap = np.concatenate([gap, np.full(more, capacity)])
                bins += more
            size, uid = np.concatenate([2 * length, 2 * gap + 1]), np.concatenate([item, seq])
            order = np.lexsort((uid, size))
            i, g = sweep(size[order], order >= len(item))
            i, g = order[i], order[g] - len(item)
            matched, at = len(i), at + 1
            if matched:
                yield _arrow(item=item[i], seq=seq[g], round=pa.array(np.full(matched, at), pa.int32()))
            gap[g] -= length[i]
            item, length = np.delete(item, i), np.delete(length, i)
            room = gap >= (length.min() if len(length) else 1)
            seq, gap = seq[room], gap[room]

    return run


def best_fit(items: DataFrame, capacity: int) -> DataFrame:
    """Sequences for items (item, len) with 0 < len < capacity: (item, len, seq, round).

    Each round range-sorts what is left of items and gaps together and matches them in successor
    sweeps (`sweep` within a range, `flows` between ranges): every gap gets one item, a conflict
    over a gap being settled by rank. Gaps shrink and the next round begins; whenever
    nothing fits any more, as many empty sequences are opened as the items left fill. Items
    of up to a 64th of the capacity are bundled to a 32nd first, which bounds the rounds. The last
    LOCAL rows, a fixed number at any size of the input, go through their rounds in one task.
    """
    spark: SparkSession = items.sparkSession
    bundled = materialize(bundles(items.where(F.col("len") <= capacity // 64), capacity // 32))
    units = bundled.groupBy("bundle").agg(F.sum("len").alias("len")).withColumnRenamed("bundle", "item")
    todo = items.where(F.col("len") > capacity // 64).select("item", "len").unionByName(units.select("item", "len"))
    todo = materialize(todo)
    total, least, n = todo.agg(F.sum("len"), F.min("len"), F.count(F.lit(1))).first()
    gaps = spark.range(0).select(F.col("id").alias("seq"), F.col("id").alias("gap"))
    opened, matched, done, turn = 0, 0, [], 0
    while n:
        if n <= LOCAL and (left := gaps.limit(LOCAL + 1).count()) + n <= LOCAL:
            none = F.lit(None).cast("long")
            last = todo.select("item", "len", none.alias("seq"), none.alias("gap"))
            last = last.unionByName(gaps.select(none.alias("item"), none.alias("len"), "seq", "gap")) if left else last
            done.append(materialize(last.coalesce(1).mapInArrow(finish(capacity, opened, turn), "item long, seq long, round int")))
            break
        if not matched:
            more = -(-total // capacity)
            gaps = gaps.unionByName(spark.range(opened, opened + more).select((-1 - F.col("id")).alias("seq"), F.lit(capacity).cast("long").alias("gap")))
            opened += more
        out, matched, total, least, n = one_round(todo, gaps)
        turn += 1
        pair = F.col("item").isNotNull() & F.col("seq").isNotNull()
        done.append(out.where(pair).select("item", "seq", F.lit(turn).alias("round")))
        todo = out.where(F.col("seq").isNull()).select("item", "len")
        gaps = out.where(F.col("seq").isNotNull()).select("seq", (F.col("gap") - F.coalesce("len", F.lit(0))).alias("gap"))
        gaps = gaps.where(F.col("gap") >= F.lit(least or capacity))
    placed = spark.createDataFrame([], "item long, seq long, round int")
    for d in done:
        placed = placed.unionByName(d)
    single = items.where(F.col("len") > capacity // 64).select("item", "len", F.col("item").alias("bundle"))
    return single.unionByName(bundled).join(placed.withColumnRenamed("item", "bundle"), "bundle").select("item", "len", "seq", "round")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of all documents packed into few sequences of at most `capacity` tokens.

    (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece of
    `token_pieces`. Full pieces are sequences of their own; the others go through `best_fit`.
    Offsets are gapless in the order of the rounds. Null and empty texts take one place; repeated
    rows are packed each; an empty table gives no rows; other columns are ignored.
    """
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col).withColumn("item", F.monotonically_increasing_id()))
    short = pieces.where(F.col("length") < capacity)
    placed = best_fit(short.select("item", F.col("length").alias("len")), capacity)
    in_order = Window.partitionBy("seq").orderBy("round", "item").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("item", "seq", F.coalesce(F.sum("len").over(in_order), F.lit(0)).alias("offset"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.where(F.col("length") == capacity).select(*names, F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(short.join(placed, "item").select(*names, F.col("seq").alias("sequence_id"), "offset"))
