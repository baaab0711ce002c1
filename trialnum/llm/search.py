"""Exact top-k search by BM25 over sharded inverted indexes with block-max pruning."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialnum.llm.shared import materialize

TERM = re.compile(rb"[a-z0-9\x80-\xff]+")
QUERIES = 4096  # queries of a block, whose terms are sent to the tasks
SHARD = 8192  # documents of an index in memory
TOKENS = 8_000_000  # or tokens
CHUNK = 1024  # documents of a row of the written index
CHUNK_TOKENS = 1_000_000  # or tokens
BLOCK = 64  # documents of a block of the index
STRIP = 4  # blocks that are scored by one product
LEADERS = 16  # documents that the others of a shard are laid out by
FREQUENT = 0.04  # share of a shard's documents from which on a term's impacts are kept as a column
SLACK = 1e-6
TOGETHER = 256  # queries that are held against a shard at once
LAST = np.iinfo(np.int64).max  # stands for a null id, which comes last


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters of the lower-case text."""
    return TERM.findall((text or "").lower().encode("utf-8", "replace"))


class Statistics:
    """Global document frequencies of a block's terms, number of documents and mean length."""

    def __init__(self, vocabulary: dict[bytes, int], df: np.ndarray, n: int, length: int):
        self.vocabulary = vocabulary
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.mean = length / n if n and length else 1.0

    def counts(self, found: list[bytes]) -> np.ndarray:
        """Numbers of the known terms of a document, and how often it has them."""
        known = [i for i in map(self.vocabulary.get, found) if i is not None]
        return np.array(np.unique(np.array(known, np.int32), return_counts=True), np.int32)


class Shard:
    """Inverted index of some documents: impacts by term and document, and largest impacts by term and block.

    Documents are laid out by the one of a few leaders that their frequent terms are nearest to, so that those of a block are alike
    and its bounds tell something.
    """

    def __init__(self, docs: list[tuple[int, np.ndarray, int]], stats: Statistics, k1: float, b: float):
        term, tf = np.concatenate([counts for _, counts, _ in docs], axis=1, dtype=np.int64)
        doc = np.repeat(np.arange(len(docs)), [counts.shape[1] for _, counts, _ in docs])
        self.fill(doc, term, tf, np.array([n for *_, n in docs], float), stats, k1, b)

    @classmethod
    def of_postings(cls, *postings) -> Shard:
        shard = cls.__new__(cls)
        shard.fill(*postings)
        return shard

    def fill(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, length: np.ndarray, stats: Statistics, k1: float, b: float) -> None:
        """The index of postings in any order; `length` has that of each document."""
        self.n, self.size = len(length), len(stats.idf)
        impact = stats.idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / stats.mean))
        lists = np.bincount(term, minlength=self.size)
        many = np.flatnonzero(lists >= max(2, FREQUENT * self.n))
        self.column = np.full(self.size, -1)
        self.column[many] = np.arange(len(many))
        at = self.column[term]
        often, rare = at >= 0, np.flatnonzero(at < 0)
        dense = np.zeros((self.n, len(many)))
        dense[doc[often], at[often]] = impact[often]
        self.order = self.laid_out(dense.astype(np.float32))
        place = np.empty(self.n, np.int64)
        place[self.order] = np.arange(self.n)
        rare = rare[np.argsort(term[rare], kind="stable")]
        lists[many] = 0
        self.start = np.concatenate([[0], np.cumsum(lists)])  # lists of the rare terms alone, so that they stay near
        self.doc, self.impact = place[doc[rare]], impact[rare]
        self.blocks = -(-self.n // BLOCK)
        padded = np.zeros((self.blocks * BLOCK, len(many)))
        padded[: self.n] = dense[self.order]
        self.dense = padded[: self.n]
        self.single = self.dense.astype(np.float32)
        self.most = padded.reshape(self.blocks, BLOCK, len(many)).max(1) if self.n else np.zeros((0, len(many)))

    def laid_out(self, dense: np.ndarray) -> np.ndarray:
        """The documents by their nearest leader, leaders by how near they are to the first."""
        if not self.n:
            return np.zeros(0, np.int64)
        leaders = dense[np.linspace(0, self.n - 1, min(self.n, LEADERS)).astype(int)]
        leaders = leaders / np.maximum(np.sqrt((leaders**2).sum(1)), SLACK)[:, None]
        leaders = leaders[np.argsort(-(leaders @ leaders[0]), kind="stable")]
        return np.argsort((dense @ leaders.T).argmax(1), kind="stable")

    def rare_scores(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the rare terms of each query add to each document, summed over their lists."""
        out = np.zeros((len(queries), self.blocks * BLOCK))
        term, weight = map(np.concatenate, zip(*queries, strict=True))
        start, end = self.start[term], self.start[term + 1]
        has = end > start  # lists of frequent terms are empty
        start, end, weight = start[has], end[has], weight[has]
        ends = np.cumsum(np.bincount(np.repeat(np.arange(len(queries)), [len(q) for q, _ in queries])[has], minlength=len(queries)))
        steps, n, heavy = np.append(start[1:] - end[:-1] + 1, 0), end - start, weight != 1
        begins = np.append(0, ends[:-1])
        most = max((n[a:z].sum() for a, z in zip(begins, ends, strict=True)), default=0)
        places, docs, impacts = np.empty(most, np.int64), np.empty(most, np.int64), np.empty(most)
        for row, first, last in zip(out, begins.tolist(), ends.tolist(), strict=True):
            if last > first:
                many = n[first:last]
                at = places[: many.sum()]
                at.fill(1)  # steps from posting to posting
                at[0] = start[first]
                at[np.cumsum(many[:-1])] = steps[first : last - 1]
                np.cumsum(at, out=at)
                impact = self.impact.take(at, out=impacts[: len(at)], mode="clip")  # as other modes would make a copy
                if (several := np.flatnonzero(heavy[first:last])).size:  # those of weight 1 stand at the end of a query
                    times = np.repeat(weight[first : first + several[-1] + 1], many[: several[-1] + 1])
                    impact[: len(times)] *= times
                row[:] = np.bincount(self.doc.take(at, out=docs[: len(at)], mode="clip"), impact, len(row))
        return out

    def top(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of some queries the documents that may be of the best k with a score above 0 and not below `least`, with their scores.

        Rare terms are summed over their lists. What frequent terms may add is bounded by block. For a query without a threshold so far
        the k documents of the largest bounds are scored in full for one. Some blocks together are scored for the queries of which a document's sum
        and its block's bound reach the threshold: by one product in single precision, whose relative error is below `off` as all parts are positive.
        Documents that may be of the best k by that are scored in full.
        """
        columns = [self.column[query] for query, _ in queries]
        weights = np.zeros((len(queries), self.dense.shape[1]))
        for j, (column, (_, weight)) in enumerate(zip(columns, queries, strict=True)):
            weights[j, column[column >= 0]] = weight[column >= 0]
        rare = self.rare_scores(queries)
        bound = weights @ self.most.T + SLACK
        least = np.array(least, float)
        new = np.flatnonzero(least <= 0)
        if self.n > k and len(new):
            upper = (rare[new].reshape(len(new), self.blocks, BLOCK) + bound[new][:, :, None]).reshape(len(new), -1)[:, : self.n]
            for j, at in zip(new, np.argpartition(-upper, k, axis=1)[:, :k], strict=True):
                least[j] = max(0.0, (rare[j, at] + self.dense[at] @ weights[j]).min())
        open_blocks = rare.reshape(len(queries), self.blocks, BLOCK).max(2) + bound >= least[:, None] - SLACK
        off = (self.dense.shape[1] + 16) * 2.0**-22
        floor = np.nextafter(((least * (1 - off) - SLACK) / (1 + off)).astype(np.float32), np.float32(-1))
        floor = np.maximum(floor, np.finfo(np.float32).tiny)
        single = weights.astype(np.float32)
        may = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        for b in range(0, self.blocks, STRIP):
            if (of := np.flatnonzero(open_blocks[:, b : b + STRIP].any(1))).size:
                docs = slice(b * BLOCK, min((b + STRIP) * BLOCK, self.n))
                about = single[of] @ self.single[docs].T
                np.add(about, rare[of, docs], out=about, casting="same_kind")
                row, at = np.nonzero(about >= floor[of, None])
                may.append((of[row], at + docs.start, about[row, at]))
        row, at, about = map(np.concatenate, zip(*may, strict=True))
        by_query = np.argsort(row, kind="stable")
        ends = np.searchsorted(row[by_query], np.arange(len(queries) + 1))
        for j, (column, (_, weight)) in enumerate(zip(columns, queries, strict=True)):
            here = by_query[ends[j] : ends[j + 1]]
            if len(here) > k:
                kth = np.partition(about[here], len(here) - k)[len(here) - k]
                here = here[about[here] * (1 + off) + SLACK >= kth * (1 - off)]
            found, often = at[here], column >= 0
            total = np.round(rare[j, found] + self.dense[np.ix_(found, column[often])] @ weight[often], 9)
            keep = (total > 0) & (total >= least[j] - SLACK)
            yield self.order[found[keep]], total[keep]


def top_k(
    docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The k best documents of each query by BM25: (query_id, query_hash, rank, id, score).

    A query is a whole text, each of its terms counting as often as it occurs; equal (id, text)
    pairs are one query. The documents' terms are found once, and their inverted index is written. Queries go to the tasks in blocks of a fixed number.
    For a block, one pass over the index sums its terms' global document frequencies, and a second one searches shard by shard; the shards' best k
    are merged and written. With global statistics and bounds that never fall short, the result is that of scoring all pairs.

    Scores are rounded to 9 digits; of equal scores the smaller id comes first, null ids last. Documents without any term of the
    query are no result, so a query without terms has no rows; nor has an empty table. Repeated documents are results each; other
    columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.xxhash64(text_col).alias("query_hash"), F.col(text_col).alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(terms(t)) for t in batch.column(2).to_pylist()]
            lists = [pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["query_id", "query_hash", "terms", "times"])

    asked = asked.mapInArrow(split, "query_id long, query_hash long, terms array<binary>, times array<long>")
    asked = materialize(asked.dropDuplicates(["query_id", "query_hash"]))
    total = asked.count()
    blocks = max(1, -(-total // QUERIES))
    index = materialize(_index(rows)) if total else None
    best = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    found = None
    for i in range(blocks if total else 0):
        block = asked.where(F.pmod(F.xxhash64("query_id", "query_hash"), F.lit(blocks)) == i)
        out = _search_block(index, block.toArrow().to_pydict(), k, k1, b)
        out = materialize(out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
        found = out if found is None else found.unionByName(out)
    if found is None:
        found = spark.createDataFrame([], "query_id long, query_hash long, id long, score double, rank int")
    return found.select("query_id", "query_hash", "rank", "id", "score")


def _index(rows: DataFrame) -> DataFrame:
    """The inverted index of some documents a row: their number and tokens, the sorted terms parted by blanks, how many documents each
    has, these documents and how often they have it, and the documents' ids and lengths."""
    most, most_tokens = min(CHUNK, SHARD), min(CHUNK_TOKENS, TOKENS)
    columns = ("n", "tokens", "terms", "df", "doc", "tf", "ids", "lengths")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        lengths: list[int] = []
        codes: list[int] = []
        code: defaultdict[bytes, int] = defaultdict()
        code.default_factory = code.__len__

        def chunk() -> pa.RecordBatch:
            names = pa.array(list(code), pa.binary())
            order = pc.array_sort_indices(names).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            key = rank[np.array(codes, np.int64)] * len(ids) + np.repeat(np.arange(len(ids)), lengths)
            key, tf = np.unique(key, return_counts=True)
            term, doc = np.divmod(key, len(ids))
            values = [
                len(ids), len(codes), b" ".join(names.take(pa.array(order)).to_pylist()), np.bincount(term, minlength=len(order)).astype("<u4").tobytes(),
                doc.astype("<u2").tobytes(), tf.astype(np.min_scalar_type(tf.max(initial=0)).newbyteorder("<")).tobytes(),
                np.array(ids, "<i8").tobytes(), np.array(lengths, "<i8").tobytes(),
            ]
            for x in (ids, lengths, codes, code):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in values], names=columns)

        for batch in batches:
            for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = terms(text)
                ids.append(LAST if i is None else i)
                lengths.append(len(found))
                codes.extend(map(code.__getitem__, found))
                if len(ids) >= most or len(codes) >= most_tokens:
                    yield chunk()
        if ids:
            yield chunk()

    return rows.mapInArrow(index, ", ".join(f"{c} {'long' if c in ('n', 'tokens') else 'binary'}" for c in columns))


def _search_block(index: DataFrame, block: dict, k: int, k1: float, b: float) -> DataFrame:
    context = index.sparkSession.sparkContext
    vocabulary = {t: i for i, t in enumerate(sorted({t for ts in block["terms"] for t in ts}))}

    def parsed(terms_of: list[bytes], times: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """A query's terms in the vocabulary and how often it has them, those it has once at the end."""
        term, weight = np.array([vocabulary[t] for t in terms_of], np.int64), np.array(times, float)
        order = np.argsort(weight == 1, kind="stable")
        return term[order], weight[order]

    columns = zip(*(block[c] for c in ("query_id", "query_hash", "terms", "times")), strict=True)
    asked = [(q, h, *parsed(ts, n)) for q, h, ts, n in columns if ts]
    known = context.broadcast(vocabulary)

    def places(names: bytes, of: dict[bytes, int]) -> np.ndarray:
        """The numbers of the index' terms in the block's vocabulary, -1 for others."""
        return np.fromiter(map(of.get, names.split(), repeat(-1)), np.int64)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = known.value
        df, n, length = np.zeros(len(of), np.int64), 0, 0
        for batch in batches:
            for docs, tokens, names, lists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n += docs
                length += tokens
                at = places(names, of)
                df[at[at >= 0]] += np.frombuffer(lists, "<u4")[at >= 0]
        at = np.flatnonzero(df)
        term, n = np.append(at, [-1, -2]), np.append(df[at], [n, length])
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(n, pa.int64())], names=["term", "n"])

    counted = index.select("n", "tokens", "terms", "df").mapInArrow(frequencies, "term long, n long")
    counted = counted.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counted = dict(zip(counted.column("term").to_pylist(), counted.column("n").to_pylist(), strict=True))
    df = np.array([counted.get(i, 0) for i in range(len(vocabulary))], float)
    stats = context.broadcast((Statistics(vocabulary, df, counted.get(-1, 0), counted.get(-2, 0)), asked))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about, asked = stats.value
        ids = [np.zeros(0, np.int64)] * len(asked)
        scores = [np.zeros(0)] * len(asked)
        held: list[tuple[np.ndarray, ...]] = []

        def look() -> None:
            doc, term, tf, names, length = map(np.concatenate, zip(*held, strict=True))
            held.clear()
            shard = Shard.of_postings(doc, term, tf, length, about, k1, b)
            for first in range(0, len(asked), TOGETHER):
                some = range(first, min(first + TOGETHER, len(asked)))
                least = np.array([scores[j][-1] if len(scores[j]) == k else 0.0 for j in some])
                for j, (at, total) in zip(some, shard.top([asked[j][2:] for j in some], k, least), strict=True):
                    if len(at):
                        i, s = np.concatenate([ids[j], names[at]]), np.concatenate([scores[j], total])
                        best = np.lexsort((i, -s))[:k]
                        ids[j], scores[j] = i[best], s[best]

        docs = size = 0
        for batch in batches:
            for row in range(batch.num_rows):
                n, tokens, terms_of, *parts = (c[row].as_py() for c in batch.columns)
                if held and (docs + n > SHARD or size + tokens > TOKENS):
                    look()
                    docs = size = 0
                lists, doc, names, length = (np.frombuffer(parts[p], d) for p, d in ((0, "<u4"), (1, "<u2"), (3, "<i8"), (4, "<i8")))
                tf = np.frombuffer(parts[2], f"<u{len(parts[2]) // max(1, len(doc))}") if len(doc) else doc
                at = places(terms_of, about.vocabulary)
                of = np.repeat(at, lists)
                asked_for = of >= 0
                held.append((doc[asked_for].astype(np.int64) + docs, of[asked_for], tf[asked_for].astype(np.int64), names, length.astype(float)))
                docs += n
                size += tokens
        if held:
            look()
        for a in range(0, len(asked), 1000):
            n = [len(i) for i in ids[a : a + 1000]]
            if not sum(n):
                continue
            q = [x for (q, *_), m in zip(asked[a : a + 1000], n, strict=True) for x in [q] * m]
            h = [x for (_, h, *_), m in zip(asked[a : a + 1000], n, strict=True) for x in [h] * m]
            i = [None if x == LAST else x for x in np.concatenate(ids[a : a + 1000]).tolist()]
            columns = [pa.array(q, pa.int64()), pa.array(h, pa.int64()), pa.array(i, pa.int64()), pa.array(np.concatenate(scores[a : a + 1000]))]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "query_hash", "id", "score"])

    return index.mapInArrow(search, "query_id long, query_hash long, id long, score double")
