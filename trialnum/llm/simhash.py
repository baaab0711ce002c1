"""SimHash near-duplicates: fingerprints, and a binary trie self-join within a Hamming budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialnum.llm.components import components
from trialnum.llm.shared import join_by_key, materialize, row_key, text_bytes

BITS = 64
NODE = 20_000  # fingerprints of one trie node that a task joins; larger nodes are cut into pairs of parts
LEAF = 64  # pairs of two nodes that are compared at once
FRONTIER = 20_000  # node pairs that are expanded at once
BUFFER = 100_000  # rows of whole nodes that are joined at once


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, repeats included; 0 if it has no word."""
    words = text_bytes(text).lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(starts), 65_536):
        h = [xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[i : i + 65_536], ends[i : i + 65_536], strict=True)]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash, fp): fingerprint as a signed long, and XXH64 of the text to tell rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["id", "hash", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, hash long, fp long")


class TrieJoin:
    """Classes of sorted codes that a chain of links within the budget connects.

    A node of the trie is a range of the sorted codes that share their leading bits. Pairs of nodes
    go down together, a pair of unlike children adds one differing bit, and a pair beyond
    the budget is dropped. So is a pair whose codes already are one class, which keeps a
    dense cluster from being compared all with all.
    """

    def __init__(self, codes: np.ndarray, budget: int):
        self.codes, self.budget = codes, budget
        self.label = np.arange(len(codes))
        self.turns = np.zeros(len(codes), np.int64)
        self.zeros: dict[int, np.ndarray] = {}
        self.settle()

    def settle(self) -> None:
        """Where labels change along the codes, so that a range of one class is seen at once."""
        self.turns = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        parent, a, b = self.label, self.label[i], self.label[j]
        while (apart := a != b).any():
            a, b = a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while (parent[parent] != parent).any():
                parent[:] = parent[parent]
            a, b = parent[a], parent[b]
        self.settle()

    def middle(self, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        if depth not in self.zeros:
            bit = (self.codes >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            self.zeros[depth] = np.concatenate([[0], np.cumsum(bit == 0)]).astype(np.int32)
        z = self.zeros[depth]
        return lo + z[hi] - z[lo]

    def run(self, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        stack = [(depth, np.stack([lo, hi, lo, hi, np.zeros(len(lo), np.int64)], axis=1))]
        while stack:
            depth, pairs = stack.pop()
            if len(pairs) > FRONTIER:
                stack += [(depth, pairs[FRONTIER:]), (depth, pairs[:FRONTIER])]
                continue
            a, b, c, d, _ = pairs.T
            one = (self.turns[b - 1] == self.turns[a]) & (self.turns[d - 1] == self.turns[c]) & (self.label[a] == self.label[c])
            pairs = pairs[~one]
            if not len(pairs):
                continue
            a, b, c, d, bits = pairs.T
            leaf = (b - a) * (d - c) <= (LEAF if depth < BITS else np.inf)
            if leaf.any():
                self.compare(*pairs[leaf].T[:4])
            if leaf.all():
                continue
            a, b, c, d, bits = pairs[~leaf].T
            m, n = self.middle(a, b, depth), self.middle(c, d, depth)
            own = a == c
            children = [
                np.stack([a, m, n, d, bits + 1], axis=1),
                np.stack([m, b, c, n, bits + 1], axis=1)[~own],
                np.stack([m, b, n, d, bits], axis=1),
                np.stack([a, m, c, n, bits], axis=1),
            ]
            for p in children:  # the last are taken first: equal bits join classes early
                p = p[(p[:, 0] < p[:, 1]) & (p[:, 2] < p[:, 3]) & (p[:, 4] <= self.budget)]
                if len(p):
                    stack.append((depth + 1, p))
        return self.label

    def compare(self, a, b, c, d) -> None:
        n, across = (b - a) * (d - c), d - c
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        across = np.repeat(across, n)
        i, j = np.repeat(a, n) + at // across, np.repeat(c, n) + at % across
        near = (i != j) & (np.bitwise_count(self.codes[i] ^ self.codes[j]) <= self.budget)
        if near.any():
            self.link(i[near], j[near])


def join_nodes(budget: int, depth: int):
    def join(t: pa.Table) -> pa.RecordBatch:
        keys = np.stack([t.column(c).to_numpy() for c in ("turn", "node", "one", "two")], axis=1)
        fp = t.column("fp").to_numpy()
        new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]])
        at = np.flatnonzero(new)
        trie = TrieJoin(t.column("code").to_numpy().view(np.uint64), budget)
        many = np.diff(at) > 1
        label = trie.run(at[:-1][many], at[1:][many], depth)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[label[linked]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows > BUFFER:  # the last node may go on in the next batch
                t = pa.Table.from_batches(held)
                key = np.stack([t.column(c).to_numpy() for c in ("turn", "node", "one", "two")], axis=1)
                cut = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1] + 1) if (key != key[-1]).any() else 0
                if cut:
                    yield join(t.slice(0, cut).combine_chunks())
                held = t.slice(cut).to_batches()
                rows = t.num_rows - cut
        if held:
            yield join(pa.Table.from_batches(held).combine_chunks())

    return run


def hamming_links(codes: DataFrame, budget: int = 3) -> DataFrame:
    """Edges (u, v) between distinct fingerprints `fp` that connect whatever links within `budget` bits connect.

    A pair within the budget agrees on one of budget + 1 blocks of bits. So the self-join runs on
    that many tries, the k-th with block k in front: on its levels unlike children are
    beyond the budget, and the trie falls into nodes that tasks join on their own, going down the
    remaining bits with the whole budget. A node gives a spanning forest of its links, never
    all pairs. A node of more than NODE codes is cut into parts, and each pair of parts is a task.
    """
    blocks = budget + 1
    width = BITS // blocks
    turned = codes.select("fp", F.explode(F.array(*[F.lit(k) for k in range(blocks)])).alias("turn"))
    shift = (F.col("turn") * width).cast("int")
    code = F.when(shift == 0, F.col("fp")).otherwise(F.expr(f"shiftleft(fp, turn * {width}) | shiftrightunsigned(fp, {BITS} - turn * {width})"))
    turned = turned.withColumn("code", code).withColumn("node", F.shiftrightunsigned("code", BITS - width))
    large = materialize(turned.groupBy("turn", "node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > NODE))
    one = two = F.lit(0).cast("long")
    if not large.isEmpty():
        parts = F.ceil(F.col("n") / (NODE // 2))
        part = F.pmod(F.xxhash64("fp"), F.coalesce(parts, F.lit(1)))
        turned = turned.join(large, ["turn", "node"], "left").withColumn("part", part)
        turned = turned.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(parts, F.lit(1)) - 1)))
        one, two = F.least("part", "other"), F.greatest("part", "other")
    turned = turned.select("turn", "node", one.alias("one"), two.alias("two"), "code", "fp")
    keys = ["turn", "node", "one", "two"]
    return turned.repartition(*keys).sortWithinPartitions(*keys, "code").mapInArrow(join_nodes(budget, width), "u long, v long")


def near_duplicate_classes(docs: DataFrame, shingle: int = 3, budget: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, hash, fp, component_id, first_id, first_hash).

    Documents are linked if their fingerprints differ in at most `budget` bits, and are of one
    class if links connect them; component_id is the class's smallest id (nulls aside), first_id and
    first_hash the row that stands for it. Equal fingerprints, however many, are one code in
    the join. Texts of fewer words than a shingle are one shingle; null and wordless texts
    have fingerprint 0 and are linked like any other. An empty table gives no rows; other columns are ignored.
    """
    rows = materialize(fingerprints(docs, shingle, id_col, text_col))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("first")
    codes = materialize(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), first))
    linked = materialize(components(hamming_links(codes.select("fp"), budget)))
    rooted = codes.join(linked.withColumnRenamed("u", "fp"), "fp", "left")
    rooted = materialize(rooted.withColumn("root", F.coalesce("root", "fp")))
    classes = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("codes"), F.min("first").alias("class_first"))
    table = join_by_key(rooted.select("fp", "n", "root"), materialize(classes), "root", "codes", rooted.count())
    table = materialize(table.select("fp", "n", "class_first"))
    out = join_by_key(rows, table, "fp", "n", rows.count())
    return out.select(
        "id", "hash", "fp", F.col("class_first.id").alias("component_id"), F.col("class_first.id").alias("first_id"), F.col("class_first.hash").alias("first_hash")
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row of each class with all its columns; rows that repeat id and text count once."""
    classes = near_duplicate_classes(docs, shingle, budget, id_col, text_col)
    stay = (F.col("id").eqNullSafe(F.col("first_id"))) & (F.col("hash") == F.col("first_hash"))
    kept = classes.where(stay).select(row_key("id", F.col("hash")).alias("_key"))
    single = docs.withColumn("_key", row_key(id_col, F.xxhash64(text_col))).dropDuplicates(["_key"])
    return single.join(kept, "_key", "left_semi").drop("_key")
