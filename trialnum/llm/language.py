"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialnum.llm.quality import held_out

ORDER = 3
START = b"\n" * ORDER
CHUNK = 1 << 20


def folded(text: str | None) -> bytes:
    return START + (text or "").lower().encode("utf-8", "replace")


def grams(raw: bytes) -> np.ndarray:
    """Codes of all runs of ORDER + 1 bytes, the last byte lowest."""
    b = np.frombuffer(raw, np.uint8).astype(np.int64)
    code = np.zeros(max(len(b) - ORDER, 0), np.int64)
    for k in range(ORDER + 1):
        code = code * 256 + b[k : len(b) - ORDER + k]
    return code


class ContextTrees:
    """One byte context tree for each language, down to ORDER bytes, as tables of code lengths.

    A context that had n bytes, q distinct ones, gives a byte seen c times c / (n + q), and escapes
    to its shorter context with q / (n + q); the empty context escapes to 1 / 256. With frozen
    counts the code length of a byte after a context is a constant, so the walk up the tree is done once
    when the model is made. Contexts that a language never saw are those of its shorter one.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts, key=lambda s: s.encode())
        seen = np.unique(np.concatenate([c for c, _ in counts.values()])) if counts else np.zeros(0, np.int64)
        used = np.unique(np.concatenate([(seen >> (8 * k)) & 255 for k in range(ORDER + 1)])) if len(seen) else np.zeros(0, np.int64)
        self.symbol = np.full(256, len(used), np.int64)  # bytes of no training text are one symbol
        self.symbol[used] = np.arange(len(used))
        a = self.width = len(used) + 1
        context = np.unique(self.recode(seen) // a)
        self.node = np.zeros(a**ORDER, np.int32)
        self.node[context] = np.arange(1, len(context) + 1)
        deep = np.zeros((len(context) + 1, a, len(self.langs)), np.float32)
        shallow = np.zeros((a**ORDER, len(self.langs)), np.float32)
        for j, lang in enumerate(self.langs):
            codes, n = counts[lang]
            code = self.recode(codes)
            p = np.full(a, 1 / 256)
            for depth in range(ORDER + 1):
                key, at = np.unique(code % a ** (depth + 1), return_inverse=True)
                c = np.bincount(at, n)
                if depth < ORDER:
                    table = np.zeros(a ** (depth + 1))
                    table[key] = c
                    table = table.reshape(-1, a)
                    p = self.blend(table, np.tile(p, (a if depth else 1, 1)).reshape(table.shape)).ravel()
                else:
                    shallow[:, j] = np.log2(p)
                    rows = self.node[key // a]
                    table = np.zeros((len(context) + 1, a))
                    table[rows, key % a] = c
                    shorter = np.vstack([np.zeros((1, a)), p.reshape(-1, a)[context % a ** (ORDER - 1)]]) if len(context) else np.zeros((1, a))
                    deep[:, :, j] = np.log2(np.maximum(self.blend(table, shorter), 1e-30))
        self.deep = deep.reshape((len(context) + 1) * a, len(self.langs))
        self.shallow = shallow

    @staticmethod
    def blend(table: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        n, q = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(n > 0, (table + q * shorter) / (n + q), shorter)

    def recode(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes), np.int64)
        for k in range(ORDER, -1, -1):
            out = out * self.width + self.symbol[(codes >> (8 * k)) & 255]
        return out

    def lengths(self, text: str | None) -> np.ndarray:
        """Bits of the whole text in each language."""
        raw = folded(text)
        total = np.zeros(len(self.langs))
        a = self.width
        for i in range(0, len(raw) - ORDER, CHUNK):
            s = self.symbol[np.frombuffer(raw[i : i + CHUNK + ORDER], np.uint8)]
            context = (s[:-3] * a + s[1:-2]) * a + s[2:-1]
            node = self.node[context].astype(np.int64)
            known = node > 0
            total -= self.deep[node[known] * a + s[3:][known]].sum(0, dtype=np.float64)
            if not known.all():
                total -= self.shallow[(context % (a * a) * a + s[3:])[~known]].sum(0, dtype=np.float64)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not any(map(str.isalpha, text or "")):
            return "und", 0.0
        bits = self.lengths(text)
        best = int(np.argmin(bits))
        return self.langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())


def gram_counts(docs: DataFrame, most: int, id_col: str, text_col: str, lang_col: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Counts of byte runs by language, over about `most` documents of each: those with the smallest hash of their id."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    sizes = rows.groupBy("lang").count().collect()
    if not sizes:
        return {}
    bound = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, most / r["count"]))])
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < bound[F.col("lang")] * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(folded(text))
            for lang, texts in by.items():
                for i in range(0, len(texts), 200):
                    code, n = np.unique(np.concatenate([grams(t) for t in texts[i : i + 200]]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counted = some.select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    t = counted.toArrow()
    lang, gram, n = t.column("lang").to_numpy(zero_copy_only=False), t.column("gram").to_numpy(), t.column("n").to_numpy()
    return {r["lang"]: (gram[lang == r["lang"]], n[lang == r["lang"]].astype(float)) for r in sizes if (lang == r["lang"]).any()}


def identify_languages(docs: DataFrame, most: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: (id, held_out, lang_pred, score).

    Learns from `most` or so documents of each language outside the held-out ids; a text's language
    is that of its shortest code (the first in code point order among equals), and its score that language's
    share if the code lengths are chances. Bytes are those of the lower-case text.

    Null texts and texts without a letter are `und` with score 0, and so is everything if there is
    nothing to learn from. Repeated rows are predicted each; an empty table gives no rows; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(ContextTrees(gram_counts(docs, most, id_col, text_col, lang_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.predict(t) for t in batch.column(2).to_pylist()]
            columns = [pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double")
