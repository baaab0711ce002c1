"""Values of words from a table of any size, along an array of words that a row has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialnum.operators.tables import written

# bytes of words and values that a lookup may send to every task
LOOKUP_BYTES = 64 << 20
# a word that makes up a thousandth of all (list, word) pairs is hot, so there are at most this many
HOT_WORDS = 1000
# words of lists that are looked up together, as many numbers where a word's value is an array
CHUNK_WORDS = 1 << 20


def looked_up(
    df: DataFrame, words: str, table: DataFrame, value: str, default: list, out: str, limit: int = LOOKUP_BYTES
) -> DataFrame:
    """Adds ``out``: along the array ``words``, the values of ``table (token, value)`` one after the other.

    A value is a number or an array as long as ``default``, which stands for words (and nulls) that the table
    does not have. A null array gives an empty one.

    A table of at most ``limit`` bytes goes to all tasks, which look up a batch of rows at once. A larger one
    meets the words of the data by a join: many lists together are a chunk, whose words are looked up once
    each, from a table of them that is written once; the few hot words are joined by broadcast, all others by a shuffle,
    and a chunk's values come back as one row, which is parted into lists, one for all that are equal. Rows themselves move once.
    """
    kind = "int" if all(isinstance(x, int) for x in default) else "double"
    wide = isinstance(table.schema[value].dataType.jsonValue(), dict)
    values = (F.col(value) if wide else F.array(value)).cast(f"array<{kind}>")
    table = table.select("token", values.alias("_value"))
    if limit and table_bytes(table, 8 * len(default)) <= limit:
        return df.withColumn(out, _sent_to_tasks(table, default, kind)(F.col(words)))
    return _joined(df, words, table, F.array(*map(F.lit, default)).cast(f"array<{kind}>"), len(default), out)


def table_bytes(table: DataFrame, width: int) -> int:
    """Bytes of the words of a table, with ``width`` for each value."""
    return table.agg(F.sum(F.octet_length("token") + F.lit(width + 8))).first()[0] or 0


def _sent_to_tasks(table: DataFrame, default: list, kind: str):
    """Arrow UDF over the collected table; all words of a batch are looked up at once."""
    rows = table.collect()
    known = pa.array([r["token"] for r in rows], pa.string())
    width, number = len(default), "int32" if kind == "int" else "float64"
    values = np.empty((len(rows) + 1, width), number)  # the last row is that of unknown words
    if rows:
        values[:-1] = np.array([r["_value"] for r in rows], number).reshape(-1, width)
    values[-1] = default

    @F.arrow_udf(f"array<{kind}>")
    def run(arrays: pa.Array) -> pa.Array:
        at = pc.fill_null(pc.index_in(arrays.flatten(), value_set=known), len(known)).to_numpy()
        lengths = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy()
        offsets = np.concatenate([[0], np.cumsum(lengths)]) * width
        return pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), pa.array(values[at].ravel()))

    return run


def _joined(df: DataFrame, words: str, table: DataFrame, default, width: int, out: str) -> DataFrame:
    keyed = df.withColumn("_key", F.unhex(F.sha2(F.to_json(words), 256)))
    lists = keyed.where("_key IS NOT NULL").select(F.monotonically_increasing_id().alias("_chunk"), "_key", F.col(words).alias("_words"))
    each = lists.select("_chunk", F.explode(_chunks(max(1, CHUNK_WORDS // max(1, width)))("_key", "_words")).alias("_p"))
    # written, as the words are counted, met by the hot ones and by all others, and numbers of chunks must not change
    chunks = written(each.select("_chunk", "_p.*"))
    pairs = chunks.where("_keys IS NULL").select("_chunk", "token", "_code")
    counted = pairs.groupBy("token").agg(F.count(F.lit(1)).alias("_lists"))
    mapped = written(counted.join(table, "token", "left").withColumn("_value", F.coalesce("_value", default)))
    total = mapped.agg(F.sum("_lists").alias("_total"))
    hot = mapped.crossJoin(F.broadcast(total)).where(F.col("_lists") * HOT_WORDS >= F.col("_total")).select("token", "_value")
    met = _by_token(pairs, F.broadcast(hot), "inner")
    cold = _by_token(pairs, F.broadcast(hot), "left_anti")
    rest = _by_token(cold, mapped.select("token", "_value"), "inner")
    of, value = F.col("_code"), F.col("_value")
    if width == 1:  # numbers move without their arrays; null is what does not come back
        value = F.get("_value", F.lit(0))
        of = F.when(value.isNotNull(), of)
    found = met.unionByName(rest).groupBy("_chunk").agg(F.collect_list(of).alias("_of"), F.collect_list(value).alias("_values"))
    heads = chunks.where("_keys IS NOT NULL").select("_chunk", F.col("_code").alias("_n"), "_keys", "_sizes", "_codes")
    kind = table.schema["_value"].dataType.simpleString()
    along = heads.join(found, "_chunk").select("_keys", "_sizes", "_n", "_codes", "_of", "_values").mapInArrow(_parted(out), f"_key binary, {out} {kind}")
    back = keyed.join(along.dropDuplicates(["_key"]), "_key", "left").drop("_key")
    return back.withColumn(out, F.coalesce(out, F.array().cast(back.schema[out].dataType)))


def _chunks(most: int):
    """Arrow UDF: the distinct lists of a batch in chunks of ``most`` words, at the first list of each: a row of their keys, sizes and
    the codes of their words one after the other, with the number of codes, then the distinct words of all these lists with their codes."""
    places = _places().func

    @F.arrow_udf("array<struct<token: string, _code: int, _keys: array<binary>, _sizes: array<int>, _codes: binary>>")
    def run(keys: pa.Array, lists: pa.Array) -> pa.Array:
        once = np.sort(np.unique(keys.dictionary_encode().indices.to_numpy(), return_index=True)[1])
        distinct = lists.take(pa.array(once))
        sizes = pc.fill_null(pc.list_value_length(distinct), 0).to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        first = np.flatnonzero(np.diff(ends[:-1] // most, prepend=-1))
        bounds = np.append(first, len(once))
        found = places(pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), distinct.flatten()))
        words = found.value_lengths().to_numpy()
        packed = []
        for chunk, total in zip(found, np.diff(ends[bounds]).tolist(), strict=True):
            at = chunk.values.field("_places")
            codes = np.empty(total, np.min_scalar_type(len(at)))
            codes[at.flatten().to_numpy()] = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy())
            packed.append(pa.compress(codes.tobytes(), "zstd", asbytes=True))
        # a head before the words of a chunk
        rows, number = words + 1, np.arange(len(words))
        chunk = np.repeat(number, rows)
        code = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows) - 1
        is_head = code < 0
        word = pa.array(np.cumsum(~is_head) - 1, mask=is_head)
        chunk = pa.array(chunk, mask=~is_head)
        parts = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), x) for x in (keys.take(pa.array(once)), pa.array(sizes, pa.int32()))]
        heads = [x.take(chunk) for x in (*parts, pa.array(packed, pa.binary()))]
        columns = [found.flatten().field("token").take(word), pa.array(np.where(is_head, np.repeat(words, rows), code), pa.int32()), *heads]
        lengths = np.zeros(len(lists), np.int64)
        lengths[once[first]] = rows
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, ["token", "_code", "_keys", "_sizes", "_codes"]))

    # so that it runs once for all uses of its result
    return run.asNondeterministic()


def _parted(out: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The values of chunks' words, put along their codes and parted into lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys, sizes, of, values = (batch.column(c).slice(row, 1).flatten() for c in (0, 1, 4, 5))
                ends = np.concatenate([[0], np.cumsum(sizes.to_numpy(), dtype=np.int64)])
                n = batch.column(2)[row].as_py()
                kind = np.min_scalar_type(n)
                codes = np.frombuffer(pa.decompress(batch.column(3)[row].as_py(), int(ends[-1]) * kind.itemsize, "zstd", asbytes=True), kind)
                place = np.full(n, -1)
                place[of.to_numpy()] = np.arange(len(of))
                along = values.take(pa.array(place[codes], mask=place[codes] < 0))
                if pa.types.is_list(along.type):
                    ends = np.concatenate([[0], np.cumsum(along.value_lengths().to_numpy(), dtype=np.int64)])[ends]
                    along = along.flatten()
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), along)], names=["_key", out])

    return run


def _places():
    """Arrow UDF: a list's distinct words (null is one), each with its places, for a whole batch at once."""

    @F.arrow_udf("array<struct<token: string, _places: array<int>>>")
    def run(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().dictionary_encode(null_encoding="encode")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        row, code = np.repeat(np.arange(len(sizes)), sizes), flat.indices.to_numpy().astype("int64")
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = row * (len(flat.dictionary) + 1) + code
        order = np.argsort(key, kind="stable")  # places of a word stay in order
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        ends = np.append(first, len(key)).astype("int32")
        places = pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order], pa.int32()))
        tokens = flat.dictionary.take(pa.array(code[order[first]]))
        of_row = np.bincount(row[order[first]], minlength=len(sizes))
        offsets = np.concatenate([[0], np.cumsum(of_row)]).astype("int32")
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([tokens, places], ["token", "_places"]))

    # so that it runs once for all uses of its result
    return run.asNondeterministic()


def _by_token(pairs: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """Joined on the word; nulls are words too."""
    table = table.withColumnRenamed("token", "_token")
    joined = pairs.join(table, F.col("token").eqNullSafe(F.col("_token")), how)
    return joined if how == "left_anti" else joined.drop("_token", "token")
