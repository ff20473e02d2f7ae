"""Language-model score by prediction by partial matching (PPM) over bytes.

The trie of byte contexts is a set of tables, one per order: (context and symbol, count).
A symbol is coded in its longest context in which training saw it; contexts in between code
an escape (method C: as often as the context has distinct symbols), and symbols that a
longer context has ruled out are excluded from the shorter ones.

Since the symbols seen after a context are also seen after its suffixes, the code length of
a symbol depends on the last ``ORDER`` bytes alone. It is computed once per distinct gram of
the corpus and looked up by position. Texts are dealt into chunks; each chunk sends its
distinct grams and words once, and gets their values back, so neither rows per position nor
the whole model ever move to one place.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.batches import LOWER, Texts, U, slices, words
from corpuslab.session import materialize

ORDER = 4
START, END = 0xFE, 0xFF  # bytes that UTF-8 text never holds
SYMBOLS = 257  # all bytes and the end, which borrows the number of a byte that UTF-8 never holds
HELD_OUT_OF = 10
SMOOTHING = 0.1
CHUNK_BYTES = 32 << 20
END_WORD = U(0x5851F42D4C957F2D)
GRAM, WORD = 0, 1


def grams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every text and its end: the ORDER bytes before and itself, in one number.

    Also where the grams of each text begin, and their total.
    """
    n_rows = len(texts)
    size = np.diff(texts.offsets)
    whole = np.full(len(texts.data) + n_rows * (ORDER + 1), START, np.uint8)
    shift = np.repeat(np.arange(n_rows) * (ORDER + 1) + ORDER, size)
    whole[np.arange(len(texts.data)) + shift] = LOWER[texts.data]
    ends = texts.offsets[1:] + (np.arange(n_rows) + 1) * (ORDER + 1) - 1
    whole[ends] = END
    wide = whole.astype(np.uint64)
    packed = wide[ORDER:].copy()
    for j in range(1, ORDER + 1):
        packed |= wide[ORDER - j:len(wide) - j] << U(8 * j)
    keep = np.ones(len(packed), bool)
    inner = ends[:-1] + 1 - ORDER
    for j in range(ORDER):
        keep[inner + j] = False
    first = np.concatenate([[0], np.cumsum(size + 1)])
    return packed[keep], first


def _counted(values: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the sum of their weights."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(values) else np.zeros(0, int)
    sums = np.add.reduceat(weight[order], begins) if len(values) else weight
    return ordered[begins], sums


def _distinct(values: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with their number in training rows."""
    seen, inverse = np.unique(values[trained], return_counts=True)
    rest = np.unique(values[~trained])
    rest = rest[~np.isin(rest, seen, assume_unique=True)]
    return np.concatenate([seen, rest]), np.concatenate([inverse, np.zeros(len(rest), np.int64)])


def held_out(id_text: str | None) -> bool:
    return zlib.crc32((id_text or "").encode()) % HELD_OUT_OF == 0


_CHUNKED = "chunk string, id {id}, id_text string, text string, kind int, keys array<bigint>, counts array<bigint>"


def chunked(rows: DataFrame) -> DataFrame:
    """Rows (id, id_text, text) dealt into chunks, with each chunk's distinct grams and words."""
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size = TaskContext.get().partitionId(), 0, 0
        found: dict[int, list] = {GRAM: [], WORD: []}
        types: list[pa.DataType] = []

        def close() -> Iterator[pa.RecordBatch]:
            for kind, pieces in found.items():
                keys, counts = _counted(np.concatenate([k for k, _ in pieces]), np.concatenate([c for _, c in pieces]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{part}-{number}"]), pa.nulls(1, types[0]), pa.nulls(1, pa.string()),
                     pa.nulls(1, pa.string()), pa.array([kind], pa.int32()),
                     pa.array([keys.view(np.int64)], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))],
                    names=["chunk", "id", "id_text", "text", "kind", "keys", "counts"])
                pieces.clear()

        for batch in batches:
            types = [batch.schema.field("id").type]
            trained_rows = np.array([not held_out(x) for x in batch.column("id_text").to_pylist()], bool)
            for texts in slices(batch.column("text")):
                n, own = len(texts), batch.slice(texts.first, len(texts))
                trained = trained_rows[texts.first:texts.first + n]
                packed, first = grams(texts)
                found[GRAM].append(_distinct(packed, np.repeat(trained, np.diff(first))))
                w = words(texts)
                value = np.concatenate([w.hash, np.full(n, END_WORD)])
                found[WORD].append(_distinct(value, np.concatenate([trained[w.row], trained])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{part}-{number}"] * n), own.column("id"), own.column("id_text"), own.column("text"),
                     pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))],
                    names=["chunk", "id", "id_text", "text", "kind", "keys", "counts"])
                size += len(texts.data)
                if size >= CHUNK_BYTES:
                    yield from close()
                    number, size = number + 1, 0
        if found[GRAM]:
            yield from close()

    return rows.select("id", "id_text", "text").mapInArrow(run, _CHUNKED.format(id=id_type))


def _bytes(n: int) -> int:
    return (1 << (8 * n)) - 1


def _suffix(c: str | Column, n: int) -> Column:
    """The last n bytes."""
    c = F.col(c) if isinstance(c, str) else c
    return c.bitwiseAND(F.lit(_bytes(n)).cast("long"))


def gram_values(counts: DataFrame) -> DataFrame:
    """(key, value): log10 probability of each gram's last byte after the bytes before it.

    ``counts`` has (key, n) for every gram of the corpus; n = 0 where training lacks it. At each
    order a context has at most 257 symbols, so no join key is hot.
    """
    trie = [counts.where("n > 0")]  # [ORDER - k] has order k: (key, n)
    for k in range(ORDER - 1, -1, -1):
        trie.append(materialize(trie[-1].groupBy(_suffix("key", k + 1).alias("key")).agg(F.sum("n").alias("n")), "ppm-order"))
    trie.reverse()
    contexts = [t.groupBy(F.shiftright("key", 8).alias("context")).agg(
        F.sum("n").alias("total"), F.count("*").alias("symbols")) for t in trie]
    seen = trie[ORDER].withColumn("context", F.shiftright("key", 8)).join(contexts[ORDER], "context").select(
        "key", F.log10(F.col("n") / (F.col("total") + F.col("symbols"))).alias("value"))
    done = [seen]
    open_ = materialize(counts.where("n = 0").select(
        "key", F.lit(0.0).alias("value"), F.lit(0).cast("long").alias("out_total"), F.lit(0).cast("long").alias("out_symbols")),
        "ppm-open")
    for k in range(ORDER, -1, -1):
        here = open_.withColumn("context", F.shiftright(_suffix("key", k + 1), 8))
        used = here.select("context").distinct()
        stats = contexts[k].join(used, "context", "left_semi")
        if k:  # what this context rules out of the next shorter one
            branch = trie[k].withColumn("context", F.shiftright("key", 8)).join(used, "context", "left_semi")
            shorter = trie[k - 1].withColumnsRenamed({"key": "short", "n": "short_n"})
            excluded = branch.withColumn("short", _suffix("key", k)).join(shorter, "short").groupBy("context").agg(
                F.sum("short_n").alias("next_total"))
            stats = stats.join(excluded, "context")
        else:
            stats = stats.withColumn("next_total", F.lit(0).cast("long"))
        own = trie[k].withColumnsRenamed({"key": "own", "n": "own_n"})
        left_total, left_symbols = F.col("total") - F.col("out_total"), F.col("symbols") - F.col("out_symbols")
        room = left_total + left_symbols
        step = here.join(stats, "context", "left").join(own, _suffix("key", k + 1) == F.col("own"), "left").select(
            "key", "own_n", F.col("value").alias("before"),
            F.when(F.col("own_n").isNotNull(), F.col("value") + F.log10(F.col("own_n") / room))
            .when(left_symbols > 0, F.col("value") + F.log10(left_symbols / room)).otherwise(F.col("value")).alias("value"),
            F.coalesce("next_total", "out_total").alias("out_total"), F.coalesce("symbols", "out_symbols").alias("out_symbols"))
        step = materialize(step, "ppm-open")
        done.append(step.where("own_n is not null").select("key", "value"))
        open_ = step.where("own_n is null").select("key", "value", "out_total", "out_symbols")
    done.append(open_.select("key", (F.col("value") - F.log10(F.lit(SYMBOLS) - F.col("out_symbols"))).alias("value")))
    values = done[0]
    for more in done[1:]:
        values = values.unionByName(more)
    return values


class _Lookup:
    """Values by 64-bit key: one probe of a hashed table, binary search where slots clash."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        bits = max(int(len(keys) * 4).bit_length(), 8)
        self.shift = U(64 - bits)
        self.slots = np.zeros(1 << bits, np.int32)
        self.slots[self._slot(self.keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * U(0x9E3779B97F4A7C15)) >> self.shift

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(keys)]
        miss = np.flatnonzero(self.keys[at] != keys)
        if len(miss):
            at[miss] = np.searchsorted(self.keys, keys[miss])
        return self.values[at]


def score(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    Rows whose id, as text, has a CRC-32 divisible by ten are held out; all others train. Null
    ids count as empty text, null texts as empty (one token, the end). ``base_score`` is
    the smoothed word-frequency score, ``score`` the PPM model's log10 probability of the
    lower-cased bytes and the end. Repeated rows train and score as often as they occur;
    without training rows all symbols are equally likely; an empty table gives no rows.
    """
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id_text"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    chunks = materialize(chunked(rows), "ppm-chunks")
    entries = chunks.where("kind is not null").select(
        "chunk", "kind", F.explode(F.arrays_zip("keys", "counts")).alias("e")).select(
        "chunk", "kind", F.col("e.keys").alias("key"), F.col("e.counts").alias("n"))
    counts = materialize(entries.groupBy("kind", "key").agg(F.sum("n").alias("n")), "ppm-counts")
    vocabulary = counts.where((F.col("kind") == WORD) & (F.col("n") > 0)).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, room = vocabulary.n, vocabulary.n + SMOOTHING * (vocabulary.v + 1)
    unknown = math.log10(SMOOTHING / room)
    values = gram_values(counts.where(f"kind = {GRAM}").select("key", "n")).withColumn("kind", F.lit(GRAM))
    word_values = counts.where(f"kind = {WORD}").select(
        "key", F.when(F.col("n") > 0, F.log10((F.col("n") + SMOOTHING) / room)).otherwise(unknown).alias("value"),
        F.lit(WORD).alias("kind"))
    answers = entries.select("chunk", "kind", "key").join(
        values.unionByName(word_values), ["kind", "key"]).select(
        F.col("chunk").alias("for_chunk"), "kind", "key", "value")
    texts = chunks.where("kind is null").select("chunk", "id", "id_text", "text")
    id_type = rows.schema["id"].dataType.simpleString()

    def run(own: pa.Table, known: pa.Table) -> pa.Table:
        kind = known.column("kind").to_numpy()
        keys = known.column("key").to_numpy().view(np.uint64)
        value = known.column("value").to_numpy()
        look = [_Lookup(keys[kind == k], value[kind == k]) for k in (GRAM, WORD)]
        end = look[WORD].get(np.array([END_WORD]))[0] if own.num_rows else 0.0
        tables = []
        for batch in own.combine_chunks().to_batches():
            for t in slices(batch.column("text")):
                packed, first = grams(t)
                model = np.add.reduceat(look[GRAM].get(packed), first[:-1])
                w = words(t)
                each = look[WORD].get(w.hash) if len(w.hash) else np.zeros(0)
                base = np.bincount(w.row, weights=each, minlength=len(t)) + end
                hit = np.bincount(w.row, weights=each > unknown, minlength=len(t)) + (end > unknown)
                part = batch.slice(t.first, len(t))
                tables.append(pa.table({
                    "id": part.column("id"),
                    "held_out": pa.array([held_out(x) for x in part.column("id_text").to_pylist()], pa.bool_()),
                    "n_tokens": pa.array(np.diff(w.first) + 1, pa.int64()), "n_known": pa.array(hit.astype(np.int64)),
                    "train_tokens": pa.array(np.full(len(t), total, np.int64)), "base_score": pa.array(base),
                    "score": pa.array(model)}))
        return pa.concat_tables(tables)

    schema = (f"id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
              "base_score double, score double")
    return texts.groupBy("chunk").cogroup(answers.groupBy("for_chunk")).applyInArrow(run, schema).withColumnRenamed("id", id)
