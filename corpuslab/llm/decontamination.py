"""Benchmark decontamination by spaced seeds.

A mask keeps some positions of a window of words and ignores the others, so a window with
a substitution at an ignored position still hashes alike. Hashes of documents and of
benchmark items meet in a join; an aligned comparison around each hit decides. The masks
leave no pattern of substitutions out that the comparison would accept.

A fixed-size bit table of the benchmark's hashes is sent to all tasks to thin out the
document side before the join; its size does not depend on the benchmark. What it lets
through by chance fails in the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.batches import NOT_ALPHANUMERIC, mix, slices, windows, words
from corpuslab.session import materialize

# Words kept (1) and ignored (0) in each seed, by the item's number of words (the
# last: that many or more). Found by search; every way to replace as many words as the
# threshold allows leaves the kept words of some mask equal (enumerated in the tests).
MASKS = {
    1: ("1",),
    2: ("11",),
    3: ("111",),
    4: ("1111",),
    5: ("1111", "11101", "11011", "10111"),
    6: ("11111", "111101", "111011", "110111", "101111"),
    7: ("11111", "111011", "110111"),
    8: ("111011", "11111"),
    9: ("1111011", "1101111"),
    10: ("111011", "11010011", "11111"),
    11: ("1110111", "111001011", "1011111", "111111"),
    12: ("11101011", "101100111", "111111"),
    13: ("111011011", "11010100111", "1111111", "1111001101", "10110010111", "11101111", "11101100011"),
}
TABLE_BITS = 1 << 24
LEAST_WORDS = 13
LEAST_SHARE = 0.8
LOSS = 4  # equal words that make up for another one: share / (1 - share)


def _places(mask: str) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(mask) if c == "1")


def _seeds(value: np.ndarray, row: np.ndarray, lengths: list[int],
           own: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per mask for items of the given lengths: positions whose window lies in one text, and their hashes.

    ``own`` has the length of each text where only its own masks are wanted.
    """
    for length in lengths:
        for m, mask in enumerate(MASKS[length]):
            places = _places(mask)
            found = windows(value, places)
            whole = row[:len(found)] == row[places[-1]:places[-1] + len(found)]
            if own is not None:
                whole &= own[row[:len(found)]] == length
            at = np.flatnonzero(whole)
            yield at, mix(found[at] + np.uint64(16 * length + m))


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(TABLE_BITS - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int64)))


_SEEDED = "key string, words array<bigint>, hashes array<bigint>, places array<bigint>"


def _seeded(rows: DataFrame, table: np.ndarray | None, lengths: list[int]) -> DataFrame:
    """Texts with seeds as (key, words, hashes, places).

    With a bit table: seeds in it, of the masks for all lengths; without: of the masks for
    the text's own length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text")):
                w = words(texts, NOT_ALPHANUMERIC)
                n_words = np.diff(w.first)
                own = np.minimum(n_words, LEAST_WORDS) if table is None else None
                at, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for places, found in _seeds(w.hash, w.row, lengths, own):
                    if table is not None:
                        a, b = _bits(found)
                        hit = table[a] & table[b]
                        places, found = places[hit], found[hit]
                    at.append(places)
                    hashes.append(found)
                at, hashes = np.concatenate(at), np.concatenate(hashes)
                order = np.argsort(at, kind="stable")
                at, hashes = at[order], hashes[order]
                per_row = np.bincount(w.row[at], minlength=len(texts))
                hit = np.flatnonzero(per_row)
                if len(hit) == 0:
                    continue
                chosen = np.isin(w.row, hit)
                keys = batch.column("key").take(pa.array(hit + texts.first))
                yield pa.RecordBatch.from_arrays(
                    [keys, _lists(w.hash[chosen].view(np.int64), n_words[hit]),
                     _lists(hashes.view(np.int64), per_row[hit]),
                     _lists(at - w.first[w.row[at]], per_row[hit])],
                    names=["key", "words", "hashes", "places"])

    return rows.select("key", "text").mapInArrow(run, _SEEDED)


def _bit_table(seeds: DataFrame) -> np.ndarray:
    """The benchmark's bit table, combined on the executors; TABLE_BITS / 64 numbers at most."""
    mask = F.lit(TABLE_BITS - 1).cast("long")
    low, high = F.col("hash").bitwiseAND(mask), F.shiftrightunsigned("hash", 32).bitwiseAND(mask)
    bits = seeds.select(F.explode(F.array(low, high)).alias("bit"))
    cells = bits.groupBy(F.shiftright("bit", 6).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("value")).collect()
    table = np.zeros(TABLE_BITS // 64, np.uint64)
    for c in cells:
        table[c.cell] = np.uint64(c.value & 0xFFFFFFFFFFFFFFFF)
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)


def best_overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(equal words, span, first word in doc) of the best stretch where doc[i + shift] = item[i].

    Only stretches of ``LEAST_WORDS`` item words (or all of a shorter item) and at least
    ``LEAST_SHARE`` equal count; (0, 0, 0) if there is none. Item words that lie before or
    after the document are not equal. The best one gains most, where an equal word gains one
    and another loses so much that a share of exactly ``LEAST_SHARE`` gives zero.
    """
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    least = min(LEAST_WORDS, len(item))
    if high <= low:
        return 0, 0, 0
    same = np.zeros(len(item), bool)
    same[low:high] = doc[low + shift:high + shift] == item[low:high]
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -LOSS))])  # whole numbers: exact at the threshold
    lowest = np.minimum.accumulate(total[:len(total) - least])
    rise = total[least:] - lowest
    found = int(np.argmax(rise))
    if rise[found] < 0:
        return 0, 0, 0
    begin = int(np.flatnonzero(total[:found + 1] == lowest[found])[-1])
    end = found + least
    return int(same[begin:end].sum()), end - begin, max(begin + shift, 0)


_OVERLAP = "key string, item string, n_equal bigint, n_span bigint, first_word bigint"


def _verified(candidates: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, item, shift, doc, words_ in zip(*(batch.column(n) for n in (
                    "key", "item", "shift", "words", "item_words"))):
                doc, words_ = doc.values.to_numpy(), words_.values.to_numpy()
                equal, span, first = best_overlap(doc, words_, shift.as_py())
                if equal:
                    rows.append((key.as_py(), item.as_py(), equal, span, first))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), *[pa.int64()] * 3))],
                    names=["key", "item", "n_equal", "n_span", "first_word"])

    return candidates.select("key", "item", "shift", "words", "item_words").mapInArrow(run, _OVERLAP)


def text_key(text: str):
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """Verified overlaps of distinct texts: (key, item, n_equal, n_span, first_word).

    ``key`` and ``item`` are the MD5 of the document's and the item's text. One row per pair
    of texts that share an aligned stretch of at least 13 words (or the whole item, if it
    is shorter), at least 80 % of them equal. Item words beyond either
    end of the document are not equal. Words are runs of letters and digits, case ignored. Null, empty or wordless texts, and empty tables, give
    no rows; repeated rows and ties change nothing, as only distinct texts are compared.
    """
    items = benchmark.select(text_key(item_text).alias("key"), F.col(item_text).alias("text")).dropDuplicates(["key"])
    items = materialize(_seeded(items, None, list(MASKS)), "benchmark-seeds")
    n_words = F.least(F.size("words"), F.lit(LEAST_WORDS))
    lengths = sorted(r[0] for r in items.select(n_words).distinct().collect())  # 13 at most
    item_seeds = items.select(F.col("key").alias("item"), F.explode(F.arrays_zip("hashes", "places")).alias("s")
                              ).select("item", F.col("s.hashes").alias("hash"), F.col("s.places").alias("item_place"))
    table = _bit_table(item_seeds)
    rows = docs.select(text_key(text).alias("key"), F.col(text).alias("text"))
    hits = materialize(_seeded(rows, table, lengths), "document-seeds")
    once = hits.dropDuplicates(["key"])
    seeds = once.select("key", F.explode(F.arrays_zip("hashes", "places")).alias("s")).select(
        "key", F.col("s.hashes").alias("hash"), F.col("s.places").alias("place"))
    aligned = seeds.join(item_seeds, "hash").select(
        "key", "item", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    candidates = aligned.join(once.select("key", "words"), "key").join(
        items.select(F.col("key").alias("item"), F.col("words").alias("item_words")), "item")
    found = _verified(candidates)
    best = F.max(F.struct("n_equal", -F.col("n_span"), -F.col("first_word"), "n_span", "first_word")).alias("b")
    return found.groupBy("key", "item").agg(best).select(
        "key", "item", "b.n_equal", "b.n_span", "b.first_word")


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Keys of the texts that overlap with some item."""
    return overlaps(docs, benchmark, text).select("key").distinct()


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without rows whose text overlaps with an item; all other rows and columns stay."""
    found = contaminated(docs, benchmark, text).withColumnRenamed("key", "_flagged_key")
    return docs.join(found, text_key(text) == F.col("_flagged_key"), "left_anti")
