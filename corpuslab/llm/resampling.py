"""Importance resampling towards a target corpus, from hashed word runs.

A feature is a run of one to ``most_words`` words, its bucket the CRC-32 of the run's bytes.
Words are not cut out and hashed one by one: an Aho-Corasick automaton over delimiter-bounded
words carries each word's CRC and length, one scan of a text emits them in order, and the CRC
of a longer run is composed from its words' payloads. The dictionary holds words that the
task has met, up to ``DICTIONARY_WORDS``. Words between emitted ones are unknown to it: they
are hashed directly, so results never depend on what the dictionary holds.

Bucket counts run over all texts of both corpora. They are ``n_buckets`` numbers each, so the
gains travel with the tasks. The draw numbers documents by a range sort.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.batches import Texts, slices
from corpuslab.session import materialize

# Buckets, seed of the draw, share drawn, least words.
N_BUCKETS = 10000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20

DICTIONARY_WORDS = 1 << 17
FIRST_WORDS = 1 << 12  # new words after which the automaton is built for the first time
_SPACE = 32
# A-Z to a-z; every other ASCII character that is neither letter nor digit ends a word.
_TIDY = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else _SPACE for b in range(256))


def _shift_tables(n: int) -> np.ndarray:
    """Tables that take a CRC-32 over 2^k zero bytes, for k below ``n``; one row per CRC byte."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1)
    one = np.zeros((4, 256), np.uint32)
    for k in range(4):
        value = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        one[k] = (value >> 8) ^ byte[value & 0xFF]
    tables = [one]
    for _ in range(n - 1):
        last = tables[-1]
        tables.append(np.stack([_through(last, last[k]) for k in range(4)]))
    return np.stack(tables)


def _through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return (table[0][crc & 0xFF] ^ table[1][crc >> 8 & 0xFF] ^ table[2][crc >> 16 & 0xFF] ^ table[3][crc >> 24])


_SHIFTS = _shift_tables(32)


def composed(crc_a: np.ndarray, crc_b: np.ndarray, length_b: np.ndarray) -> np.ndarray:
    """CRC-32 of a followed by b, from the two CRCs and the length of b in bytes."""
    crc = np.asarray(crc_a, np.uint32).copy()
    length = np.asarray(length_b, np.int64)
    for k in range(int(length.max(initial=0)).bit_length()):
        on = (length >> k & 1).astype(bool)
        crc[on] = _through(_SHIFTS[k], crc[on])
    return crc ^ np.asarray(crc_b, np.uint32)


class Dictionary:
    """Words met so far, as an automaton that emits the numbers of their payloads."""

    def __init__(self, most: int = DICTIONARY_WORDS):
        self.most, self.known, self.waiting = most, 0, {}
        self.automaton = None
        self.crc, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def payloads(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, CRC and length of every word of a slice, in order."""
        bodies = [texts.bytes_of(r) for r in range(len(texts))]
        data = (b" " + b" ".join(bodies) + b" ").translate(_TIDY)
        there = np.frombuffer(data, np.uint8) != _SPACE
        start = np.flatnonzero(there[1:] & ~there[:-1]) + 1
        end = np.flatnonzero(there[:-1] & ~there[1:]) + 1
        # texts begin one byte later for each text before them, and for the first space
        row = np.searchsorted(texts.offsets[1:] + np.arange(1, len(texts) + 1), start, side="left")
        crc, length = np.zeros(len(start), np.uint32), end - start
        unknown = np.ones(len(start), bool)
        if self.automaton is not None:
            emitted = np.fromiter(chain.from_iterable(self.automaton.iter(data.decode("latin-1"))), np.int64).reshape(-1, 2)
            at = np.searchsorted(end, emitted[:, 0])  # a match ends at the space after its word
            crc[at] = self.crc[emitted[:, 1]]
            unknown[at] = False
        at = np.flatnonzero(unknown)
        if len(at):
            found = [data[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]
            crc[at] = np.fromiter(map(zlib.crc32, found), np.uint32, len(found))
            self._learn(found)
        return row, crc, length

    def _learn(self, words: list[bytes]) -> None:
        """Take unknown words up; the automaton is built again when there are twice as many."""
        if self.known >= self.most:
            return
        self.waiting.update(dict.fromkeys(words))
        if len(self.waiting) < max(FIRST_WORDS, self.known):
            return
        import ahocorasick

        if self.automaton is None:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        new = list(self.waiting)[:self.most - self.known]
        for k, word in enumerate(new, start=self.known):
            self.automaton.add_word(f" {word.decode('latin-1')} ", k)
        self.automaton.make_automaton()
        self.crc = np.concatenate([self.crc, np.fromiter(map(zlib.crc32, new), np.uint32, len(new))])
        self.known, self.waiting = self.known + len(new), {}


def _runs(row: np.ndarray, crc: np.ndarray, length: np.ndarray, most_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and CRC of all runs of one to ``most_words`` words of the same row."""
    rows, crcs = [row], [crc]
    last = crc
    for n in range(2, most_words + 1):
        # the run of n - 1 words, a space, and the word after it
        spaced = composed(last[:len(row) - n + 1], np.full(max(len(row) - n + 1, 0), zlib.crc32(b" "), np.uint32),
                          np.ones(max(len(row) - n + 1, 0), np.int64))
        last = composed(spaced, crc[n - 1:], length[n - 1:])
        whole = row[:len(last)] == row[n - 1:]
        rows.append(row[:len(last)][whole])
        crcs.append(last[whole])
    return np.concatenate(rows), np.concatenate(crcs)


def bucketed(docs: DataFrame, text: str = "text", id: str | None = "doc_id", most_words: int = 1,
             n_buckets: int = N_BUCKETS, dictionary_words: int = DICTIONARY_WORDS) -> DataFrame:
    """(id, n_words, buckets) of each text: the bucket of every feature, repeats counted.

    Null texts have no words. A task holds its dictionary and a slice of texts.
    """
    id_type = docs.schema[id].dataType.simpleString() if id else "int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Dictionary(dictionary_words)
        for batch in batches:
            for texts in slices(batch.column("text")):
                row, crc, length = known.payloads(texts)
                n_words = np.bincount(row, minlength=len(texts))
                row, crc = _runs(row, crc, length, most_words)
                if most_words > 1:
                    order = np.argsort(row, kind="stable")
                    row, crc = row[order], crc[order]
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]).astype(np.int32)
                buckets = pa.ListArray.from_arrays(pa.array(ends), pa.array((crc % n_buckets).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(texts.first, len(texts)), pa.array(n_words.astype(np.int64)), buckets],
                    names=["id", "n_words", "buckets"])

    rows = docs.select((F.col(id) if id else F.lit(None).cast("int")).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, n_words long, buckets array<int>")


def bucket_counts(features: DataFrame) -> DataFrame:
    """(bucket, n) over all texts of :func:`bucketed`."""
    return features.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(source: DataFrame, target: DataFrame, n_buckets: int = N_BUCKETS) -> np.ndarray:
    """Thousandths of log-likelihood that a feature of each bucket gains, from two count tables."""
    counts = source.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full").collect()
    s, t = np.zeros(n_buckets), np.zeros(n_buckets)
    for r in counts:  # at most n_buckets rows
        s[r.bucket], t[r.bucket] = r.s or 0, r.t or 0
    over, under = (t + 1) * (s.sum() + n_buckets), (s + 1) * (t.sum() + n_buckets)
    return np.array([math.floor(1000 * math.log(x)) for x in over / under], np.int64)


def weighted(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight): the sum of gains over each text's features, 0 for none."""
    id_type = features.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            sums = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy()])])
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_words"), pa.array(np.diff(ends).astype(np.int64)),
                 pa.array(sums[ends[1:]] - sums[ends[:-1]])], names=["id", "n_words", "n_features", "weight"])

    return features.mapInArrow(run, f"id {id_type}, n_words long, n_features long, weight long")


def noise(id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the id; a null id counts as empty."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(rows: DataFrame, share: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rows`` with ``rank``, 1 for the highest score, of the drawn ones; null for the others.

    Drawn are ``share`` per cent, rounded down, of the rows with enough words; ties go to the
    smaller id, null ids last, repeated rows in any order. Ranks come from a range sort: the
    place in the partition plus the rows of the partitions before it.
    """
    enough = F.col("n_words") >= least_words
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "scored")
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("_row")]
    placed = rows.where(enough).repartitionByRange(*order).sortWithinPartitions(*order)
    # the lower 33 bits number the rows of a partition, the upper ones the partitions
    placed = materialize(placed.withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33).cast("int")
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    total, before = 0, []
    for p, n in sizes:  # one number per task that wrote
        before.append((p, total))
        total += n
    first = rows.sparkSession.createDataFrame(before, "_part int, _before long")
    placed = placed.withColumn("_part", part).join(F.broadcast(first), "_part")
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    drawn = share * total // 100
    kept = [c for c in rows.columns if c != "_row"]
    found = placed.select(*kept, F.when(rank <= drawn, rank).alias("rank"))
    return found.unionByName(rows.where(F.coalesce(~enough, F.lit(True))).select(*kept, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, targets: DataFrame, text: str = "text", id: str = "doc_id", target_text: str = "text",
              most_words: int = 1, n_buckets: int = N_BUCKETS, share: int = PERCENT,
              least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of each document; drawn ones have a rank.

    ``weight`` says how much likelier a text is under the target corpus than under the
    documents, ``score`` adds noise that depends on the id alone, so the highest scores are a
    sample without replacement in proportion to the weights. Null texts count as empty, null
    ids as an empty id, repeated rows stay repeated; other columns are not read. Empty tables
    give no rows, or gains from the documents alone.
    """
    own = materialize(bucketed(docs, text, id, most_words, n_buckets), "buckets")
    theirs = bucketed(targets, target_text, None, most_words, n_buckets)
    gain = gains(bucket_counts(own), bucket_counts(theirs), n_buckets)
    rows = weighted(own, gain).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    return ranked(rows, share, least_words)


def drawn(docs: DataFrame, targets: DataFrame, id: str = "doc_id", **settings) -> DataFrame:
    """The drawn documents, with their own columns. Rows are found by id, so ids should be unique."""
    chosen = resampled(docs, targets, id=id, **settings).where("rank is not null").select(F.col("id").alias("_drawn_id"))
    return docs.join(chosen, F.col(f"`{id}`").eqNullSafe(F.col("_drawn_id")), "left_semi")
