"""Quality classifier by co-training on two views of a document.

The text view sees words and word shapes; the metadata view sees language, source, length
and layout. Both start from labelled documents. In each round a view labels the unlabelled
documents it is surest of, for the other view to learn from. Both are then calibrated on
labelled documents kept aside, and their log odds are added.

The labelled sample is bounded: the ``LABELLED`` documents whose hashed ids are smallest, fitted on
the driver. The unlabelled pool is every row without a label. Its features are stored once; in each
round executors count its log odds in bins, which gives the thresholds of the surest, and
add up the slopes of those documents' losses. Only bins and slopes, whose number is fixed, reach the
driver. Rows in the bin where a threshold falls share what is left in equal parts, so ties and
repeated rows need no order. The lessons of a round weigh ``TRUST`` of the labelled documents at
every size of the pool.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.batches import Texts, U, slices, words
from corpuslab.operators.joins import lookup_join
from corpuslab.session import materialize, scratch_scope

LABELLED = 4096
WORD_SLOTS = 1 << 14
SHAPE_SLOTS = 1 << 10
META_SLOTS = 256
ROUNDS = 4
PER_ROUND = 0.05  # of the unlabelled documents, per view and round
TRUST = 0.25  # weight of all pseudo-labels of a round against that of the labelled documents
STEPS = 8  # of the fit in each round
BINS, REACH = 8192, 40.0  # of log odds, from -REACH to REACH
FIXED = 1 << 24  # slopes are added as whole numbers of this fraction, in any order alike
KEPT_ASIDE = 0.25
CELLS = 1 << 20  # stored slots worked on at a time
HEADS = ("quality", "toxic")

_KIND = np.full(256, 7, np.uint8)  # other signs
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[128:] = 4
_KIND[np.frombuffer(b".,;:'\"()-", np.uint8)] = 5
_KIND[np.frombuffer(b"!?", np.uint8)] = 6


def _text_view(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of hashed words and shapes; each row's values have length one."""
    w = words(texts)
    slot = (w.hash % U(WORD_SLOTS)).astype(np.int64)
    kind = _KIND[texts.data].astype(np.int64)
    inner = np.maximum(w.end - 2, w.start)
    shape = kind[w.start] * 64 + kind[inner] * 8 + kind[w.end - 1] if len(w.start) else slot
    slot = np.concatenate([slot, WORD_SLOTS + shape % SHAPE_SLOTS])
    row = np.concatenate([w.row, w.row])
    width = WORD_SLOTS + SHAPE_SLOTS
    cell, count = np.unique(row * width + slot, return_counts=True)
    row, slot, value = cell // width, cell % width, np.log1p(count)
    norm = np.sqrt(np.bincount(row, weights=value * value, minlength=len(texts)))
    return row, slot, value / norm[row]


def _step(x: np.ndarray, size: float, most: int) -> np.ndarray:
    return np.clip(np.floor(x / size), 0, most - 1).astype(np.int64)


def _meta_view(texts: Texts, languages: list, sources: list, sizes: list) -> np.ndarray:
    """Slots that are on, one per measure: language, source, length and layout in steps."""
    n = len(texts)
    w = words(texts)
    n_words = np.maximum(np.diff(w.first), 1)
    n_bytes = np.maximum(np.diff(texts.offsets), 1)

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[texts.offsets[1:]] - total[texts.offsets[:-1]]

    kind = _KIND[texts.data]
    lines = per_row(texts.data == 10) + 1
    measures = [
        _step(np.log2(n_words + 1.0), 1, 16), _step(np.log2(lines + 0.0), 1, 16),
        _step(np.log2(n_bytes / lines + 1), 1, 16), _step(n_bytes / n_words, 1, 16),
        _step(per_row(kind == 2) / n_bytes, 0.05, 16), _step(per_row(kind == 7) / n_bytes, 0.03, 16),
        _step(per_row(kind == 6) / n_bytes, 0.03, 16),
        np.array([zlib.crc32(str(x).encode()) % 16 for x in languages]),
        _step(np.log2(np.array([float(x or 0) for x in sizes]) + 1), 1, 16)]
    slots = [16 * k + m for k, m in enumerate(measures)]
    slots.append(16 * len(measures) + np.array([zlib.crc32(str(x).encode()) % 64 for x in sources]))
    return np.stack(slots, axis=1).reshape(n, -1)


_META_WIDTH = 10


@dataclass
class _Rows:
    """Sparse rows of one view."""

    start: np.ndarray
    slot: np.ndarray
    value: np.ndarray
    width: int

    def take(self, rows: np.ndarray) -> "_Rows":
        size = np.diff(self.start)[rows]
        start = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(start[-1]) - np.repeat(start[:-1] - self.start[rows], size)
        return _Rows(start, self.slot[at], self.value[at], self.width)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.value * weights[self.slot])])
        return total[self.start[1:]] - total[self.start[:-1]] + weights[self.width]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _slopes(rows: _Rows, error: np.ndarray) -> np.ndarray:
    """Sum of each slot's value times its row's error, the constant last."""
    owner = np.repeat(np.arange(len(error)), np.diff(rows.start))
    sums = np.bincount(rows.slot, weights=rows.value * error[owner], minlength=rows.width)
    return np.concatenate([sums, [error.sum()]])


def _logistic(rows: _Rows, y: np.ndarray, weights: np.ndarray, steps: int = 80, rate: float = 0.3) -> np.ndarray:
    """Logistic regression by Adam from the given weights, lightly regularised."""
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, steps + 1):
        slope = _slopes(rows, _sigmoid(rows.dot(weights)) - y) / max(len(y), 1)
        slope[:-1] += 1e-5 * weights[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        weights = weights - rate * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.99 ** t)) + 1e-9)
    return weights


class _Descent:
    """Accelerated gradient descent; slopes are taken at ``ahead``.

    The loss of a row bends by a quarter of its squared length at most, which bounds the step.
    """

    def __init__(self, weights: np.ndarray, length: float):
        self.weights, self.ahead, self.rate, self.t = weights, weights, 4 / (1 + length), 0

    def step(self, slope: np.ndarray) -> None:
        new = self.ahead - self.rate * slope
        self.t += 1
        self.ahead = new + (self.t - 1) / (self.t + 2) * (new - self.weights)
        self.weights = new


def _calibrate(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(scale, shift) of log odds that fit the labels kept aside; none if they are one class."""
    if len(y) < 8 or y.min() == y.max():
        return 1.0, 0.0
    spread = odds.std() + 1e-9
    rows = _Rows(np.arange(len(y) + 1), np.zeros(len(y), np.int64), odds / spread, 1)
    scale, shift = _logistic(rows, y, np.array([0.5, 0.0]), steps=300, rate=0.05)
    return float(max(scale, 0.0) / spread), float(shift)


@dataclass
class Model:
    """Per head: weights and calibration of both views, and the prior log odds."""

    weights: dict[str, tuple[np.ndarray, np.ndarray]]
    scales: dict[str, tuple[tuple[float, float], tuple[float, float]]]
    prior: dict[str, float]
    pool: int  # rows that took part without a label

    def odds(self, head: str, text: _Rows, meta: _Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        views = [s * rows.dot(w) + b for rows, w, (s, b) in zip((text, meta), self.weights[head], self.scales[head])]
        return views[0], views[1], views[0] + views[1] - self.prior[head]


def _described(batch: pa.RecordBatch) -> Iterator[tuple[Texts, _Rows, _Rows]]:
    for texts in slices(batch.column("text")):
        n = len(texts)
        part = batch.slice(texts.first, n)
        row, slot, value = _text_view(texts)
        text = _Rows(np.searchsorted(row, np.arange(n + 1)), slot, value, WORD_SLOTS + SHAPE_SLOTS)
        on = _meta_view(texts, *(part.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
        meta = _Rows(np.arange(n + 1) * on.shape[1], on.reshape(-1), np.ones(on.size), META_SLOTS)
        yield texts, text, meta


def _columns(docs: DataFrame) -> DataFrame:
    have = set(docs.columns)
    other = [F.col(c).cast("string").alias(c) if c in have else F.lit(None).cast("string").alias(c)
             for c in ("lang", "source", "n_chars")]
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *other)


def _packed(start: np.ndarray, flat: np.ndarray) -> pa.Array:
    """Runs of numbers as binary values."""
    ends = (start * flat.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])


def _unpacked(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    _, ends, data = column.buffers()
    size = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(ends, size)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].view(kind) if data is not None else np.zeros(0, kind)
    return (ends - ends[0]) // np.dtype(kind).itemsize, flat


def _stored(batch: pa.RecordBatch) -> Iterator[tuple[int, _Rows, _Rows]]:
    """First row and both views of runs of a batch of stored features."""
    start, slot = _unpacked(batch.column("slots"), np.uint16)
    _, value = _unpacked(batch.column("vals"), np.float16)
    _, on = _unpacked(batch.column("meta"), np.uint16)
    on = on.reshape(len(batch), -1) if len(batch) else on.reshape(0, _META_WIDTH)
    row = 0
    while row < len(batch):
        last = min(max(int(np.searchsorted(start, start[row] + CELLS, side="right")) - 1, row + 1), len(batch))
        own, part = slice(start[row], start[last]), on[row:last].astype(np.int64)
        text = _Rows(start[row:last + 1] - start[row], slot[own].astype(np.int64), value[own].astype(np.float64),
                     WORD_SLOTS + SHAPE_SLOTS)
        yield row, text, _Rows(np.arange(last - row + 1) * part.shape[1], part.reshape(-1), np.ones(part.size), META_SLOTS)
        row = last


FEATURES = "slots binary, vals binary, meta binary"


def _features(docs: DataFrame) -> DataFrame:
    """(doc_id, slots, vals, meta, row): both views of each row, two bytes a number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, text, meta in _described(batch):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(texts.first, len(texts)), _packed(text.start, text.slot.astype(np.uint16)),
                     _packed(text.start, text.value.astype(np.float16)), _packed(meta.start, meta.slot.astype(np.uint16))],
                    names=["doc_id", "slots", "vals", "meta"])

    return _columns(docs).mapInArrow(run, f"doc_id bigint, {FEATURES}").withColumn("row", F.monotonically_increasing_id())


SIDES = [(head, view) for head in HEADS for view in (0, 1)]
Weights = dict[tuple[str, int], np.ndarray]


def _bins(odds: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((odds + REACH) * (BINS / (2 * REACH))), 0, BINS - 1).astype(np.int64)


def _sure(views: tuple[_Rows, _Rows], weights: Weights) -> np.ndarray:
    """Bin of each row's log odds by each head and view."""
    return np.stack([_bins(views[v].dot(weights[h, v])) for h, v in SIDES], axis=1)


def _counted(pool: DataFrame, weights: Weights) -> np.ndarray:
    """Rows of the pool in each bin, by head and view."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(SIDES) * BINS, np.int64)
        for batch in batches:
            for _, text, meta in _stored(batch):
                cells = _sure((text, meta), weights) + np.arange(len(SIDES)) * BINS
                total += np.bincount(cells.reshape(-1), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    return _summed(pool.select("slots", "vals", "meta"), run, len(SIDES) * BINS).reshape(len(SIDES), BINS)


def _summed(rows: DataFrame, run, size: int) -> np.ndarray:
    """Sums by cell of what the tasks of ``run`` give; their number is fixed."""
    found = rows.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size, np.int64)
    total[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return total


def shares(counts: np.ndarray, wanted: float) -> np.ndarray:
    """Part of each bin's rows that is taken so that the last bins give ``wanted`` rows in all."""
    above = np.cumsum(counts[::-1])[::-1] - counts
    return np.clip((wanted - above) / np.maximum(counts, 1), 0.0, 1.0) * (counts > 0)


def _lessons(pool: DataFrame, weights: Weights, good: np.ndarray, bad: np.ndarray) -> DataFrame:
    """Rows of the pool that some view is sure of, with their bins."""
    taken = (good + bad) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, text, meta in _stored(batch):
                sure = _sure((text, meta), weights)
                at = np.flatnonzero(taken[np.arange(len(SIDES)), sure].any(axis=1))
                some = batch.take(pa.array(first + at))
                own = _packed(np.arange(len(at) + 1) * len(SIDES), sure[at].astype(np.uint16).reshape(-1))
                yield pa.RecordBatch.from_arrays([*some.columns, own], names=[*some.schema.names, "sure"])

    return pool.select("slots", "vals", "meta").mapInArrow(run, f"{FEATURES}, sure binary")


_WIDTHS = (WORD_SLOTS + SHAPE_SLOTS, META_SLOTS)
_LENGTHS = (1.0, float(_META_WIDTH))  # squared, of a row of each view


def _lesson_slopes(lessons: DataFrame, weights: Weights, good: np.ndarray, bad: np.ndarray) -> Weights:
    """Summed slopes of each view's loss on what the other view taught."""
    edges = np.cumsum([0] + [_WIDTHS[v] + 1 for _, v in SIDES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(edges[-1], np.int64)
        for batch in batches:
            sure = _unpacked(batch.column("sure"), np.uint16)[1].reshape(-1, len(SIDES)).astype(np.int64)
            for first, text, meta in _stored(batch):
                views = (text, meta)
                for k, (h, v) in enumerate(SIDES):
                    teacher = SIDES.index((h, 1 - v))
                    rows = views[v]
                    own = sure[first:first + len(rows.start) - 1, teacher]
                    chance = _sigmoid(rows.dot(weights[h, v]))
                    error = good[teacher][own] * (chance - 1) + bad[teacher][own] * chance
                    total[edges[k]:edges[k + 1]] += np.rint(_slopes(rows, error) * FIXED).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    total = _summed(lessons, run, int(edges[-1])) / FIXED
    return {side: total[edges[k]:edges[k + 1]] for k, side in enumerate(SIDES)}


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled sample and on all rows without a label.

    Labels are (doc_id, quality, toxic); null labels and ids are left out, of several labels of a
    document the largest counts. A row belongs to the pool if its id is null or has no label;
    repeated rows count as often as they occur. Of rows that repeat a labelled id the one with the least
    features counts. Null and empty texts have no words. Without labels all scores are one half;
    without a pool, or without rows, there are no rounds.
    """
    given = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(
        F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    with scratch_scope(docs.sparkSession):
        rows = materialize(_features(docs), "views")
        times = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
        given = materialize(given.join(times, "doc_id"), "labelled-ids")
        chosen = given.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(LABELLED)
        sample = rows.join(F.broadcast(chosen.drop("n")), "doc_id").groupBy("doc_id").agg(  # LABELLED rows at most
            F.min(F.struct("slots", "vals", "meta", "quality", "toxic")).alias("f")).select("doc_id", "f.*")
        table = sample.orderBy("doc_id").toArrow().combine_chunks()
        joined = lookup_join(rows, given.select("doc_id", "n"), "doc_id", "n", "row")
        pool = materialize(joined.where("n is null").drop("doc_id", "n", "row"), "pool")
        return _cotrain(pool, *_gathered(table))


def _gathered(table: pa.Table) -> tuple[_Rows, _Rows, dict[str, np.ndarray]]:
    parts = [_views_of(batch) for batch in table.to_batches()] or [_views_of(
        pa.RecordBatch.from_pylist([], table.schema))]
    text, meta = parts[0]  # chunks were combined: one batch at most
    return text, meta, {h: np.array(table.column(h).to_pylist(), np.float64) for h in HEADS}


def _views_of(batch: pa.RecordBatch) -> tuple[_Rows, _Rows]:
    start, slot = _unpacked(batch.column("slots"), np.uint16)
    _, value = _unpacked(batch.column("vals"), np.float16)
    _, on = _unpacked(batch.column("meta"), np.uint16)
    return (_Rows(start, slot.astype(np.int64), value.astype(np.float64), _WIDTHS[0]),
            _Rows(np.arange(len(batch) + 1) * _META_WIDTH, on.astype(np.int64), np.ones(len(on)), _WIDTHS[1]))


def _cotrain(pool: DataFrame, text: _Rows, meta: _Rows, y: dict[str, np.ndarray]) -> Model:
    views, n_pool = (text, meta), pool.count()
    n = len(text.start) - 1
    is_aside = np.arange(n) % round(1 / KEPT_ASIDE) == 0
    known, aside = np.flatnonzero(~is_aside), np.flatnonzero(is_aside)
    share = {h: float(y[h][known].mean()) if len(known) else 0.5 for h in HEADS}
    prior = {h: float(np.log((s * len(known) + 1) / ((1 - s) * len(known) + 1))) for h, s in share.items()}
    seen = [view.take(known) for view in views]
    weights: Weights = {}
    for h, v in SIDES:
        start = np.append(np.zeros(_WIDTHS[v]), prior[h])
        weights[h, v] = _logistic(seen[v], y[h][known], start) if len(known) else start
    for turn in range(ROUNDS if n_pool and len(known) else 0):
        with scratch_scope(pool.sparkSession):
            counts = _counted(pool, weights)
            wanted = max(PER_ROUND * n_pool * (turn + 1), 1.0)
            good = np.stack([shares(c, wanted * share[h]) for c, (h, _) in zip(counts, SIDES)])
            bad = np.stack([shares(c[::-1], wanted * (1 - share[h]))[::-1] for c, (h, _) in zip(counts, SIDES)])
            lessons = materialize(_lessons(pool, weights, good, bad), "lessons")
            fits = {(h, v): _Descent(weights[h, v], _LENGTHS[v]) for h, v in SIDES}
            for _ in range(STEPS):
                taught = _lesson_slopes(lessons, {side: f.ahead for side, f in fits.items()}, good, bad)
                for (h, v), f in fits.items():
                    own = _slopes(seen[v], _sigmoid(seen[v].dot(f.ahead)) - y[h][known]) / len(known)
                    f.step((own + TRUST * taught[h, v] / wanted) / (1 + TRUST))
            weights = {side: f.weights for side, f in fits.items()}
    scales = {(h, v): _calibrate(views[v].take(aside).dot(weights[h, v]), y[h][aside]) for h, v in SIDES}
    return Model({h: (weights[h, 0], weights[h, 1]) for h in HEADS}, {h: (scales[h, 0], scales[h, 1]) for h in HEADS},
                 prior, n_pool)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text_score, meta_score, score, toxicity, kept) for every row of ``docs``.

    ``score`` and ``toxicity`` are the combined calibrated chances; ``kept`` says that quality is
    the likelier and toxicity the less likely. Null texts count as empty and null metadata
    as a value of its own; missing metadata columns are null; repeated rows stay.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, text, meta in _described(batch):
                a, b, both = (_sigmoid(x) for x in model.odds("quality", text, meta))
                toxic = _sigmoid(model.odds("toxic", text, meta)[2])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(texts.first, len(texts)), pa.array(a), pa.array(b), pa.array(both),
                     pa.array(toxic), pa.array((both >= 0.5) & (toxic < 0.5))],
                    names=["doc_id", "text_score", "meta_score", "score", "toxicity", "kept"])

    return _columns(docs).mapInArrow(
        run, "doc_id bigint, text_score double, meta_score double, score double, toxicity double, kept boolean")
