"""Fits of feed-forward networks on rows that are wide and mostly zero.

The network of pyspark.ml multiplies every row at its full width, one stack of rows after the other. Here the
products of a block of rows are numpy's; slots that no row of it uses are left out where they are many. The loss,
the start and the method (L-BFGS) are those of pyspark.ml. For many rows the products with the first layer may be
taken in single precision; sums, all else and the weights stay double, and rounding stays far below the tolerance of a fit. Each step is one Spark job: tasks sum the
slopes of their rows, and the sums are added up piece by piece. Only weights and slopes, as long as
the network, reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Rows packed at a time, numbers in a piece, pairs that L-BFGS keeps, steps tried in a direction.
BLOCK, PIECE, PAIRS, TRIES = 512, 1 << 17, 10, 20
# Of a direction's first slope: what the loss must fall by, what the slope must fall to.
ENOUGH, FLAT = 1e-4, 0.9
# Losses whose range says whether there is progress.
RECENT = 20
# A block that uses this share of the slots is not packed.
FULL = 0.5


def _summed_slopes(shared, sizes: Sequence[int], single: bool = False):
    """Function over batches of (label, slots, values): pieces of the slopes' sums, with the sum of losses and the rows behind."""
    sizes, block, piece, full = list(sizes), BLOCK, PIECE, FULL
    kind = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
            at, out = 0, []
            for inputs, outputs in zip(sizes, sizes[1:]):
                end = at + inputs * outputs
                out.append((flat[at:end].reshape(inputs, outputs), flat[end:end + outputs]))
                at = end + outputs
            return out

        weights = parts(shared.value)
        first_layer = weights[0][0].astype(kind, copy=False)
        total = np.zeros(len(shared.value) + 2)
        slopes = parts(total)
        wide, product = np.zeros((block, sizes[0]), kind), None
        for batch in batches:
            for first in range(0, len(batch), block):
                rows = batch.slice(first, block)
                n = len(rows)
                label = rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                lengths = rows.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                at, row = rows.column(1).flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(n), lengths)
                value = rows.column(2).flatten().to_numpy(zero_copy_only=False)
                is_used = np.zeros(sizes[0], dtype=bool)
                is_used[at] = True
                used = np.flatnonzero(is_used)
                is_full = len(used) >= full * sizes[0]
                if is_full:
                    packed = wide[:n]
                    packed[row, at] = value
                    values = [packed @ first_layer + weights[0][1]]
                else:
                    packed = np.zeros((n, len(used)), kind)
                    packed[row, np.searchsorted(used, at)] = value
                    values = [packed @ first_layer[used] + weights[0][1]]
                for w, bias in weights[1:]:
                    values[-1] = 0.5 * (1 + np.tanh(0.5 * values[-1]))  # logistic, without overflow
                    values.append(values[-1] @ w + bias)
                scores = values[-1] - values[-1].max(axis=1, keepdims=True)
                logs = scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))
                total[-2] -= logs[np.arange(n), label].sum()
                total[-1] += n
                excess = np.exp(logs)
                excess[np.arange(n), label] -= 1
                for k in range(len(weights) - 1, 0, -1):
                    slopes[k][0][:] += values[k - 1].T @ excess
                    slopes[k][1][:] += excess.sum(axis=0)
                    excess = (excess @ weights[k][0].T) * values[k - 1] * (1 - values[k - 1])
                slopes[0][1][:] += excess.sum(axis=0)
                excess = excess.astype(kind, copy=False)
                if is_full:
                    product = np.dot(packed.T, excess, out=product)
                    slopes[0][0][:] += product
                    packed[row, at] = 0
                else:
                    slopes[0][0][used] += packed.T @ excess
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, begin in enumerate(range(0, len(total), piece)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([task], pa.int64()), pa.array([total[begin:begin + piece].tobytes()])],
                names=["piece", "task", "sums"])

    return run


def _adder():
    """Function over batches of (piece, task, sums) in this order: one row per piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row():
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([own.tobytes()])], names=["piece", "sums"])

        number, own = None, None
        for batch in batches:
            for at, sums in zip(batch.column("piece").to_pylist(), batch.column("sums")):
                sums = np.frombuffer(sums.as_buffer(), np.float64)
                if at == number:
                    own += sums
                    continue
                if number is not None:
                    yield row()
                number, own = at, sums.copy()
        if number is not None:
            yield row()

    return run


def _mean_loss(rows: DataFrame, sizes: Sequence[int], single: bool = False) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Function from weights to the mean loss of the rows and its slopes."""
    def at(weights: np.ndarray) -> tuple[float, np.ndarray]:
        shared = rows.sparkSession.sparkContext.broadcast(weights)
        try:
            pieces = rows.mapInArrow(_summed_slopes(shared, sizes, single), "piece long, task long, sums binary")
            # in the order of tasks, so that reruns agree to the last digit
            ordered = pieces.repartition("piece").sortWithinPartitions("piece", "task")
            found = ordered.mapInArrow(_adder(), "piece long, sums binary").toArrow().sort_by("piece")
        finally:
            shared.destroy()
        total = np.concatenate([np.frombuffer(s.as_buffer(), np.float64) for s in found.column("sums")])
        return total[-2] / total[-1], total[:-2] / total[-1]

    return at


def minimum(function: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, max_iter: int,
            tolerance: float) -> np.ndarray:
    """Where L-BFGS gets from ``start``: it ends after ``max_iter`` steps, or when the loss no longer
    falls by ``tolerance`` of its first value, or the slopes are that small against it."""
    here = np.array(start, dtype=float)
    loss, slope = function(here)
    first, losses, pairs = loss, [loss], []
    for _ in range(max_iter):
        if np.linalg.norm(slope) <= max(tolerance * abs(loss), 1e-8):
            break
        found = _step(function, here, loss, slope, _direction(slope, pairs), 1.0 if pairs else 1 / np.linalg.norm(slope))
        if found is None:
            if not pairs:
                break
            pairs = []  # once more along the slope itself
            continue
        step, loss, new_slope = found
        change = new_slope - slope
        if step @ change > 0:
            pairs = [*pairs[-(PAIRS - 1):], (step, change)]
        here, slope = here + step, new_slope
        losses = [*losses[-(RECENT - 1):], loss]
        if max(losses) - loss <= tolerance * abs(first):
            break
    return here


def _direction(slope: np.ndarray, pairs: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Minus the slope times the inverse curvature that the pairs of step and change of slope show."""
    way, shares = -slope, []
    for step, change in reversed(pairs):
        share = (step @ way) / (step @ change)
        way -= share * change
        shares.append(share)
    if pairs:
        step, change = pairs[-1]
        way *= (step @ change) / (change @ change)
    for (step, change), share in zip(pairs, reversed(shares)):
        way += (share - (change @ way) / (step @ change)) * step
    return way


def _step(function: Callable, here: np.ndarray, loss: float, slope: np.ndarray, way: np.ndarray, size: float):
    """(step, loss, slopes) where the loss falls enough and the slope flattens; None if no step tried makes it fall."""
    down, low, high, best = slope @ way, 0.0, np.inf, None
    for _ in range(TRIES):
        new_loss, new_slope = function(here + size * way)
        if not new_loss <= loss + ENOUGH * size * down:
            high = size
        else:
            best = size * way, new_loss, new_slope
            if new_slope @ way >= FLAT * down:
                break
            low = size
        size = 2 * size if high == np.inf else (low + high) / 2
    return best


def fit_weights(rows: DataFrame, sizes: Sequence[int], start: np.ndarray, max_iter: int, tolerance: float = 1e-6,
                single: bool = False) -> np.ndarray:
    """Weights of a network with logistic units and softmax, layer by layer, as pyspark.ml keeps them.

    ``rows`` are (label_index, slots, values), labels from 0; read once a step, so they should be cached.
    ``single``: products with the first layer in single precision.
    """
    return minimum(_mean_loss(rows, sizes, single), start, max_iter, tolerance)
