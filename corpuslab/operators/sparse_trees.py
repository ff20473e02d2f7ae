"""Fits of trees and forests on rows that are wide and mostly zero.

The trees of pyspark.ml keep four bytes for every row and slot, and each task sums up all nodes of a
group at once. Here a row keeps only the slots whose bin is not that of 0; what falls into the bin of 0
is a node's total less the rest. Rows are read once a group of nodes, task by task as a stream;
the sums of a task are bounded, added up piece by piece, and each piece is searched for its best split
where it was added. Thresholds, bins, gains, ties, leaves and pruning are those of pyspark.ml, so a
single tree is the same tree wherever all rows are looked at for thresholds (up to 10,000); forests draw rows
and slots by numbers of their own. Only nodes and what a slot's bins are reach the driver.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import (
    DecisionTreeClassificationModel, DecisionTreeClassifier, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.features import vector_reader
from corpuslab.session import materialize, scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this module

# Bytes of sums that a task holds, numbers in a piece of them, rows spread out at a time.
SUM_BYTES, PIECE, BLOCK = 64 * 1024 * 1024, 1 << 17, 512
# Rows that thresholds are taken from, as in pyspark.ml.
SAMPLE = 10_000
_EPSILON = 2.0 ** -52
_NUMBER, _ORDERED, _UNORDERED = 0, 1, 2


def categories(df: DataFrame, features: str) -> dict[int, int]:
    """Slot to number of categories, from the column's metadata."""
    attributes = df.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    out = {a["idx"]: 2 for a in attributes.get("binary", [])}
    return out | {a["idx"]: len(a["vals"]) if "vals" in a else a["num_vals"] for a in attributes.get("nominal", []) if "vals" in a or "num_vals" in a}


def supported(estimator, arity: dict[int, int], n_rows: int) -> bool:
    """Whether the settings are among those that this fit knows."""
    bins = min(estimator.getMaxBins(), n_rows)
    plain = estimator.getMinWeightFractionPerNode() == 0 and not estimator.isSet("weightCol") and bins <= 64
    if isinstance(estimator, RandomForestClassifier):
        plain = plain and estimator.getSubsamplingRate() == 1 and estimator.getFeatureSubsetStrategy() in ("auto", "all", "sqrt")
    return plain and max(arity.values(), default=0) <= bins


class Bins:
    """What each slot's bins are: kind, number of bins, thresholds, bin of 0. Slots without a split have one bin."""

    def __init__(self, width: int, arity: dict[int, int], thresholds: dict[int, Sequence[float]], max_bins: int, n_classes: int):
        most = math.floor(math.log(max_bins // 2 + 1) / math.log(2) + 1) if n_classes > 2 else 0
        self.kind, self.n = np.zeros(width, np.int8), np.ones(width, np.int64)
        for slot, k in arity.items():
            self.kind[slot], self.n[slot] = _UNORDERED if k <= most else _ORDERED, k
        found = [np.asarray(thresholds.get(s, ()), float) for s in range(width)]
        for slot, values in enumerate(found):
            if self.kind[slot] == _NUMBER:
                self.n[slot] = len(values) + 1
        self.thresholds = np.concatenate([*found, [np.inf]])
        self.ends = np.concatenate([[0], np.cumsum([len(v) for v in found])]).astype(np.int64)
        self.zero = self.of(np.arange(width), np.zeros(width))

    def of(self, slot: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Bins of values: the category, or the number of thresholds below the value."""
        low, high = self.ends[slot], self.ends[slot + 1]
        begin = low
        while (low < high).any():
            middle = (low + high) // 2
            below = (low < high) & (self.thresholds[middle] < value)
            high = np.where((low < high) & ~below, middle, high)
            low = np.where(below, middle + 1, low)
        bins = np.where(self.kind[slot] == _NUMBER, low - begin, value).astype(np.int64)
        if ((bins < 0) | (bins >= self.n[slot])).any():
            raise ValueError("a value is no category of its slot")
        return bins


def _between(values: list[tuple[float, float]], n_rows: float, tolerance: float, splits: int) -> list[float]:
    """Thresholds of a slot from its values but 0 with their counts, evenly by rows."""
    rest = n_rows - sum(n for _, n in values)
    counts = sorted([*values, (0.0, rest)] if rest > tolerance else values)
    middle = [(a[0] + b[0]) / 2.0 for a, b in zip(counts, counts[1:])]
    if len(middle) <= splits:
        return middle
    stride, here, out = n_rows / (splits + 1), counts[0][1], []
    target = stride
    for k, (_, n) in enumerate(counts[1:]):
        before, here = here, here + n
        if abs(before - target) < abs(here - target):
            out.append(middle[k])
            target += stride
    return out


def thresholds(df: DataFrame, features: str, width: int, arity: dict[int, int], n_rows: int, max_bins: int, seed: int) -> dict[int, list[float]]:
    """Thresholds of all slots that hold numbers, from a sample where there are many rows."""
    share = min(1.0, max(max_bins * max_bins, SAMPLE) / n_rows)
    is_number = np.ones(width, dtype=bool)
    is_number[list(arity)] = False

    read, step = vector_reader(), BLOCK

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, step) for whole in batches for k in range(0, len(whole), step)):
            _, slot, value = read(batch.column(0))
            kept = is_number[slot] & (value != 0)
            slot, value = slot[kept], value[kept]
            order = np.lexsort((value, slot))
            slot, value = slot[order], value[order]
            begins = np.flatnonzero(np.concatenate([[True], (np.diff(slot) != 0) | (np.diff(value) != 0)])[:len(slot)])
            yield pa.RecordBatch.from_arrays([pa.array(slot[begins], pa.int32()), pa.array(value[begins]), pa.array(
                np.diff(np.append(begins, len(slot))), pa.int64())], names=["slot", "value", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_between([(p["value"], p["n"]) for p in pairs], share * n_rows, _EPSILON * sum(p["n"] for p in pairs) * 100, max_bins - 1)
                     for pairs in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["slot", "thresholds"])

    rows = df.select(features)
    rows = rows if share == 1.0 else rows.sample(False, share, seed)
    values = rows.mapInArrow(counted, "slot int, value double, n long").groupBy("slot", "value").agg(F.sum("n").alias("n"))
    lists = values.groupBy("slot").agg(F.collect_list(F.struct("value", "n")).alias("pairs"))
    return {r["slot"]: r["thresholds"] for r in lists.mapInArrow(cut, "slot int, thresholds array<double>").collect()}


def _binned(bins: Bins, n_classes: int, trees: int, drawn: bool, seed: int):
    """Function over batches of (label, vector): (label, slots, bins, times) with the slots whose bin is not that
    of 0, and how often each tree has the row."""
    read, step = vector_reader(), BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        draw = np.random.default_rng([seed % 2**63, TaskContext.get().partitionId()])
        for batch in (whole.slice(k, step) for whole in batches for k in range(0, len(whole), step)):
            label = batch.column(0).cast(pa.int32())
            if label.null_count or not np.isin(label.to_numpy(), np.arange(n_classes)).all():
                raise ValueError(f"a label is not one of 0 to {n_classes - 1}")
            n, (ends, slot, value) = len(batch), read(batch.column(1))
            row, own = np.repeat(np.arange(n), np.diff(ends)), bins.of(slot, value)
            kept = own != bins.zero[slot]
            ends = pa.array(np.searchsorted(row[kept], np.arange(n + 1)), pa.int32())
            times = draw.poisson(1.0, n * trees) if drawn else np.ones(n * trees)
            yield pa.RecordBatch.from_arrays([
                label, pa.ListArray.from_arrays(ends, pa.array(slot[kept], pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(own[kept], pa.int8())),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * trees, pa.int32()), pa.array(times, pa.int32()))],
                names=["label", "slots", "bins", "times"])

    return run


class Tree:
    """A tree as it grows: per node the slot it splits on (-1: none), its sides, and the bins that go left."""

    def __init__(self, most_bins: int):
        self.slot, self.sides, self.goes_left, self.depth = [-1], [(-1, -1)], [np.zeros(most_bins, bool)], [0]
        self.counts, self.gain, self.is_valid, self.split = [None], [-1.0], [True], [None]

    def add(self, depth: int, counts: np.ndarray) -> int:
        for values, new in ((self.slot, -1), (self.sides, (-1, -1)), (self.goes_left, np.zeros_like(self.goes_left[0])), (self.depth, depth),
                            (self.counts, counts), (self.gain, -1.0), (self.is_valid, True), (self.split, None)):
            values.append(new)
        return len(self.slot) - 1

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.slot), np.array(self.sides), np.array(self.goes_left)


class Group:
    """Nodes that are summed up in one pass: each with its slots in the order of ties, and where its sums are.

    A piece is a node's class totals and a run of its slots. ``begins`` has where a slot's bins begin, -1: not looked at.
    """

    def __init__(self, bins: Bins, n_classes: int, nodes: Sequence[tuple[int, int, np.ndarray]], piece: int):
        self.nodes, self.n_classes = [(t, k) for t, k, _ in nodes], n_classes
        self.begins, self.pieces, size = np.full((len(nodes), len(bins.n)), -1, np.int64), [], 0
        for at, (_, _, slots) in enumerate(nodes):
            slots = slots[bins.n[slots] > 1]
            ends = np.cumsum(bins.n[slots]) * n_classes
            cuts = np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, piece), side="left")
            cuts = np.unique(np.concatenate([cuts, [0, len(slots)]]))
            for first, last in zip(cuts, cuts[1:]) if len(slots) else [(0, 0)]:
                run = slots[first:last]
                widths = bins.n[run] * n_classes
                self.begins[at, run] = size + n_classes + np.cumsum(widths) - widths
                self.pieces.append((at, run, first, size, size + n_classes + int(widths.sum())))
                size = self.pieces[-1][-1]
        self.size = size


def _sums(zero: np.ndarray, trees: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]], group: Group):
    """Function over batches of (label, slots, bins, times): a task's sums per piece of the group."""
    block = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n_classes, sums = group.n_classes, np.zeros(group.size, np.int64)
        totals = np.zeros((len(group.nodes), n_classes), np.int64)
        at_node = {t: np.full(len(trees[t][0]), -1, np.int64) for t, _ in group.nodes}
        for at, (t, k) in enumerate(group.nodes):
            at_node[t][k] = at
        wide = np.empty((block, len(zero)), np.int8)
        for batch in batches:
            for first in range(0, len(batch), block):
                rows = batch.slice(first, block)
                n = len(rows)
                label = rows.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(n), rows.column(1).value_lengths().to_numpy(zero_copy_only=False))
                slot = rows.column(1).flatten().to_numpy(zero_copy_only=False)
                own = rows.column(2).flatten().to_numpy(zero_copy_only=False)
                times = rows.column(3).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                wide[:n] = zero
                wide[row, slot] = own
                for t, places in at_node.items():
                    split, sides, goes_left = trees[t]
                    node = np.zeros(n, np.int64)
                    while (moves := np.flatnonzero(split[node] >= 0)).size:
                        here = node[moves]
                        is_left = goes_left[here, wide[moves, split[here]]]
                        node[moves] = np.where(is_left, sides[here, 0], sides[here, 1])
                    place = np.where(times[:, t] > 0, places[node], -1)
                    met = np.flatnonzero(place >= 0)
                    np.add.at(totals, (place[met], label[met]), times[met, t])
                    kept = np.flatnonzero(place[row] >= 0)
                    begin = group.begins[place[row[kept]], slot[kept]]
                    kept, begin = kept[begin >= 0], begin[begin >= 0]
                    np.add.at(sums, begin + own[kept] * n_classes + label[row[kept]], times[row[kept], t].astype(np.int64))
        task = TaskContext.get().partitionId()
        for number, (at, _, _, begin, end) in enumerate(group.pieces):
            if totals[at].any():
                sums[begin:begin + n_classes] = totals[at]
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), pa.array([task], pa.int64()),
                    pa.array([pa.compress(sums[begin:end].tobytes(), "zstd", asbytes=True)])],  # most are 0
                    names=["piece", "task", "sums"])

    return run


def impurities(counts: np.ndarray, kind: str) -> np.ndarray:
    """Of class counts along the last axis; 0 where there are none."""
    total = counts.sum(axis=-1)
    out = np.zeros(total.shape) if kind == "entropy" else np.ones(total.shape)
    for c in range(counts.shape[-1]):
        share = counts[..., c] / np.where(total == 0, 1, total)
        out = out - (share * (np.log(np.where(share == 0, 1, share)) / math.log(2)) if kind == "entropy" else share * share)
    return np.where(total == 0, 0.0, out)


def _gains(left: np.ndarray, total: np.ndarray, kind: str, least: int, least_gain: float) -> np.ndarray:
    """Gains of sending ``left`` to one side; -inf where a side has too few rows or the gain is too small."""
    right = total - left
    n_left, n_right = left.sum(axis=-1), right.sum(axis=-1)
    n = np.maximum(n_left + n_right, 1)
    gain = impurities(total, kind) - n_left / n * impurities(left, kind) - n_right / n * impurities(right, kind)
    return np.where((n_left < least) | (n_right < least) | (gain < least_gain), -np.inf, gain)


def best_split(bins: Bins, slots: np.ndarray, sums: np.ndarray, n_classes: int, kind: str, least: int, least_gain: float):
    """(gain, place in ``slots``, bins that go left, class counts that go left) of the best split of a piece; None without one."""
    total, at, best = sums[:n_classes], n_classes, None
    widths = bins.n[slots]
    begins = n_classes + (np.cumsum(widths) - widths) * n_classes
    for kinds in (_NUMBER, _ORDERED, _UNORDERED):
        for first in range(0, len(slots), 1024):
            own = first + np.flatnonzero(bins.kind[slots[first:first + 1024]] == kinds)
            if not len(own):
                continue
            most = int(widths[own].max())
            at = begins[own, None] + np.arange(most) * n_classes
            is_bin = np.arange(most) < widths[own, None]
            counts = np.where(is_bin[..., None], sums[np.where(is_bin, at, 0)[..., None] + np.arange(n_classes)], 0)
            counts[np.arange(len(own)), bins.zero[slots[own]]] = total - counts.sum(axis=1)
            order = np.broadcast_to(np.arange(most), counts.shape[:2])
            if kinds == _UNORDERED:
                subsets = (np.arange(1, 1 << (most - 1))[:, None] >> np.arange(most)) & 1
                left = np.einsum("sb,fbc->fsc", subsets, counts)
                may = np.arange(len(subsets)) < (1 << (widths[own, None] - 1)) - 1
            else:
                if kinds == _ORDERED:
                    middle = impurities(counts, kind) if n_classes > 2 else counts[..., -1].astype(float)
                    middle = np.where(counts.sum(axis=-1) == 0, np.finfo(float).max, middle)
                    order = np.argsort(np.where(is_bin, middle, np.inf), axis=1, kind="stable")
                left = np.cumsum(np.take_along_axis(counts, order[..., None], axis=1), axis=1)[:, :-1]
                may = np.arange(most - 1) < widths[own, None] - 1
            gains = np.where(may, _gains(left, total, kind, least, least_gain), -np.inf)
            split = gains.argmax(axis=1)
            gain = gains[np.arange(len(own)), split]
            k = int(gain.argmax())
            if gain[k] == -np.inf or best is not None and (gain[k], -own[k]) <= (best[0], -best[1]):
                continue
            goes = np.flatnonzero(subsets[split[k]]) if kinds == _UNORDERED else order[k, :split[k] + 1]
            best = float(gain[k]), int(own[k]), [int(b) for b in goes], left[k, split[k]]
    return best


def _searcher(bins: Bins, group: Group, kind: str, least: int, least_gain: float):
    """Function over batches of (piece, task, sums) in this order: one row per piece with its best split, if any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row():
            at, slots, first, _, _ = group.pieces[number]
            found = best_split(bins, slots, own, group.n_classes, kind, least, least_gain) if len(slots) else None
            gain, place, goes, left = found or (None, 0, [], [])
            slot = int(slots[place]) if found else None
            return pa.RecordBatch.from_pylist([{"node": at, "totals": [int(x) for x in own[:group.n_classes]], "gain": gain, "place": int(first) + place,
                                                "slot": slot, "goes": goes, "lefts": [int(x) for x in left]}], schema=schema)

        schema = pa.schema([("node", pa.int64()), ("totals", pa.list_(pa.int64())), ("gain", pa.float64()), ("place", pa.int64()),
                            ("slot", pa.int64()), ("goes", pa.list_(pa.int64())), ("lefts", pa.list_(pa.int64()))])
        number, own = None, None
        for batch in batches:
            for at, sums in zip(batch.column("piece").to_pylist(), batch.column("sums")):
                begin, end = group.pieces[at][-2:]
                sums = np.frombuffer(pa.decompress(sums.as_buffer(), 8 * (end - begin), "zstd"), np.int64)
                if at == number:
                    own += sums
                    continue
                if number is not None:
                    yield row()
                number, own = at, sums.copy()
        if number is not None:
            yield row()

    return run


def _grown(rows: DataFrame, bins: Bins, n_classes: int, n_trees: int, n_slots: int, estimator) -> list[Tree]:
    """Trees, level by level; a level takes as many passes as its sums need."""
    width = len(bins.n)
    kind, deepest = estimator.getImpurity(), estimator.getMaxDepth()
    least, least_gain = estimator.getMinInstancesPerNode(), estimator.getMinInfoGain()

    def slots_of(t: int, k: int) -> np.ndarray:
        draw = np.random.default_rng([estimator.getSeed() % 2**63, t, k])
        return np.arange(width) if n_slots == width else draw.choice(width, n_slots, replace=False)

    trees = [Tree(int(bins.n.max())) for _ in range(n_trees)]
    open_nodes = [(t, 0) for t in range(n_trees)]
    while open_nodes:
        chosen, size = [], 0
        while open_nodes:
            slots = slots_of(*open_nodes[0])
            own = int(bins.n[slots][bins.n[slots] > 1].sum()) * n_classes * 8 + 8 * width
            if chosen and size + own > SUM_BYTES:
                break
            chosen, size = [*chosen, (*open_nodes.pop(0), slots)], size + own
        group = Group(bins, n_classes, chosen, PIECE)
        pieces = rows.mapInArrow(_sums(bins.zero, [t.places() for t in trees], group), "piece long, task long, sums binary")
        n_tasks = min(len(group.pieces), 4 * rows.sparkSession.sparkContext.defaultParallelism)
        ordered = pieces.repartition(n_tasks, "piece").sortWithinPartitions("piece", "task")
        found = ordered.mapInArrow(_searcher(bins, group, kind, least, least_gain),
                                   "node long, totals array<long>, gain double, place long, slot long, goes array<long>, lefts array<long>").collect()
        for at, (t, k, _) in enumerate(chosen):
            tree, mine = trees[t], [r for r in found if r["node"] == at]
            tree.counts[k] = np.array(mine[0]["totals"]) if mine else np.zeros(n_classes, np.int64)
            splits = [r for r in mine if r["gain"] is not None]
            if not splits:
                tree.is_valid[k] = False
                continue
            best = max(splits, key=lambda r: (r["gain"], -r["place"]))
            tree.gain[k] = best["gain"]
            if best["gain"] <= 0 or tree.depth[k] == deepest:
                continue
            slot, lefts = best["slot"], np.array(best["lefts"])
            tree.slot[k], tree.goes_left[k][best["goes"]] = slot, True
            tree.split[k] = ([float(bins.thresholds[bins.ends[slot] + len(best["goes"]) - 1])], -1) if bins.kind[slot] == _NUMBER else (
                [float(b) for b in best["goes"]], int(bins.n[slot]))
            sides = tuple(tree.add(tree.depth[k] + 1, c) for c in (lefts, tree.counts[k] - lefts))
            tree.sides[k] = sides
            for side in sides:
                if tree.depth[side] < deepest and abs(float(impurities(tree.counts[side], kind))) >= _EPSILON:
                    open_nodes.append((t, side))
    return trees


def _node_rows(tree: Tree, kind: str) -> list[dict]:
    """Nodes in the order of the saved form; sides that are leaves of one class become one leaf."""
    def pruned(k: int):
        if tree.split[k] is None:
            return k, None
        left, right = (pruned(s) for s in tree.sides[k])
        if left[1] is None and right[1] is None and tree.counts[left[0]].argmax() == tree.counts[right[0]].argmax():
            return k, None
        return k, (left, right)

    rows = []

    def put(node) -> None:
        k, sides = node
        # pyspark.ml gives a leaf no impurity where no split was allowed
        impurity = float(impurities(tree.counts[k], kind)) if tree.is_valid[k] else -1.0
        row = {"id": len(rows), "prediction": float(tree.counts[k].argmax()), "impurity": impurity,
               "impurityStats": [float(c) for c in tree.counts[k]], "rawCount": int(tree.counts[k].sum()),
               "gain": tree.gain[k] if sides else -1.0, "leftChild": -1, "rightChild": -1,
               "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}}
        rows.append(row)
        if sides:
            values, n = tree.split[k]
            row["split"] = {"featureIndex": tree.slot[k], "leftCategoriesOrThreshold": values, "numCategories": n}
            for name, side in zip(("leftChild", "rightChild"), sides):
                row[name] = len(rows)
                put(side)

    put(pruned(0))
    return rows


def fit(estimator: DecisionTreeClassifier | RandomForestClassifier, plain_fit, df: DataFrame, n_rows: int, width: int):
    """The fitted model of pyspark.ml, whose nodes were found here.

    ``plain_fit`` fits the estimator with pyspark.ml: one row, with the last label, gives the model's frame and its settings.
    """
    spark, features, label = df.sparkSession, estimator.getFeaturesCol(), estimator.getLabelCol()
    arity, is_forest = categories(df, features), isinstance(estimator, RandomForestClassifier)
    frame = plain_fit(df.orderBy(F.col(label).desc()).limit(1).withMetadata(features, {}))
    n_classes, max_bins = frame.numClasses, min(estimator.getMaxBins(), n_rows)
    n_trees = estimator.getNumTrees() if is_forest else 1
    every = not is_forest or estimator.getFeatureSubsetStrategy() == "all" or (
        estimator.getFeatureSubsetStrategy() == "auto" and n_trees == 1)
    found = thresholds(df, features, width, arity, n_rows, max_bins, estimator.getSeed())
    bins = Bins(width, {s: k for s, k in arity.items() if k > 1}, found, max_bins, n_classes)
    drawn = is_forest and estimator.getBootstrap()
    rows = materialize(df.select(label, features).mapInArrow(_binned(bins, n_classes, n_trees, drawn, estimator.getSeed()),
                                                             "label int, slots array<int>, bins array<tinyint>, times array<int>"), "tree-rows")
    trees = _grown(rows, bins, n_classes, n_trees, width if every else math.ceil(math.sqrt(width)), estimator)
    path = scratch_path(spark, "forest-fitted")
    frame.write().save(path)
    schema = spark.read.parquet(f"{path}/data").schema
    nodes = [{"treeID": t, "nodeData": row} if is_forest else row
             for t, tree in enumerate(trees) for row in _node_rows(tree, estimator.getImpurity())]
    spark.createDataFrame(nodes, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
    return (RandomForestClassificationModel if is_forest else DecisionTreeClassificationModel).load(path)
