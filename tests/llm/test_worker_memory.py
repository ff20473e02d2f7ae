"""What a worker holds beside its batch does not grow with the batch."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from corpuslab.llm import order_minhash


class Caught:
    """Rows that give back the function they would run."""

    schema = {"id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))}

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def sketches_and_peak(n):
    draw = np.random.default_rng(3)
    texts = [" ".join(f"w{w}" for w in draw.integers(0, 50000, 300)) for _ in range(n)]
    batch = pa.RecordBatch.from_pydict({"key": [str(i) for i in range(n)], "id": list(range(n)), "text": texts})
    run = order_minhash.sketched(Caught())
    tracemalloc.start()
    try:
        found = pa.Table.from_batches(run(iter([batch])))
        return found, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_sketches_of_a_large_batch_stay_small():
    found, peak = sketches_and_peak(3000)  # 5 MB of text
    assert found.num_rows == 3000 and peak < 40


def test_slices_change_no_sketch(monkeypatch):
    found, _ = sketches_and_peak(400)
    monkeypatch.setattr(order_minhash, "SLICE", 1 << 14)
    assert sketches_and_peak(400)[0].to_pylist() == found.to_pylist()
