"""Every stretch of 13 words (or the item) that is four fifths equal counts, wherever words differ."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from corpuslab.llm import decontamination


def shares(same: np.ndarray) -> bool:
    """Whether some stretch of 13 places (or all) is at least 80 % equal, by trying each."""
    total = np.concatenate([[0], np.cumsum(same)])
    least = min(13, len(same))
    return any(5 * (total[j] - total[i]) >= 4 * (j - i) for i in range(len(same)) for j in range(i + least, len(same) + 1))


@pytest.mark.parametrize("n, replaced", [(13, 2), (13, 3), (14, 2), (15, 1), (15, 3), (16, 4), (20, 2), (20, 4), (25, 2), (9, 1), (9, 2), (7, 1)])
def test_a_qualifying_stretch_is_found_wherever_words_are_replaced(n, replaced):
    item = np.arange(n, dtype=np.uint64)
    places = list(combinations(range(n), replaced))
    for at in places[::max(1, len(places) // 1500)]:
        doc = item.copy()
        doc[list(at)] += np.uint64(1000)
        doc = np.concatenate([np.full(5, 7777, np.uint64), doc, np.full(6, 8888, np.uint64)])
        equal, span, first = decontamination.best_overlap(doc, item, 5)
        expected = shares(~np.isin(np.arange(n), at))
        assert bool(equal) == expected, at
        if expected:
            assert span >= min(13, n) and 5 * equal >= 4 * span
            assert equal == (doc[first:first + span] == item[first - 5:first - 5 + span]).sum()


@pytest.mark.parametrize("n", [*range(1, 21), 25])
def test_masks_hit_every_pattern_that_the_threshold_allows(n):
    # longer stretches hold a qualifying one of 13 to 25 words
    masks = [m for m in decontamination.MASKS[min(n, 13)] if len(m) <= n]
    hits = [int(m, 2) << i for m in masks for i in range(n - len(m) + 1)]
    for at in combinations(range(n), n // 5):
        equal = (1 << n) - 1 - sum(1 << i for i in at)
        assert any(equal & h == h for h in hits), at


def test_items_cut_by_the_end_of_the_document():
    item = np.arange(15, dtype=np.uint64)
    for cut in range(1, 8):
        same = np.arange(15) < 15 - cut
        assert bool(decontamination.best_overlap(item[:15 - cut], item, 0)[0]) == shares(same)
        assert bool(decontamination.best_overlap(item[cut:], item, -cut)[0]) == shares(same[::-1])


def test_overlaps_on_both_sides_of_a_difference(spark):
    words = [f"word{i}" for i in range(15)]
    rows = [(i, " ".join(["before", *words[:i], "other", *words[i + 1:], "after"])) for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    found = {r.key: (r.n_equal, r.n_span) for r in decontamination.overlaps(docs, bench).collect()}
    assert len(found) == 15 and all(5 * e >= 4 * s and s >= 13 for e, s in found.values())


def test_sparse_patterns_and_short_items(spark):
    """Two words of 13 and three of 15 replaced where fewer masks had no hit; items of one to six words."""
    long, longer = [f"word{i}" for i in range(13)], [f"term{i}" for i in range(15)]
    items = [(1, " ".join(long)), (2, " ".join(longer)), (3, "alone"), (4, "two together"), (5, "A five-word item, copied"),
             (6, "here are six words in row")]
    changed = lambda words, at: " ".join("other" if i in at else w for i, w in enumerate(words))
    texts = {
        (1, 1): changed(long, (4, 9)), (2, 2): changed(longer, (3, 7, 11)), (3, 3): "it is alone there", (4, 4): "the two together now",
        (5, 5): "read a five word item copied", (6, 5): "read a five word other copied", (7, 6): "here are six other in row",
        (8, None): "five word", (9, None): changed(long, (4, 9, 12)), (10, None): "together two", (11, None): "five word other copied"}
    docs = spark.createDataFrame([(d, t) for (d, _), t in texts.items()], "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontamination.overlaps(docs, bench).join(
        docs.select("doc_id", decontamination.text_key("text").alias("key")), "key").join(
        bench.select("item_id", decontamination.text_key("text").alias("item")), "item").select("doc_id", "item_id").collect()
    assert {tuple(r) for r in found} == {(d, i) for d, i in texts if i}
