"""Near-duplicates whose only link joins members that led nothing; pairs at exactly 0.8; short texts."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import order_minhash


@pytest.fixture()
def one_bucket(spark):
    """All texts share one bucket; (node, text) rows to their links."""

    def links(texts: dict[int, str]) -> set[tuple[int, int]]:
        rows = spark.createDataFrame([(f"k{i}", t) for i, t in texts.items()], "key string, text string")
        nodes = spark.createDataFrame([(f"k{i}", i, len(t.split()) - 4, [1]) for i, t in texts.items()],
                                      "key string, node bigint, n bigint, buckets array<bigint>")
        return {tuple(r) for r in order_minhash.find_links(rows, nodes).select("a", "b").collect()}

    return links


def test_members_of_two_classes_that_never_led_are_compared(spark, one_bucket):
    """In a chain A~B~D~C only B~D joins the two classes that A and C lead."""
    words = [f"word{i}" for i in range(134)]
    # each starts ten words after the last: neighbours have 90 of 110 shingles in common, others 80 of 120
    chain = [" ".join(words[10 * step:10 * step + 104]) for step in range(4)]
    parts = {r.id: r.part for r in spark.range(1, 30).selectExpr("id", "pmod(xxhash64(id), 4) as part").collect()}
    c, d = next((c, d) for c in parts for d in parts if c < d and parts[c] == parts[d])  # so C leads and D does not
    a, b = 0, 40
    found = one_bucket({a: chain[0], b: chain[1], d: chain[2], c: chain[3]})
    assert found == {tuple(sorted(p)) for p in ((a, b), (b, d), (c, d))}


@pytest.mark.parametrize("n", [4, 8, 12, 20, 40, 52, 100, 400, 1000])
def test_pairs_at_exactly_the_threshold(n):
    whole = np.arange(n + n // 4, dtype=np.uint64)
    assert order_minhash.similarity(whole[:n], whole) == order_minhash.similarity(whole, whole[n // 4:]) == 0.8
    assert order_minhash.similarity(whole[:n - 1], whole) == 0.0


def test_similar_short_texts_share_an_exact_key():
    rng = random.Random(5)
    for n in range(1, order_minhash.EXACT + 1):
        for _ in range(60):
            a = [rng.getrandbits(63) for _ in range(n)]
            b = list(a)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(b) + 1)
                b[at:at + rng.randint(0, 1)] = [rng.getrandbits(63) for _ in range(rng.randint(0, 1))]
            common = len(set(a) & set(b))
            if not 0 < len(b) <= order_minhash.EXACT or 9 * common < 4 * (len(a) + len(b)):
                continue
            row, keys = order_minhash._exact_keys(
                np.repeat([0, 1], [len(a), len(b)]), np.array(a + b, np.uint64), np.array([len(a), len(b)]))
            assert set(keys[row == 0]) & set(keys[row == 1]), (a, b)


def test_one_more_word_than_eight(spark):
    """Four of five shingles: similarity 0.8, in 30 pairs that share nothing with each other."""
    rows = []
    for i in range(30):
        words = [f"w{i}x{k}" for k in range(9)]
        rows += [(2 * i, " ".join(words[:8])), (2 * i + 1, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.id: r.class_id for r in order_minhash.classes(docs).collect()}
    assert found == {i: i - i % 2 for i in range(60)}


def test_common_passage_does_not_pair_all_texts(spark, one_bucket, monkeypatch):
    """Texts that share three of four words are in one bucket, but only the planted copies are compared and linked."""
    rng = random.Random(8)
    passage = " ".join(f"common{k}" for k in range(150))
    compared = []
    original = order_minhash._verified

    def counting(pairs, bodies):
        compared.append(pairs.count())
        return original(pairs, bodies)

    monkeypatch.setattr(order_minhash, "_verified", counting)
    numbers = {}
    for n in (250, 500, 1000):
        compared.clear()
        texts = {i: f"{passage} " + " ".join(f"own{i}x{k}" for k in range(50)) for i in range(n)}
        for i in range(0, n, 50):  # a copy with one word changed, far from its original
            texts[n + i] = texts[i].replace(f"own{i}x30", f"new{rng.random()}")
        assert one_bucket(texts) == {(i, n + i) for i in range(0, n, 50)}
        numbers[n] = sum(compared)
    assert numbers[1000] <= 2.5 * numbers[500] <= 6.25 * numbers[250]


def test_a_shingle_counts_once_more_where_it_is_repeated(spark):
    """The first of two equal shingles equals the only one of another text."""
    words = [f"w{k}" for k in range(60)]
    a, b = " ".join(words), " ".join(words + words[:6])
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string")
    assert {r.class_id for r in order_minhash.classes(docs).collect()} == {1}


def test_only_candidates_move_their_text(spark):
    rows = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("key"), F.lit("a text").alias("text"))
    wanted = rows.select("key").orderBy("key").limit(70)
    left = order_minhash._that_may_be(rows, wanted)
    assert left.join(wanted, "key", "left_semi").count() == 70
    assert left.count() <= 75 and left.columns == ["key", "text"]
    assert order_minhash._that_may_be(rows, wanted.limit(0)).count() == 0


def test_settled_groups_are_not_read_again(spark, monkeypatch):
    """Groups whose members have all met stay out of later rounds; a large group of unlike texts goes on."""
    sizes, original = [], order_minhash.materialize

    def counting(df, name, outlive=False):
        stored = original(df, name, outlive)
        if name == "unsettled-members":
            sizes.append(stored.count())
        return stored

    monkeypatch.setattr(order_minhash, "materialize", counting)
    # thirty pairs and a group of forty, with 32 of 48 shingles in common: one of these is among the first nine
    texts = [[f"p{i}w{k}" for k in range(36)] + [f"p{i}{side}{k}" for k in range(8)] for i in range(30) for side in "ab"]
    texts += [[f"run{k}" for k in range(36)] + [f"q{i}w{k}" for k in range(8)] for i in range(40)]
    rows = spark.createDataFrame([(f"k{i}", " ".join(t)) for i, t in enumerate(texts)], "key string, text string")
    nodes = spark.createDataFrame([(f"k{i}", i, len(t) - 4, [i // 2 if i < 60 else 1000]) for i, t in enumerate(texts)],
                                  "key string, node bigint, n bigint, buckets array<bigint>")
    assert order_minhash.find_links(rows, nodes).count() == 0
    assert len(sizes) > 1 and sizes[-1] == 0 and sizes == sorted(sizes, reverse=True)
    assert sizes[0] >= 40 and sizes[-2] % 40 == 0
