import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpuslab.llm import resampling
from corpuslab.llm.batches import slices
from corpuslab.llm.queries import QUERIES, SQL_RESAMPLING
from tests.compare import differences, oracle

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, most_words):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i:i + n]) for n in range(1, most_words + 1) for i in range(len(words) - n + 1)]


def expected(docs, targets, most_words=1, buckets=10000, share=10, least=20, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(d, *features(t, most_words)) for d, t in docs]
    s = Counter(bucket(f) for _, _, fs in own for f in fs)
    t = Counter(bucket(f) for x in targets for f in features(x, most_words)[1])
    S, T = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for d, n_words, fs in own:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        rows.append((d, n_words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = len(enough) * share // 100
    return sorted([(*r, k + 1 if k < drawn else None) for k, r in enumerate(enough)]
                  + [(*r, None) for r in rows if r[1] < least], key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_sql(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    frame = QUERIES["op12_importance_resampling"][0](spark, folder)
    assert differences("op12", frame, oracle(folder), SQL_RESAMPLING) == []


ODD = ([(k, f"Alpha beta{k % 7}, gamma-{k} ÉTÉ été a_b " * 6) for k in range(60)] + [
    (100, None), (101, ""), (102, " ,;\n"), (None, "null id " * 20), (None, "null id " * 20), (103, "word " * 200000),
    (104, "x" * 100000 + " y"), (105, "same words " * 15), (105, "same words " * 15), (106, "a\x00b\x7fc " * 10),
])


@pytest.mark.parametrize("most_words, share", [(1, 10), (2, 50), (3, 100)])
def test_odd_texts(spark, most_words, share):
    docs = spark.createDataFrame([(*r, 7, "own") for r in ODD], "doc_id bigint, text string, rank int, weight string")
    targets = ["alpha beta1 été", None, "", "same words same"]
    got = resampling.resampled(docs, spark.createDataFrame([(t,) for t in targets], "text string"),
                               most_words=most_words, share=share)
    assert found(got) == expected(ODD, targets, most_words, share=share)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame(ODD[:30], "doc_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, text string")
    assert resampling.resampled(none, docs).count() == 0
    assert found(resampling.resampled(docs, none)) == expected(ODD[:30], [])


def test_ranks_go_on_over_partitions_and_drawn_documents_keep_their_columns(spark):
    rows = [(k, f"w{k % 5} " * 25, "own") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string").repartition(7)
    targets = spark.createDataFrame([("w1 w1 w2",)], "text string")
    want = expected([r[:2] for r in rows], ["w1 w1 w2"])
    assert found(resampling.resampled(docs, targets)) == want
    kept = resampling.drawn(docs, targets)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in want if r[5]} and kept.count() == 300


def test_composed_checksums():
    rng = np.random.default_rng(1)
    a = [rng.bytes(int(n)) for n in rng.integers(0, 40, 200)]
    b = [rng.bytes(int(n)) for n in rng.integers(0, 3000, 200)]
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    got = resampling.composed(crc(a), crc(b), np.array([len(x) for x in b]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]


@pytest.mark.parametrize("most", [0, 50, 1 << 17])
def test_payloads_do_not_depend_on_the_dictionary(most, monkeypatch):
    monkeypatch.setattr(resampling, "FIRST_WORDS", 20)
    rng = np.random.default_rng(2)
    texts = [" ".join(f"W{n}é"[:int(m)] for n, m in zip(rng.zipf(1.3, 300) % 3000, rng.integers(1, 7, 300))) + rng.choice(["", ".", "  "])
             for _ in range(60)]
    known = resampling.Dictionary(most)
    for part in slices(pa.array(texts), 4000):
        row, crc, length = known.payloads(part)
        want = [(r, w.encode()) for r in range(len(part))
                for w in features(part.bytes_of(r).decode(), 1)[1]]
        assert row.tolist() == [r for r, _ in want]
        assert crc.tolist() == [zlib.crc32(w) for _, w in want] and length.tolist() == [len(w) for _, w in want]
    assert known.known <= most and (most == 0) == (known.automaton is None)
