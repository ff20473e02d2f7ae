"""Operators against their plain versions, on the small table and on odd rows."""

import functools
import math
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslab.llm import (
    automaton, batches, components, cotraining, decontamination, licenses, mixing, order_minhash, personal_data,
    ppm, quality_rules, secrets, token_files, voting,
)
from corpuslab.llm.queries import END_ID, tokenizer_file
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"
WORDS = [a + b for a in ("ka", "lo", "mi", "ren", "su", "ta") for b in ("do", "fe", "gin", "ho", "la", "na", "pe")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, texts and metadata; empty, blank and long texts; repeated rows; clashing columns."""
    rng = random.Random(11)
    long = prose(rng, 30_000)
    rows = [
        (1, prose(rng, 60)), (2, None), (3, ""), (4, "  \n\t "), (5, long), (5, long), (6, long + " end"),
        (None, "no id"), (None, None), (7, "a b"), (7, "a c"), (8, "word " * 50), (9, "Kelvin é \U0001f44d\n\n\nx"),
        (10, "x" * 100_000),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.select(
        "doc_id", "text", F.lit(None).cast("string").alias("lang"), F.when(F.col("doc_id") > 4, "s").alias("source"),
        F.lit(None).cast("bigint").alias("n_chars"), F.lit("own").alias("key"), F.lit("own").alias("spans"),
        F.lit("own").alias("n_words"), F.lit("own").alias("size"), F.lit("own").alias("_row"), F.lit("own").alias("label"))


# quality rules

def test_quality_counts_equal_the_plain_ones(odd, documents, texts):
    for df in (documents, odd):
        found = quality_rules.features(df.select("doc_id", "text")).collect()
        assert len(found) == df.count()
        for r in found:
            assert tuple(r[c] for c in quality_rules.FEATURES) == brute.quality_counts(r.text)
            assert r.base_failed == brute.base_failed(r.text)


def test_quality_verdict_agrees_with_labels(spark, documents):
    voted = quality_rules.features(documents)
    judged = quality_rules.judge(voted, quality_rules.fit(voted))
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    seen = judged.where("not base_failed").join(labels, "doc_id").select("kept", "quality").collect()
    assert np.mean([r.kept == bool(r.quality) for r in seen]) >= 0.95
    assert judged.columns == [*[c for c in documents.columns], *quality_rules.FEATURES, "base_failed", "posterior", "kept"]


def test_a_filter_on_the_counts_does_not_repeat_their_work(spark):
    """Long texts, with and without repeats, filtered before anything is stored."""
    import time

    rng = random.Random(1)
    rows = [(1, prose(rng, 20_000)), (2, (prose(rng, 40) + "\n") * 500), (3, "short")]
    found = quality_rules.features(spark.createDataFrame(rows, "doc_id bigint, text string"))
    begin = time.time()
    kept = found.where("not base_failed and n_repeat_words < 10").select("doc_id", *quality_rules.FEATURES).collect()
    assert [r.doc_id for r in kept] == [1] and time.time() - begin < 30
    assert tuple(kept[0])[1:] == brute.quality_counts(rows[0][1])


def test_reliability_is_found_from_agreement(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(4000):
        good = rng.random() < 0.8
        rows.append(tuple((1 if good else -1) * (1 if rng.random() < right else -1) if rng.random() < voting_ else 0
                          for right, voting_ in ((0.95, 0.9), (0.9, 0.8), (0.85, 0.9), (0.5, 0.9))))
    model = voting.fit_reliability(spark.createDataFrame(rows, "a int, b int, c int, d int"), ["a", "b", "c", "d"])
    found = [model.accuracy(k) for k in range(4)]
    assert abs(model.prior - 0.8) < 0.06 and found[0] > 0.9 and found[1] > 0.85 and found[3] < 0.75


# near-duplicates

def test_near_classes_equal_the_plain_ones(documents, texts):
    found = {r.id: r.class_id for r in order_minhash.classes(documents).collect()}
    assert found == brute.near_classes(texts)


def test_large_groups_of_copies_and_a_common_passage(spark):
    rng = random.Random(2)
    base, passage = prose(rng, 120).split(), prose(rng, 60)
    rows = []
    for i in range(120):  # near copies of one text: one word differs
        own = list(base)
        own[i] = f"changed{i}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(base)) for i in range(100)]
    rows += [(2000 + i, f"{prose(rng, 80)} {passage} {prose(rng, 80)}") for i in range(100)]
    found = {r.id: r.class_id for r in order_minhash.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {found[i] for i, _ in rows if i < 2000} == {0}
    assert all(found[2000 + i] == 2000 + i for i in range(100))


def test_one_row_of_each_class_stays(odd):
    kept = order_minhash.deduplicated(odd)
    assert kept.columns == odd.columns
    left = sorted(r.doc_id or 0 for r in kept.collect())
    assert left == [0, 1, 2, 4, 5, 7, 7, 8, 9, 10]  # null and empty texts are equal; 6 is near 5
    assert kept.where("doc_id = 5").count() == 1 and kept.where("doc_id = 6").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=40), st.lists(st.integers(0, 30), max_size=40))
def test_similarity_is_common_in_order_over_all(a, b):
    a, b = list(dict.fromkeys(a)), list(dict.fromkeys(b))
    longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            longest[i + 1][j + 1] = longest[i][j] + 1 if x == y else max(longest[i][j + 1], longest[i + 1][j])
    common = longest[-1][-1]
    expected = common / (len(a) + len(b) - common) if a and b else 0.0
    found = order_minhash.similarity(np.array(a, np.uint64), np.array(b, np.uint64))
    assert (found >= 0.8) == (expected >= 0.8) and (expected < 0.8 or found == pytest.approx(expected))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (3, 2)]
    found = {r.key: r.label for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(20)}}


# decontamination

def test_planted_passages_are_found(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, n).replace(" ", "x ")) for i, n in enumerate((40, 25, 13, 9))]
    rows = [(i, prose(rng, 150)) for i in range(30)]
    for k, (i, text) in enumerate(items):
        words = text.split()
        rows.append((100 + k, f"{prose(rng, 50)} {text.upper()} {prose(rng, 30)}"))
        if len(words) > 20:
            words[4::7] = [f"sub{j}" for j in range(len(words[4::7]))]  # every seventh word replaced
            rows.append((200 + k, f"{prose(rng, 50)} {' '.join(words)} {prose(rng, 30)}"))
            rows.append((300 + k, f"{prose(rng, 50)} {' '.join(text.split()[3:9])} {prose(rng, 30)}"))  # too short
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([*items, (9, None), (10, "")], "item_id bigint, text string")
    flagged = decontamination.contaminated(docs, bench)
    left = {r.doc_id for r in decontamination.remove_contaminated(docs, bench).collect()}
    expected = {i for i, t in rows if not any(brute.shared_passage(t, b) for _, b in items)}
    assert left == expected and flagged.count() == len(rows) - len(expected)
    assert {100, 101, 102, 103, 200, 201}.isdisjoint(left) and {300, 301} <= left


# mixing

def test_schedules_are_inverted(spark):
    for schedule in (*mixing.BY_RANK, ((0.0, 1.0), (0.3, 4.0), (1.0, 0.0))):
        shares = [k / 50 for k in range(51)]
        df = spark.createDataFrame([(x,) for x in shares], "x double")
        found = [r.t for r in df.select("x", mixing.position(F.col("x"), schedule).alias("t")).orderBy("x").collect()]
        grid = np.linspace(0, 1, 100_001)
        weight = np.interp(grid, [t for t, _ in schedule], [w for _, w in schedule])
        due = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
        assert np.allclose(np.interp(found, grid, due / due[-1]), shares, atol=1e-4)


def test_mix_meets_targets_and_sorts_by_time(spark, odd):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(1, 40)), "abc"[i % 3] if i % 10 else None) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    plan = mixing.planned(mixing.sized(docs)).collect()
    for source in ("a", "b", "c", None):
        own = [r for r in plan if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 40 and all(r.taken <= 3 * r["size"] for r in own)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in plan)
    first_half = [r.source for r in mixed.limit(mixed.count() // 2).collect()]
    assert first_half.count("a") > 0.6 * sum(r.copies for r in plan if r.source == "a")  # falls over time
    assert mixing.mix(odd).columns == odd.columns


# token files

@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=700), max_size=5), st.booleans())
def test_images_round_trip(docs, small):
    docs = [[x % 50_000 for x in d] if small else d for d in docs]
    ids = np.array([x for d in docs for x in d], np.uint32)
    back, lengths = token_files.read_image(token_files.write_image(ids, np.array([len(d) for d in docs], np.int64)))
    assert (back == ids).all() and lengths.tolist() == [len(d) for d in docs]


PIECES = [" ", "  ", "\n", "\n\n", "\t", "a", "The", "it's", "'ll", " 's", "1", "12", "!", "?!", ".", "...", "é",
          "\x1c", "\x85", " ", "<|endoftext|>", "word", "’", "\r\n", "ß", "日本", "\U0001f44d"]


@functools.cache
def encoders():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file()), token_files.Encoder(tokenizer_file(), END_ID)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), max_size=4))
def test_pieces_encode_as_whole_texts_do(texts):
    whole, encoder = encoders()
    encoder._forget()  # as a new one
    for _ in range(2):  # new pieces, then known ones
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [
            [*whole.encode(t, add_special_tokens=False).ids, END_ID] for t in texts]


def test_words_of_any_letters_encode_as_whole_texts_do():
    rng = random.Random(5)
    letters = "abcdefgzABZéßñøджשא日本語ªºʰǅ"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(9000)]
    texts = [" ".join(made[i:i + 30]) for i in range(0, len(made), 30)]
    whole, encoder = encoders()
    encoder._forget()
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [
        [*whole.encode(t, add_special_tokens=False).ids, END_ID] for t in texts]


def test_a_worker_holds_one_encoder():
    first = token_files.worker_encoder(tokenizer_file(), END_ID)
    assert token_files.worker_encoder(tokenizer_file(), END_ID) is first
    assert token_files.worker_encoder(tokenizer_file(), END_ID + 1).encode([""]) == [np.array([END_ID + 1], "<u4").tobytes()]


def test_digests_equal_a_plain_encoder(spark, documents, odd):
    import zlib

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_file())
    special = spark.createDataFrame([(1, "a <|endoftext|> b"), (3, "<|endoftext|>"), (2, "<|endoftext|><|endoftext|> x")], "doc_id bigint, text string")
    for df in (documents.select("doc_id", "text"), special):
        at, expected = 0, []
        for r in df.orderBy("doc_id").collect():
            ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, END_ID]
            expected.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert sorted(map(tuple, token_files.round_trip(df, tokenizer_file(), END_ID).collect())) == expected


def test_token_files_keep_order_and_all_rows(odd):
    found = sorted(token_files.round_trip(odd, tokenizer_file(), END_ID).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted([r.doc_id for r in odd.collect()], key=lambda i: (i is not None, i))
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
    assert [r.n_tokens for r in found if r.doc_id in (2, 3)] == [1, 1]


# language model

def test_ppm_equals_the_plain_model(spark, documents, texts):
    few = {i: t for i, t in texts.items() if i < 60} | {1001: None, 1002: "", 1010: "é日 new"}
    df = spark.createDataFrame(list(few.items()), "doc_id bigint, text string")
    expected = brute.ppm_scores(few)
    found = {r.doc_id: tuple(r)[1:] for r in ppm.score(df).collect()}
    assert found.keys() == expected.keys()
    for i, row in found.items():
        assert row[:4] == expected[i][:4]
        assert row[4:] == pytest.approx(expected[i][4:], rel=1e-9)


# licenses

def test_license_places_equal_the_plain_ones(spark, documents, texts, odd):
    for df in (documents.select("doc_id", "text"), odd):
        plain = {(r.doc_id, r.text): None for r in df.select("doc_id", "text").collect()}
        found = licenses.scan(df.withColumn("copy", F.col("text"))).collect()
        assert len(found) == df.count() and plain
        for r in found:
            n, places, labels = brute.phrase_places(r["copy"], licenses.PHRASES)
            assert (r.n_words, r.n_base, r.base_labels) == (n, len(places), ",".join(sorted(labels)))
            assert (r.first_word, r.last_word) == ((places[0], places[-1]) if places else (None, None))
            assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_every_block_that_contains_a_template_is_found(spark):
    rng = random.Random(8)
    rows, expected = [], {}
    for i in range(300):
        number = rng.randrange(len(licenses.TEMPLATES))
        notice = licenses.TEMPLATES[number][1].split()
        kept = [w for w in notice if rng.random() < 0.85]
        words = prose(rng, 30).split() + kept + prose(rng, 45).split()
        rows.append((i, " ".join(words)))
        best, named = 0.0, set()
        for start in range(0, len(words), licenses.STRIDE):
            block = set(words[start:start + 2 * licenses.STRIDE])
            shares = [(len(block & set(ws)) / len(ws), label) for ws, (label, _) in zip(licenses._WORDS, licenses.TEMPLATES)]
            for k, (share, label) in enumerate(shares):
                a = set(licenses._WORDS[k])
                better = [o for o, (s, _) in enumerate(shares) if (s, len(licenses._WORDS[o])) > (share, len(a))
                          and len(a & set(licenses._WORDS[o])) >= 0.8 * min(len(a), len(set(licenses._WORDS[o])))]
                if share >= licenses.CONTAINED - 1e-12 and not better:
                    named.add(label)
                    best = max(best, share)
        expected[i] = (",".join(sorted(named)), best)
    found = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).where("n_base = 0").collect()
    assert found and all((r.labels, r.score) == (expected[r.doc_id][0], pytest.approx(expected[r.doc_id][1])) for r in found)


def test_two_licenses_in_one_block_are_both_found(spark):
    bsd = "redistribution and use in source and binary forms with or without alteration are allowed".split()
    text = " ".join(["code", *bsd, "or", "released", "under", "the", "mit", "license"])
    gnu = "licensed under the gnu lesser general public license version 3"
    found = licenses.scan(spark.createDataFrame([(1, text), (2, gnu)], "doc_id bigint, text string"))
    assert {r.doc_id: r.labels for r in found.collect()} == {1: "bsd,mit", 2: "lgpl"}


# personal data

def test_many_matches_in_one_text_take_about_linear_time(spark):
    import time

    seconds = {}
    for n in (2_000, 16_000):
        text = " ".join(f"mail a{k}@b.com" for k in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
        begin = time.time()
        spans = personal_data.find(docs).first().spans
        seconds[n] = time.time() - begin
        base = [(s.kind, s.start, s.end) for s in spans if s.is_base]
        assert len(base) == n and base == brute.personal_spans(text)
    assert seconds[16_000] < 16 * max(seconds[2_000], 1)


FRAGMENTS = ["a@b.com", "x.y@mail.example.org", "@", ".", "1.2.3.4", "300.1.1.1", "001.02.3.255", "4111 1111 1111 1111", "4111111111111112",
             "+1 (017) 555-7713", "+12", "-", " ", "\n", "é", "\U0001f44d", "5", "12", "_", "a", "mail ", "version ", "123-45-6789", "Dr. John Smith"]


def test_base_spans_equal_the_plain_ones(spark, documents, odd):
    rng = random.Random(6)
    made = [(i, "".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    for df in (spark.createDataFrame(made, "doc_id bigint, text string"), documents.select("doc_id", "text"), odd):
        found = personal_data.find(df.withColumn("copy", F.col("text"))).collect()
        assert len(found) == df.count()
        for r in found:
            base = [(s.kind, s.start, s.end) for s in r.spans if s.is_base]
            assert base == brute.personal_spans(r["copy"])
            places = [(s.start, personal_data.KINDS.index(s.kind)) for s in r.spans]
            assert places == sorted(places)


def test_the_classifier_weighs_what_labelers_say(spark):
    rng = random.Random(3)
    rows = [(i, f"{prose(rng, 10)} dear Dr. {rng.choice(personal_data.GIVEN)} ssn 123-45-6789 mail a{i}@b.com {prose(rng, 5)}") for i in range(50)]
    proposed = personal_data.proposals(spark.createDataFrame(rows, "doc_id bigint, text string"))
    model, odds = personal_data.fit(proposed)
    kinds = {s.kind for r in personal_data.decide(proposed, odds).collect() for s in r.spans}
    assert {"email", "ssn", "name"} <= kinds and model.accuracy(0) > 0.6


# secrets

PARTS = ["password", "Passwd", " ", "=", ":", "'", '"', "token", "TOKEN", "api_key", "apikey", "secret", "AKIA", "ABCDEF0123",
         "0123456789abcdef", "é", "\n", "x", "abc=", "==", "/", "deadbeef" * 4, "AKIAAKIA1234567890", "word"]


def test_secret_spans_equal_the_plain_ones(spark, documents, odd):
    rng = random.Random(1)
    made = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))) for i in range(600)]
    for df in (spark.createDataFrame(made, "doc_id bigint, text string"), documents, odd):
        found = secrets.scan(df).collect()
        assert len(found) == df.count()
        kinds = {k for k, *_ in secrets.BASE_RULES}
        for r in found:
            assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in kinds] == brute.secret_spans(r.text)
    more = spark.createDataFrame([(1, "x ghp_" + "a1B2" * 9 + " -----BEGIN RSA PRIVATE KEY----- https://me:pw@host")], "doc_id bigint, text string")
    assert [s.kind for s in secrets.scan(more).first().spans] == ["github", "pem", "login"]


MORE_PARTS = ["ghp_", "ghs_", "a1B2" * 9, "xoxb-", "12345-abcdef", "AIza", "Sy_-x" * 8, "sk_live_", "rk_live_", "0a1B" * 6, "eyJ",
              "eyJhbGci", ".", "eyJ0_-", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "-----", "https://", "redis://", "me", ":", "p%w", "@",
              " ", "\n", "é", "ftp://a:b@c"]


def test_added_secret_kinds_equal_the_plain_ones(spark):
    rng = random.Random(2)
    made = [(i, "".join(rng.choice(MORE_PARTS) for _ in range(rng.randint(0, 40)))) for i in range(3000)]
    found = secrets.scan(spark.createDataFrame(made, "doc_id bigint, text string")).collect()
    kinds = [k for k, *_ in secrets.MORE_RULES]
    seen = set()
    for r in found:
        own = [(s.kind, s.start, s.end) for s in r.spans if s.kind in kinds]
        assert own == brute.matches(r.text, secrets.MORE_RULES)
        seen |= {kind for kind, _, _ in own}
    assert seen == set(kinds)


def test_many_secrets_in_one_line_in_linear_time(spark):
    n = 50_000
    units = ["password=abcdefgh ", "eyJ", "AKIA", "deadbeef", "-----BEGIN ", "https://a:"]
    docs = spark.createDataFrame([(i, u * n) for i, u in enumerate(units)], "doc_id bigint, text string")
    began = time.time()
    found = {r.doc_id: r.spans for r in secrets.scan(docs).collect()}
    assert time.time() - began < 60
    assert [len(found[i]) for i in range(len(units))] == [n, 0, 1, 1, 0, 0]
    assert (found[3][0].start, found[3][0].end) == (0, 8 * n)


@pytest.mark.parametrize("few", [1, 1000])
@pytest.mark.parametrize("patterns", [
    (r"a(b|c)*d?",), (r"[b-d]x",), (r"(ab|a)c+",), (r"x{3,}y",), (r"\x20\.+",),
    (r"a(b|c)*d?", r"[b-d]x", r"(ab|a)c+", r"x{3,}y", r"\x20\.+", r"b+")])
def test_automata_match_as_patterns_do(patterns, few, monkeypatch):
    monkeypatch.setattr(automaton, "FEW", few)  # ranges side by side, or each by the plain loop
    monkeypatch.setattr(automaton, "BLOCK", 5)
    rules = [(p, False) for p in patterns]
    forward, backward = automaton.compile_rules(rules), automaton.compile_rules(rules, backward=True)
    rng = random.Random(str(patterns))
    texts = ["".join(rng.choice("abcdxy .") for _ in range(rng.randint(0, 14))) for _ in range(600)]
    edges = np.cumsum([0] + [len(t) for t in texts])
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    found = sorted(automaton.leftmost_longest(forward, backward, data, edges[:-1], edges[1:]))
    assert found == sorted((int(first) + m.start(), rule, int(first) + m.end()) for first, text in zip(edges, texts)
                           for rule, p in enumerate(patterns) for m in re.finditer(p, text))


def test_minimal_automata_have_no_equal_states():
    machine = automaton.compile_rules([("(a|b)c", False), ("ac", False)])
    assert len(machine.accepts) == 6  # start, after a, after b, both, one, none


# quality classifier

def test_classifier_on_labels_it_has_not_seen(spark, documents):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where("quality = 1 or toxic = 0")
    seen = labels.where("doc_id % 3 > 0")
    model = cotraining.fit(documents, seen)
    found = cotraining.score(documents, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == bool(r.quality) for r in found]) >= 0.9
    assert all(0 <= r.score <= 1 and 0 <= r.toxicity <= 1 for r in found)


def test_classifier_learns_from_every_unlabelled_row(spark, documents, odd):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    known = {r.doc_id for r in labels.where("quality is not null and toxic is not null").collect()}
    ids = [r.doc_id for r in documents.select("doc_id").collect()]
    several = documents.unionByName(documents.where("doc_id % 3 = 0"))  # repeated rows count
    expected = sum(1 + (i % 3 == 0) for i in ids if i not in known)
    assert cotraining.fit(several, labels).pool == expected > 0
    first = spark.createDataFrame([(1, 1, 0), (8, 0, 0), (5, 1, 1), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert cotraining.fit(odd, first).pool == odd.count() - 4  # 1, 5 twice, 8; null ids are in the pool


def test_classifier_agrees_with_a_plain_version(spark, documents):
    some = documents.where("doc_id < 300")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where("doc_id % 2 = 0")
    model = cotraining.fit(some, labels)
    rows = [(r.doc_id, r.text or "", r.lang, r.source, r.n_chars) for r in some.collect()]
    plain = brute.cotrained(rows, {r.doc_id: {"quality": r.quality, "toxic": r.toxic} for r in labels.collect()})
    for head in cotraining.HEADS:
        for own, other in zip(model.weights[head], plain[head]):
            assert np.abs(own - other).max() < 1e-3


def test_shares_take_the_wanted_number_and_split_the_last_bin():
    assert cotraining.shares(np.array([4, 0, 8, 2]), 5).tolist() == [0, 0, 3 / 8, 1]
    assert cotraining.shares(np.array([4, 0, 8, 2]), 99).tolist() == [1, 0, 1, 1]


def test_classifier_without_labels_or_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    scored = cotraining.score(odd, cotraining.fit(odd, none)).collect()
    assert len(scored) == odd.count() and all(not math.isnan(r.score) for r in scored)


# all of them

def test_empty_tables(spark, odd):
    empty = odd.where("doc_id < 0")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    voted = quality_rules.features(empty)
    assert quality_rules.judge(voted, quality_rules.fit(voted)).count() == 0
    assert order_minhash.classes(empty).count() == 0 and order_minhash.deduplicated(empty).count() == 0
    assert decontamination.overlaps(empty, bench).count() == 0
    assert decontamination.remove_contaminated(odd, bench).count() == odd.count()
    assert mixing.mix(empty).count() == 0
    assert token_files.round_trip(empty, tokenizer_file(), END_ID).count() == 0
    assert ppm.score(empty).count() == 0
    assert licenses.scan(empty).count() == 0 and personal_data.find(empty).count() == 0
    assert secrets.scan(empty).count() == 0
    assert cotraining.score(empty, cotraining.fit(empty, labels)).count() == 0


def test_slices_cover_all_rows():
    import pyarrow as pa

    column = pa.array(["ab", None, "", "c" * 50, "d"]).slice(1)
    runs = list(batches.slices(column, limit=10))
    assert [t.bytes_of(i) for t in runs for i in range(len(t))] == [b"", b"", b"c" * 50, b"d"]
