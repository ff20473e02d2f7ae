"""Near-duplicates by Order MinHash, verified by banded alignment.

A sketch samples, for each of several hash functions, the few smallest shingles of five
words, each labelled with its occurrence, and keeps them in text order; texts that agree on
one sketch are candidates. Short texts have keys that miss no similar pair. Candidates are compared by the longest common run of shingles in
order, within the band of diagonals that similarity 0.8 allows.

Equal texts are folded first, so groups of copies cost one text. First each bucket's members
are compared with one leader, which settles buckets of one class. Members of buckets that stay
open, as where many different texts share a long passage, are dealt anew, to groups that share
a rare shingle: with all shingles in one order, frequent ones last, texts at the similarity
share one of the first n - 0.8 n + 1 of both, and a common passage is not among these. Texts
whose shingle parities differ in more bits than similar texts have shingles of their own are
not compared. Within such a group each round compares a few leaders with a few members of other classes, then with
more, until the group has one class or all members outside its largest class have met all
others. So every similar pair of a bucket is linked or was found to be in one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.batches import Texts, U, WHITE_SPACE, mix, slices, windows, words
from corpuslab.llm.components import components
from corpuslab.session import materialize, scratch_scope

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 24
SAMPLED = 5  # shingles per sketch; at similarity 0.8 a pair misses all sketches once in 15,000
EXACT = 18  # texts with up to so many shingles have exact keys; those with up to 14 have no sketches
KEY_SHINGLES = 3  # shingles that an exact key holds
LEADERS = 6  # each round has this many times the leaders, and members that meet them, of the last
PARITIES = 256  # bits that say of a text's shingles, hashed to them, whether their number is odd
KEY_BITS = 1 << 24  # of the table that tells which texts need not move
SLICE = 1 << 18  # bytes of text at a time, as each byte takes some 45 of a worker's memory
COUNTERS = 1 << 20  # of shingles, shared by those that fall on one; they only set the order
_TOP = U(0xFFFFFFFFFFFFFFFF)


def labelled_shingles(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle, in text order; repeats within a text get another hash.

    A text of one to four words is one shingle; a text without words has none.
    """
    w = words(texts, WHITE_SPACE)
    value = windows(w.hash, tuple(range(SHINGLE)))
    whole = w.row[:len(value)] == w.row[SHINGLE - 1:SHINGLE - 1 + len(value)]
    row, value = w.row[:len(value)][whole], value[whole]
    n_words = np.diff(w.first)
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):
        own = np.array([windows(w.hash[w.first[r]:w.first[r + 1]], tuple(range(n_words[r])))[0] for r in short], np.uint64)
        row, value = np.concatenate([row, short]), np.concatenate([value, own])
        order = np.argsort(row, kind="stable")
        row, value = row[order], value[order]
    own = mix(value ^ mix(row.astype(np.uint64) + U(1)))
    ordered = np.sort(own)
    repeated = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(repeated):
        at = np.flatnonzero(np.isin(own, repeated))
        at = at[np.argsort(own[at], kind="stable")]
        run_start = np.concatenate([[True], own[at][1:] != own[at][:-1]])
        place = np.arange(len(at))
        occurrence = place - np.maximum.accumulate(np.where(run_start, place, 0))
        at, occurrence = at[occurrence > 0], occurrence[occurrence > 0]  # the first is as if alone
        value[at] = mix(value[at] + occurrence.astype(np.uint64) * U(0xA24BAED4963EE407))
    return row, value


def _sketches(row: np.ndarray, value: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles per row, and per row with any the keys of its sketches."""
    counts = np.bincount(row, minlength=n_rows)
    some = np.flatnonzero(counts)
    sizes = counts[some]
    keys = np.empty((len(some), SKETCHES), np.uint64)
    owner = np.repeat(np.arange(len(some)), sizes)
    # of longer rows, only values that small can be among the smallest, but for a rare case
    limit = np.where(sizes <= 6 * SAMPLED, _TOP, (2.0 ** 64 * np.minimum(6 * SAMPLED / sizes, 0.99)).astype(np.uint64))
    limit = limit[owner]
    for s in range(SKETCHES):
        ranked = mix(value ^ U((s * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64)))
        at = np.flatnonzero(ranked <= limit)
        found = np.bincount(owner[at], minlength=len(some))
        if (found < np.minimum(sizes, SAMPLED)).any():
            at = np.arange(len(value))
            found = sizes
        at = at[np.lexsort((ranked[at], owner[at]))]
        place = np.arange(SAMPLED)
        pick = np.minimum((np.cumsum(found) - found)[:, None] + place, max(len(at) - 1, 0))
        there = place < found[:, None]
        places = np.where(there, at[pick], np.iinfo(np.int64).max) if len(at) else np.zeros((0, SAMPLED), np.int64)
        places.sort(axis=1)  # back to text order
        key = np.full(len(some), s + 1, np.uint64)
        for k in range(SAMPLED):
            label = np.where(places[:, k] < len(value), value[np.minimum(places[:, k], len(value) - 1)], U(k))
            key = mix(key * U(0x9FB21C651E98DF25) + label)
        keys[:, s] = key
    return counts, keys


def _exact_keys(row: np.ndarray, value: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and key, such that texts at the similarity with up to ``EXACT`` shingles each share a key.

    Of n shingles, a similar text holds at least m = 0.8 n. With all shingles in one fixed
    order, two such texts share any l <= m of them among the first n - m + l of both; a key
    is the hash of l of these.
    """
    starts = np.cumsum(counts) - counts
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n in range(1, EXACT + 1):
        own = np.flatnonzero(counts == n)
        if len(own) == 0:
            continue
        ranked = mix(value[starts[own][:, None] + np.arange(n)] ^ U(0x5851F42D4C957F2D))
        ranked.sort(axis=1)
        size = min(n, KEY_SHINGLES)  # a similar text has as many shingles, or both have three or more
        for chosen in combinations(range(n - (4 * n + 4) // 5 + size), size):
            key = np.full(len(own), SKETCHES + 1, np.uint64)
            for k in chosen:
                key = mix(key * U(0x9FB21C651E98DF25) + ranked[:, k])
            rows.append(own)
            keys.append(key)
    return np.concatenate(rows), np.concatenate(keys)


def sketched(rows: DataFrame) -> DataFrame:
    """(key, text, id) to (key, id, n, buckets): number of shingles and sketch keys."""
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text"), SLICE):
                row, value = labelled_shingles(texts)
                counts, keys = _sketches(row, value, len(texts))
                some = np.flatnonzero(counts)
                long = 5 * counts[some] > 4 * EXACT  # may be similar to a text without exact keys
                owner, exact = _exact_keys(row, value, counts)
                owner = np.concatenate([np.repeat(some[long], SKETCHES), owner])
                order = np.argsort(owner, kind="stable")
                keys = np.concatenate([keys[long].reshape(-1), exact])[order]
                ends = np.searchsorted(owner[order], np.arange(len(texts) + 1)).astype(np.int32)
                buckets = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64)))
                part = batch.slice(texts.first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("id"), pa.array(counts.astype(np.int64)), buckets],
                    names=["key", "id", "n", "buckets"])

    return rows.select("key", "id", "text").mapInArrow(run, f"key string, id {id_type}, n bigint, buckets array<bigint>")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Common shingles in order / all shingles of both, inside the band; 0 if surely below 0.8.

    Labelled shingles are distinct within a text, so the longest common run in order is the
    longest increasing run of matched places. A pair at 0.8 or more has at most
    (len(a) + len(b)) / 9 unmatched shingles, which bounds how far a match can shift.
    """
    if len(a) == 0 or len(b) == 0:
        return 0.0
    total = len(a) + len(b)
    # whole numbers, so that pairs at exactly 0.8 stay: common / (total - common) >= 4 / 5
    if 9 * abs(len(a) - len(b)) > total:
        return 0.0
    order = np.argsort(b)
    place = np.minimum(np.searchsorted(b, a, sorter=order), len(b) - 1)
    found = order[place]
    at = np.flatnonzero(b[found] == a)
    found = found[at]
    near = 9 * np.abs(found - at) <= total
    found = found[near]
    common = len(found)
    if 9 * common < 4 * total:
        return 0.0
    if common > 1 and not (np.diff(found) > 0).all():
        common = _longest_increasing(found)
    return common / (total - common)


def _longest_increasing(places: np.ndarray) -> int:
    from bisect import bisect_left

    tails: list[int] = []
    for p in places.tolist():
        k = bisect_left(tails, p)
        if k == len(tails):
            tails.append(p)
        else:
            tails[k] = p
    return len(tails)


def _similar(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, text_a, text_b) that reach the similarity, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            keys = batch.column("a").to_pylist()
            close = np.zeros(len(keys), bool)
            for texts in slices(batch.column("text_b"), SLICE):
                row, value = labelled_shingles(texts)
                ends = np.searchsorted(row, np.arange(len(texts) + 1))
                for r in range(len(texts)):
                    i = texts.first + r
                    if leader[0] != keys[i]:
                        own = next(slices(batch.column("text_a").slice(i, 1)))
                        leader = keys[i], labelled_shingles(own)[1]
                    close[i] = similarity(leader[1], value[ends[r]:ends[r + 1]]) >= SIMILARITY
            yield pa.RecordBatch.from_arrays(
                [batch.column(n).filter(pa.array(close)) for n in ("a", "b")], names=["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def text_key(text: str):
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def classes(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, class_id, key) for each row: rows of one class are exact or near copies.

    ``class_id`` is the smallest id of the class. Equal texts (null counts as empty) are one
    class; a text without words is linked to its equals only. Rows with a null id get a class
    like any other; the id is null only for classes without any id. Repeated rows stay repeated.
    """
    rows = docs.select(text_key(text).alias("key"), F.col(id).alias("id"), F.col(text).alias("text"))
    own = _labelled(rows)
    least = own.groupBy("label").agg(F.min("id").alias("class_id"))
    return own.join(least, "label").select(F.col("id"), "class_id", "key")


def _labelled(rows: DataFrame) -> DataFrame:
    """(key, id, label) of (key, id, text); what it takes to get there is removed from the scratch folder."""
    with scratch_scope(rows.sparkSession):
        sketches = materialize(sketched(rows), "sketches")
        labels = labelled_texts(rows, sketches)
        own = sketches.select("key", "id").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
        return materialize(own, "labelled-rows", outlive=True)


def labelled_texts(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """For texts that have near copies: (key, label), equal within a class."""
    texts = sketches.groupBy("key").agg(F.first("n").alias("n"), F.first("buckets").alias("buckets"))
    # short numbers stand for the keys from here on; stored, so that they stay the same
    texts = materialize(texts.withColumn("node", F.monotonically_increasing_id()), "distinct-texts")
    named = texts.select("key", "node")
    return _linked(rows, texts)[1].join(named, "node").select(
        "key", F.col("label").alias("l")).join(
        named.select(F.col("node").alias("l"), F.col("key").alias("label")), "l").select("key", "label")


def deduplicated(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row of each class, the one with the smallest id; columns stay as they are.

    Rows without an id come last. Of rows that repeat the same id and text one stays.
    """
    rows = docs.select(text_key(text).alias("key"), F.col(id).alias("id"), F.col(text).alias("text"))
    own = _labelled(rows)
    kept = own.groupBy("label").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("k")).select(
        F.col("k.id").alias("_kept_id"), F.col("k.key").alias("_kept_key"))
    found = docs.withColumn("_own_key", text_key(text)).join(
        kept, (F.col("_own_key") == F.col("_kept_key")) & F.col(id).eqNullSafe(F.col("_kept_id")), "left_semi")
    return found.dropDuplicates(["_own_key", id]).select(*[F.col(f"`{c}`") for c in docs.columns])


def find_links(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links (a, b) between different texts, by node, from (key, node, n, buckets).

    Links that join texts already known to be of one class may be left out.
    """
    return _linked(rows, texts)[0]


def _linked(rows: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links, and (node, label) of every linked text."""
    entries = texts.select("node", "n", F.explode("buckets").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    members = entries.join(shared, "bucket").select(
        "node", "n", "bucket", F.lit(0).cast("long").alias("place"), F.array().cast("array<bigint>").alias("parity"))
    members = materialize(members, "bucket-members")
    wanted = texts.select("key", "node").join(members.select("node").distinct(), "node", "left_semi")
    bodies = materialize(
        _that_may_be(rows.select("key", "text"), wanted).join(wanted, "key").groupBy("node").agg(F.first("text").alias("text")), "candidate-texts")

    first = members.groupBy("bucket").agg(F.min(F.struct("node", "n", "place", "parity")).alias("l")).select("bucket", *_leader())
    tested = materialize(_near_in_size(members.join(first, "bucket").where("node <> leader")), "pairs")
    links = materialize(_verified(tested, bodies), "links")
    labels = components(links).withColumnRenamed("key", "node")
    members, _ = _open_groups(members, labels)
    members = materialize(_by_rare_shingle(members, bodies), "group-members")

    reach, led, is_new = LEADERS, None, True
    while True:
        if is_new:  # else all labels are as they were
            labelled, main = _open_groups(members, labels)
            labelled = materialize(labelled.join(main, "bucket"), "open-members")
            members = labelled.select("node", "n", "place", "parity", "bucket")  # settled groups stay out
        stride = F.ceil(F.col("size") / reach)  # 1: all members of the group take part
        # a pair of two classes has a member outside the largest, so that one need not lead
        able = labelled.where("label <> main")
        if led is not None:
            able = able.join(led.withColumnRenamed("leader", "node"), ["bucket", "node"], "left_anti")
        split = F.pmod(F.xxhash64("node"), F.lit(reach))
        leaders = able.groupBy("bucket", split.alias("part")).agg(
            F.min(F.struct("node", "n", "place", "parity", "label")).alias("l"), F.first("size").alias("of"),
            F.count(F.lit(1)).alias("able")).select("bucket", *_leader(), F.col("l.label").alias("leader_label"), "of", "able")
        leaders = materialize(leaders, "leaders")
        if leaders.isEmpty():
            return links, labels
        partners = labelled.where(F.pmod(F.xxhash64("node", F.lit(1)), stride) == 0)
        pairs = _near_in_size(partners.join(leaders, "bucket").where("label <> leader_label"))
        pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        # each round's state is stored whole, so that plans do not grow with the rounds
        found = materialize(_verified(pairs, bodies), "links")
        is_new = not found.isEmpty()
        if is_new:
            links = materialize(links.unionByName(found), "links")
            labels = materialize(_merged(labels, found), "labels")
        tested = materialize(tested.unionByName(pairs), "tested")
        # a group whose members outside the largest class have all met all others is settled, whatever its classes are later
        unsettled = materialize(leaders.where((F.col("of") > reach) | (F.col("able") > 1)).select("bucket").distinct(), "unsettled")
        labelled = materialize(labelled.join(unsettled, "bucket", "left_semi"), "unsettled-members")
        members = labelled.select("node", "n", "place", "parity", "bucket")
        own = leaders.where(F.col("of") <= reach).select("bucket", "leader")  # these have met all
        led = materialize((own if led is None else led.unionByName(own)).join(unsettled, "bucket", "left_semi"), "led")
        reach *= LEADERS


def _that_may_be(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows without most of those whose key is not wanted, by a bit table of fixed size, so that their text does not move."""
    bit = lambda: F.pmod(F.xxhash64("key"), F.lit(KEY_BITS))
    bits = wanted.select(F.shiftright(bit(), 6).alias("word"), bit().bitwiseAND(63).cast("int").alias("at")).groupBy(
        "word").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits"))
    found = rows.join(F.broadcast(bits), F.shiftright(bit(), 6) == F.col("word"))
    return found.where(F.getbit("bits", bit().bitwiseAND(63).cast("int")) == 1).select(*rows.columns)


def _leader() -> list[Column]:
    return [F.col(f"l.{c}").alias(f"leader_{c}") for c in ("n", "place", "parity")] + [F.col("l.node").alias("leader")]


def _near_in_size(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b) of members and leaders whose numbers of shingles allow the similarity.

    ``place`` is that of the shared shingle in the order of rare ones. Where it is the first one
    shared, no more are in common than come from there on; similar pairs pass at that one. Each
    bit in which parities differ needs a shingle that only one text has; there are a ninth of
    both texts' shingles at most.
    """
    total = F.col("n") + F.col("leader_n")
    rest = F.least(F.col("n") - F.col("place"), F.col("leader_n") - F.col("leader_place"))
    differ = F.aggregate(F.zip_with("parity", "leader_parity", lambda a, b: F.bit_count(a.bitwiseXOR(b))),
                         F.lit(0), lambda a, x: a + x)
    near = pairs.where((9 * rest >= 4 * total) & (9 * differ <= total))
    return near.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()


def _verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    side = lambda n: bodies.select(F.col("node").alias(n), F.col("text").alias(f"text_{n}"))
    return _similar(pairs.join(side("b"), "b").join(side("a"), "a"))


def _merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Labels (node, label) once the found links join classes. Only links between classes are followed."""
    side = lambda n: labels.select(F.col("node").alias(n), F.col("label").alias(f"label_{n}"))
    ends = found.join(side("a"), "a", "left").join(side("b"), "b", "left").select(
        F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).where("a <> b").distinct()
    joined = components(materialize(ends, "class-links")).select(F.col("key").alias("label"), F.col("label").alias("least"))
    new = joined.select(F.col("label").alias("node"), "label").join(labels.select("node"), "node", "left_anti")
    return labels.unionByName(new).join(joined, "label", "left").select("node", F.coalesce("least", "label").alias("label"))


def _open_groups(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their labels (a text without links is its own), in groups with several; and
    each such group's largest label and members, as (bucket, main, size)."""
    labelled = materialize(members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled-members")
    sizes = labelled.groupBy("bucket", "label").agg(F.count("*").alias("size"))
    several = sizes.groupBy("bucket").agg(F.count("*").alias("n_labels"), F.max(F.struct("size", "label")).alias("l"), F.sum("size").alias("of")).where(
        "n_labels > 1").select("bucket", F.col("l.label").alias("main"), F.col("of").alias("size"))
    return labelled.join(several.select("bucket"), "bucket", "left_semi"), several


def _by_rare_shingle(members: DataFrame, bodies: DataFrame) -> DataFrame:
    """Members of open buckets, (node, n, place, parity, bucket), in groups that share a rare shingle.

    Similar texts have at least 0.8 n of each one's n shingles in common, so with all shingles in
    one order they share one among the first n - 0.8 n + 1 of both. Any order will do; one by
    frequency among these texts keeps common passages out. Frequencies are counted by hash in a
    table of fixed size, the only thing that passes the driver.
    """
    own = materialize(bodies.join(members.select("node").distinct(), "node", "left_semi"), "open-texts")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for texts in slices(batch.column("text"), SLICE):
                _, value = labelled_shingles(texts)
                total += np.bincount((value % U(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["counter", "n"])

    counts = own.select("text").mapInArrow(counted, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    frequency = np.zeros(COUNTERS, np.int64)
    found = counts.toArrow()
    frequency[found.column("counter").to_numpy()] = found.column("n").to_numpy()

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column("text"), SLICE):
                row, value = labelled_shingles(texts)
                order = np.lexsort((value, frequency[(value % U(COUNTERS)).astype(np.int64)], row))
                row, value = row[order], value[order]
                n = np.bincount(row, minlength=len(texts))
                place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                first = place < np.repeat(n - (4 * n + 4) // 5 + 1, n)
                at, bit = row[first], (mix(value) % U(PARITIES)).astype(np.int64)
                odd = np.bincount(row * PARITIES + bit, minlength=len(texts) * PARITIES).reshape(-1, PARITIES) & 1
                parity = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
                ends = pa.array(np.arange(len(at) + 1, dtype=np.int32) * parity.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(pa.array(texts.first + at)), pa.array(n[at]), pa.array(place[first]),
                     pa.ListArray.from_arrays(ends, pa.array(parity[at].reshape(-1))), pa.array(value[first].view(np.int64))],
                    names=["node", "n", "place", "parity", "bucket"])

    shingles = own.select("node", "text").mapInArrow(rarest, "node long, n long, place long, parity array<bigint>, bucket long")
    shingles = materialize(shingles, "rare-shingles")
    again = shingles.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    return shingles.join(again, "bucket", "left_semi")
