"""Conversation repair: cheapest edits that give each conversation a legal order of roles.

A legal conversation is empty, or an optional system row and then user and assistant rows in
turn. Edits are Keep, Rerole, Delete and Insert. A node is a place between rows and a state
of the role order; an arc is one edit. Two steps work on all nodes of many conversations at
once, in a number of rounds that grows with the logarithm of the longest one:

1. Costs: each row is a small matrix of the cheapest way from state to state. Products of
   1, 2, 4, ... rows give each node's cost to the end.
2. Ranks: arcs that keep to the least cost lie on cheapest paths. Nodes are ranked by the first
   1, 2, 4, ... edits of their least audit, each round from the ranks of the node and of the
   node that many edits ahead. The doubled pointers then give the nodes of each least path.

Rows are dealt by conversation and sorted, and each partition sees every conversation twice:
first its roles and faults, a few bytes a row, then its texts in order. So texts are never
gathered; a task holds the codes of one conversation (or of ``CHUNK_ROWS`` rows of several)
and the audits of its partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Edits by rank, costs, roles by initial, and what counts as text.
EDITS = "DIKR"
DELETE, INSERT, KEEP, REROLE = range(4)
COSTS = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
TRUNCATED_COST = 1
ROLE_NAMES = {"u": "user", "a": "assistant"}
BLANK_CLASS = r"[^\x20\x09-\x0D]"
ENDS = r"[.!?][\x20\x09-\x0D]*\z"
# States of the role order: begin, after system, after user, after assistant.
STATES = 4
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
DUE = "uuau"  # the role that Rerole and Insert give in each state
FINAL = (0, 3)
LEGAL_PAIRS = ("su", "ua", "au")

SOUND, BLANK, DUPLICATE, TRUNCATED, ABSENT = range(5)
CHUNK_ROWS = 1 << 16
_FAR = np.int64(1) << 40


@dataclass
class Repairs:
    """Least audits of a run of conversations, as edit codes, and their costs."""

    cost: np.ndarray
    ends: np.ndarray  # where each conversation's edits end
    edits: np.ndarray
    states: np.ndarray  # state in which each edit is made


def _arcs(roles: np.ndarray, faults: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Target state and cost of Delete, Keep and Rerole, as (edit, row, state)."""
    target = np.zeros((4, len(roles), STATES), np.int64)
    cost = np.full((4, len(roles), STATES), _FAR)
    stays = (faults == SOUND) | (faults == TRUNCATED)
    extra = TRUNCATED_COST * (faults == TRUNCATED)
    for state in range(STATES):
        target[DELETE, :, state] = state
        cost[DELETE, :, state] = COSTS[DELETE]
        target[REROLE, :, state] = NEXT[state, DUE[state]]
        cost[REROLE, stays, state] = COSTS[REROLE] + extra[stays]
        for (begin, role), end in NEXT.items():
            if begin == state:
                own = stays & (roles == ord(role))
                target[KEEP, own, state] = end
                cost[KEEP, own, state] = COSTS[KEEP] + extra[own]
    return target, cost


def _insert_target() -> np.ndarray:
    return np.array([NEXT[s, DUE[s]] for s in range(STATES)])


def _costs_to_end(target: np.ndarray, cost: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Cheapest cost from each (row, state) to its conversation's end, by doubled products.

    ``left`` counts the rows from each one to the end of its conversation.
    """
    n = len(left)
    inserted = np.full((STATES, STATES), _FAR)
    inserted[np.arange(STATES), np.arange(STATES)] = 0
    ahead = _insert_target()
    for _ in range(STATES):  # as many inserts as there are states is more than any cheapest way has
        for s in range(STATES):
            inserted[s] = np.minimum(inserted[s], COSTS[INSERT] + inserted[ahead[s]])
            inserted[s, s] = 0
    step = np.full((n, STATES, STATES), _FAR)
    for edit in (DELETE, KEEP, REROLE):
        for s in range(STATES):
            at = np.arange(n)
            np.minimum.at(step, (at, s, target[edit, :, s]), cost[edit, :, s])
    step = _product(np.broadcast_to(inserted, step.shape), step)
    span = 1
    while (left > span).any():
        more = np.flatnonzero(left > span)
        # the product over 2 * span rows, or to the end where fewer are left
        step[more] = _product(step[more], step[more + span])
        span *= 2
    final = inserted[:, FINAL].min(axis=1)
    return np.minimum((step + final).min(axis=2), _FAR)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(a.shape, _FAR)
    for k in range(STATES):
        np.minimum(out, a[:, :, k:k + 1] + b[:, k:k + 1, :], out=out)
    return out


def least_repairs(roles: np.ndarray, faults: np.ndarray, sizes: np.ndarray) -> Repairs:
    """Cheapest repairs of conversations given as runs of rows; of equal costs the least audit.

    ``roles`` holds the code of each role's first character (0 for none).
    """
    n, n_talks = len(roles), len(sizes)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    left = np.repeat(ends, sizes) - np.arange(n)
    target, cost = _arcs(roles, faults)
    to_end = _costs_to_end(target, cost, left)
    # each conversation has one more place than rows: place p of talk t is row p plus t
    talk = np.repeat(np.arange(n_talks), sizes)
    place_of_row = np.arange(n) + talk
    last = ends + np.arange(n_talks)
    n_places = n + n_talks
    value = np.full((n_places, STATES), _FAR)
    value[place_of_row] = to_end
    ahead = _insert_target()
    at_end = np.full(STATES, _FAR)
    at_end[list(FINAL)] = 0
    for _ in range(STATES):
        at_end = np.minimum(at_end, COSTS[INSERT] + at_end[ahead])
    value[last] = at_end

    # arcs that keep to the least cost, as (edit, place, state), and where they lead
    fits = np.zeros((4, n_places, STATES), bool)
    to = np.zeros((4, n_places, STATES), np.int64)
    fits[INSERT] = value == COSTS[INSERT] + value[:, ahead]
    to[INSERT] = np.arange(n_places)[:, None] * STATES + ahead
    for edit in (DELETE, KEEP, REROLE):
        reach = cost[edit] + value[place_of_row[:, None] + 1, target[edit]]
        fits[edit][place_of_row] = (reach == to_end) & (reach < _FAR)
        to[edit][place_of_row] = (place_of_row[:, None] + 1) * STATES + target[edit]
    ends_here = np.zeros((n_places, STATES), bool)
    ends_here[last[:, None], list(FINAL)] = True
    fits[:, ends_here] = False
    start = (begins + np.arange(n_talks)) * STATES
    label, doubled = _least_paths(fits.reshape(4, -1), to.reshape(4, -1), start)
    length = _path_lengths(start, doubled, ends_here.ravel())
    path = _paths(start, length, doubled)
    return Repairs(value.reshape(-1)[start], np.cumsum(length), label[path] - 1, path % STATES)


def _least_paths(fits: np.ndarray, to: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """First edit of each node's least audit, plus one (0: the path ends), and doubled pointers.

    Nodes are ranked by the first 1, 2, 4, ... edits of their least audit. The arc taken is the
    one with the least edit and, after it, the target of the lowest rank. Edits differ at a
    node, so what is ranked by its first edit stays in that order in later rounds.
    """
    nodes = np.arange(fits.shape[1])
    on = fits.any(axis=0)
    rank = np.where(on, fits.argmax(axis=0) + 1, 0)
    jump = np.where(on, to[rank - 1, nodes], nodes)
    while on[jump[start]].any():
        # the first 2^(k+1) edits, from 2^k here and those that follow 2^k edits ahead
        rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)[1].reshape(-1)
        jump = jump[jump]
    low = rank.max(initial=0) + 1
    key = np.where(fits, np.arange(1, 5)[:, None] * low + rank[to], 5 * low)
    edit = key.argmin(axis=0)
    doubled = [np.where(on, to[edit, nodes], nodes)]
    while on[doubled[-1][start]].any():
        doubled.append(doubled[-1][doubled[-1]])
    return np.where(on, edit + 1, 0), doubled


def _path_lengths(start: np.ndarray, doubled: list[np.ndarray], ends_here: np.ndarray) -> np.ndarray:
    """Edits from each start to the end of its path, by the largest jumps that stay short of it."""
    at, length = start.copy(), np.zeros(len(start), np.int64)
    for k in range(len(doubled) - 1, -1, -1):
        to = doubled[k][at]
        short = ~ends_here[to]
        at = np.where(short, to, at)
        length += short << k
    return length + ~ends_here[at]


def _paths(start: np.ndarray, length: np.ndarray, doubled: list[np.ndarray]) -> np.ndarray:
    """Nodes of all paths in order: the node after j edits, by the jumps in j's binary digits."""
    node = np.repeat(start, length)
    j = np.arange(len(node)) - np.repeat(np.cumsum(length) - length, length)
    for k, jump in enumerate(doubled):
        on = (j >> k & 1).astype(bool)
        node[on] = jump[node[on]]
    return node


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, place) of conversations damaged on purpose, to test the repair.

    By the CRC-32 of ``conv:turn`` modulo 20: 0 drops a row (it stays with place -1 and no text,
    so that its conversation is still known), 1 empties its text, 2 takes ``.!?`` from it, 3
    repeats it next to itself (place 1) and 4 makes its role user. Nulls count as one space,
    but a null turn stays one. Repeated rows are damaged alike; other columns are left out.
    """
    body = F.coalesce(F.col(text), F.lit(" "))
    name = F.coalesce(F.col(role), F.lit(" "))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)])
    harm = F.pmod(F.crc32(key), F.lit(20))
    places = F.when(harm == 0, F.array(F.lit(-1))).when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"),
        F.when(harm == 4, "user").otherwise(name).alias("role"),
        F.when(harm <= 1, "").when(harm == 2, F.translate(body, ".!?", "")).otherwise(body).alias("text"),
        F.explode(places).alias("place"))


def _streamed(rows: DataFrame) -> DataFrame:
    """Codes of all conversations of a partition, then their texts, in the same order."""
    body = F.col("text")
    sound = F.when(F.col("place") < 0, ABSENT).when(~body.rlike(BLANK_CLASS), BLANK).when(
        ~body.rlike(ENDS), TRUNCATED).otherwise(SOUND)
    own = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), body))
    coded = rows.select(
        "conv", "turn", F.col("role"), "place", sound.cast("byte").alias("fault"), F.unhex(own).alias("own"), "text")
    phases = coded.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("phase")).where("phase = 0 or place >= 0")
    phases = phases.withColumn("text", F.when(F.col("phase") == 1, F.col("text")))
    # rows of one turn have no order of their own; role and text give them one
    return phases.repartition("conv").sortWithinPartitions(
        "phase", "conv", F.col("turn").asc_nulls_first(), "role", "own", "place").select(
        "conv", "turn", "role", "fault", "own", "phase", "text")


def _begins(column: pa.Array, before) -> np.ndarray:
    """Whether each row begins another conversation; null is one."""
    begins = np.ones(len(column), bool)
    if len(column) > 1:
        same = pc.fill_null(pc.equal(column[1:], column[:-1]), False)
        both = pc.and_(pc.is_null(column[1:]), pc.is_null(column[:-1]))
        begins[1:] = ~pc.or_(same, both).to_numpy(zero_copy_only=False)
    if before is not None:
        begins[0] = before != (column[0].as_py(),)
    return begins


@dataclass
class _Found:
    """What a partition's codes say of one conversation."""

    conv: object
    counts: tuple[int, ...]  # gaps, blank, duplicate, truncated, illegal, cost
    edits: bytes
    states: bytes


class _Codes:
    """Code rows of conversations until they are solved together."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.convs: list = []
        self.rows = 0

    def add(self, batch: pa.RecordBatch, begins: np.ndarray) -> None:
        conv = batch.column("conv")
        self.convs += [c.as_py() for c in conv.filter(pa.array(begins))]
        turns = batch.column("turn").cast(pa.int64())
        initial = pc.fill_null(pc.utf8_slice_codeunits(batch.column("role"), 0, 1), "").to_pylist()
        own = batch.column("own")
        self.parts.append((
            begins, pc.fill_null(turns, 0).to_numpy(zero_copy_only=False), pc.is_valid(turns).to_numpy(zero_copy_only=False),
            np.array([ord(c) if c else 0 for c in initial], np.int64), batch.column("fault").to_numpy(zero_copy_only=False),
            np.frombuffer(b"".join(own.to_pylist()), np.uint64).reshape(-1, 2)))
        self.rows += len(begins)

    def solve(self) -> Iterator[_Found]:
        begins, turn, has_turn, role, fault, own = (np.concatenate(x) for x in zip(*self.parts))
        talk = np.cumsum(begins) - 1
        n_talks = len(self.convs)
        there = fault != ABSENT
        talk, turn, has_turn, role, fault, own = (x[there] for x in (talk, turn, has_turn, role, fault.astype(np.int64), own))
        fault[_repeated(talk, own) & (fault != BLANK)] = DUPLICATE
        sizes = np.bincount(talk, minlength=n_talks)
        found = least_repairs(role, fault, sizes)
        per_talk = lambda x: np.bincount(talk[x], minlength=n_talks)
        pairs = np.zeros(len(talk), bool)
        pairs[1:] = talk[1:] == talk[:-1]
        legal = np.zeros(len(talk), bool)
        for a, b in LEGAL_PAIRS:
            legal[1:] |= (role[:-1] == ord(a)) & (role[1:] == ord(b))
        counts = np.stack([_gaps(talk, turn, has_turn, n_talks), per_talk(fault == BLANK), per_talk(fault == DUPLICATE),
                           per_talk(fault == TRUNCATED), per_talk(pairs & ~legal), found.cost], axis=1)
        first = 0
        edits, states = found.edits.astype(np.uint8), found.states.astype(np.uint8)
        for k, end in enumerate(found.ends.tolist()):
            yield _Found(self.convs[k], tuple(counts[k].tolist()), edits[first:end].tobytes(), states[first:end].tobytes())
            first = end


def _repeated(talk: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether an earlier row of the conversation has the same role and text."""
    order = np.lexsort((np.arange(len(talk)), own[:, 1], own[:, 0], talk))
    same = np.zeros(len(talk), bool)
    a, b = order[1:], order[:-1]
    same[a] = (talk[a] == talk[b]) & (own[a] == own[b]).all(axis=1)
    return same


def _gaps(talk: np.ndarray, turn: np.ndarray, has_turn: np.ndarray, n_talks: int) -> np.ndarray:
    """Turn numbers missing between the first and the last, per conversation; rows come by turn."""
    talk, turn = talk[has_turn], turn[has_turn]
    gaps = np.zeros(n_talks, np.int64)
    if len(talk):
        another = np.ones(len(talk), bool)
        another[1:] = (talk[1:] != talk[:-1]) | (turn[1:] != turn[:-1])
        begin = np.flatnonzero(np.concatenate([[True], talk[1:] != talk[:-1]]))
        end = np.concatenate([begin[1:], [len(talk)]]) - 1
        distinct = np.add.reduceat(another.astype(np.int64), begin)
        gaps[talk[begin]] = turn[end] - turn[begin] + 1 - distinct
    return gaps


def _partition(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Found, Iterator[tuple[str, str, str]]]]:
    """Each conversation with its repaired rows (edit, role, text); take these before the next one."""
    solved: list[_Found] = []
    codes, before = _Codes(), None
    texts = None
    for batch in batches:
        n_codes = int(np.searchsorted(batch.column("phase").to_numpy(), 1))
        if n_codes:
            part = batch.slice(0, n_codes)
            begins = _begins(part.column("conv"), before)
            before = (part.column("conv")[n_codes - 1].as_py(),)
            # whole conversations only: what is held ends where another one begins
            first = int(np.argmax(begins)) if begins.any() else n_codes
            if codes.rows >= CHUNK_ROWS and first < n_codes:
                if first:
                    codes.add(part.slice(0, first), begins[:first])
                solved += codes.solve()
                codes, part, begins = _Codes(), part.slice(first), begins[first:]
            codes.add(part, begins)
        if n_codes < batch.num_rows:
            texts = _chained(batch.slice(n_codes), batches)
            break
    if codes.rows:
        solved += codes.solve()
    texts = texts if texts is not None else iter(())
    for found in solved:
        rows = _repaired(found, texts)
        yield found, rows
        for _ in rows:  # what the caller did not take
            pass


def _chained(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    yield from zip(first.column("role").to_pylist(), first.column("text").to_pylist())
    for batch in rest:
        yield from zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())


def _repaired(found: _Found, texts: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    for edit, state in zip(found.edits, found.states):
        role, text = (ROLE_NAMES[DUE[state]], "") if edit == INSERT else next(texts)
        if edit == REROLE:
            role = ROLE_NAMES[DUE[state]]
        if edit != DELETE:
            yield EDITS[edit], role, text


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def report(rows: DataFrame) -> DataFrame:
    """One row per conversation of (conv, turn, role, text, place): faults, cost, audit, digest.

    Gives conv, gaps, blank, duplicate, truncated, illegal, cost (long), audit (initials of the
    edits, Inserts included) and the SHA-256 of the repaired ``role:text`` lines. A row's first
    fault counts: blank, duplicate of an earlier role and text, truncated. Rows are taken by
    turn, null turns first, rows of one turn by role and text. A null conversation is one; a null
    role or text counts as empty; rows with place -1 only make their conversation known, and a
    conversation without others has zeros, an empty audit and the empty digest. An empty table
    gives no rows. A conversation is edited in one task, since its digest runs over all its
    texts in order, but its texts are never held together, however long.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, out = None, []

        def batch_of(out):
            columns = [pa.array([r[0] for r in out], kind)]
            columns += [pa.array([r[1][k] for r in out], pa.int64()) for k in range(len(REPORT))]
            columns += [pa.array([r[k] for r in out], pa.string()) for k in (2, 3)]
            return pa.RecordBatch.from_arrays(columns, names=["conv", *REPORT, "audit", "repaired_sha256"])

        def watched():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv").type
                yield batch

        for found, lines in _partition(watched()):
            digest, first = hashlib.sha256(), True
            for _, role, text in lines:
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
            out.append((found.conv, found.counts, "".join(EDITS[e] for e in found.edits), digest.hexdigest()))
            if len(out) >= 1024:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    streamed = _streamed(_filled(rows))
    id_type = streamed.schema["conv"].dataType.simpleString()
    return streamed.mapInArrow(run, f"conv {id_type}, " + ", ".join(f"{c} long" for c in REPORT)
                               + ", audit string, repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """Repaired rows (conv, place, edit, role, text), places from 0, for rows as in :func:`report`.

    Deleted rows are left out; inserted ones have an empty text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, out, size = None, [], 0

        def batch_of(out):
            types = (kind, pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                              names=["conv", "place", "edit", "role", "text"])

        def watched():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv").type
                yield batch

        for found, lines in _partition(watched()):
            for place, (edit, role, text) in enumerate(lines):
                out.append((found.conv, place, edit, role, text))
                size += len(text)
                if len(out) >= 4096 or size > 1 << 22:
                    yield batch_of(out)
                    out, size = [], 0
        if out:
            yield batch_of(out)

    streamed = _streamed(_filled(rows))
    id_type = streamed.schema["conv"].dataType.simpleString()
    return streamed.mapInArrow(run, f"conv {id_type}, place long, edit string, role string, text string")


def _filled(rows: DataFrame) -> DataFrame:
    """Rows as the repair takes them; a table without a column ``place`` has whole rows."""
    place: Column = F.col("place") if "place" in rows.columns else F.lit(0)
    return rows.select("conv", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
                       F.coalesce("text", F.lit("")).alias("text"), place.alias("place"))
