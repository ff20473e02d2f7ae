import hashlib
import re
import zlib
from functools import cache

import numpy as np
import pytest

from corpuslab.llm import conversations
from corpuslab.llm.queries import QUERIES

BLANK = re.compile(r"[^\x20\x09-\x0D]")
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def damage(rows):
    """(turn, role, text) after damage of one conversation's (conv_id, turn, role, text)."""
    out = []
    blank = lambda x: " " if x is None else x
    for conv, turn, role, text in rows:
        role, text = blank(role), blank(text)
        harm = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        if harm == 1:
            text = ""
        if harm == 2:
            text = re.sub("[.!?]", "", text)
        if harm == 4:
            role = "user"
        out += [(turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    own = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], own(r)))


def repair(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, digest by trying every edit."""
    faults, seen = [], set()
    for _, role, text in rows:
        last = BLANK.findall(text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen
                      else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def best(i, state, inserts):
        """(cost, audit, repaired) of the rest; up to four inserts in a row."""
        ways = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        due = "a" if state == 2 else "u"
        name = {"a": "assistant", "u": "user"}[due]
        if inserts < 4:
            cost, audit, lines = best(i, STEPS[state, due], inserts + 1)
            ways.append((cost + 2, "I" + audit, (f"{name}:",) + lines))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, lines = best(i + 1, state, 0)
            ways.append((cost + 3, "D" + audit, lines))
            if faults[i] in ("", "truncated"):
                more = faults[i] == "truncated"
                cost, audit, lines = best(i + 1, STEPS[state, due], 0)
                ways.append((cost + 2 + more, "R" + audit, (f"{name}:{text}",) + lines))
                if (state, role[:1]) in STEPS:
                    cost, audit, lines = best(i + 1, STEPS[state, role[:1]], 0)
                    ways.append((cost + more, "K" + audit, (f"{role}:{text}",) + lines))
        return min(ways, default=(10 ** 9, "", ()))

    cost, audit, lines = best(0, 0, 0)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows):
    talks = {}
    for r in rows:
        talks.setdefault(r[0], []).append(r)
    return {conv: repair(damage(own)) for conv, own in talks.items()}


def reported(df):
    found = [tuple(r) for r in df.select(
        "conv_id", *conversations.REPORT, "audit", "repaired_sha256").collect()]
    assert len({f[0] for f in found}) == len(found)
    return {f[0]: f[1:] for f in found}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_trying_every_edit(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    assert reported(QUERIES["op13_conversation_repair"][0](spark, folder)) == expected(rows)


ODD = (
    [(1, t, r, x) for t, (r, x) in enumerate([
        ("assistant", "Late."), ("system", "Rules."), ("user", "Hello?"), ("user", "Hello?"), ("assistant", "cut"), ("user", "  ")])]
    + [(2, None, None, None), (2, None, "user", "A."), (2, 3, "", "B."), (2, 9, "bot", "C"), (2, 9, "assistant", "é!")]
    + [(None, 1, "user", "x."), (None, 1, "user", "x."), (None, 2, "assistant", "y. \n\t")]
    + [(3, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(90)]
    + [(4, t, "system", "same.") for t in range(7)] + [(5, None, "user", "only."), (5, None, "assistant", "word" * 20000 + ".")]
    + [(100 + k, 0, "user", "Q?") for k in range(60)]
)


def test_odd_conversations(spark):
    df = spark.createDataFrame([(*r, "own") for r in ODD], SCHEMA + ", place string")
    got = reported(conversations.report(conversations.damaged(df)).withColumnRenamed("conv", "conv_id"))
    assert got == expected(ODD)
    # conversations that lost all rows stay, with zeros
    assert any(v[:6] == (0,) * 6 and v[6] == "" and v[7] == hashlib.sha256(b"").hexdigest() for v in got.values())
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.report(conversations.damaged(empty)).count() == 0


def test_rows_of_the_repair_make_its_digest(spark):
    df = conversations.damaged(spark.createDataFrame(ODD, SCHEMA))
    digests = {r.conv: r.repaired_sha256 for r in conversations.report(df).collect()}
    lines = {}
    for r in sorted(conversations.repaired(df).collect(), key=lambda r: r.place):
        assert len(lines.setdefault(r.conv, [])) == r.place and r.edit in "IKR"
        lines[r.conv].append(f"{r.role}:{r.text}")
    for conv, digest in digests.items():
        assert digest == hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest()


def test_least_repairs_of_many_random_talks():
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 9, 400)
    roles = rng.choice([ord(c) for c in "suax"], sizes.sum())
    faults = rng.choice([conversations.SOUND, conversations.BLANK, conversations.TRUNCATED], sizes.sum(), p=[.7, .1, .2])
    found = conversations.least_repairs(roles, faults, sizes)
    texts = {conversations.SOUND: "t.", conversations.BLANK: "", conversations.TRUNCATED: "t"}
    at = first = 0
    for talk, size in enumerate(sizes):
        rows = [(k, chr(r), f"{k}" + texts[f] if texts[f] else "") for k, (r, f) in enumerate(zip(
            roles[at:at + size], faults[at:at + size]))]
        want = repair(rows)
        got = "".join(conversations.EDITS[e] for e in found.edits[first:found.ends[talk]])
        assert (found.cost[talk], got) == (want[5], want[6])
        at, first = at + size, found.ends[talk]


def test_chunks_split_between_conversations(spark, monkeypatch):
    df = spark.createDataFrame(ODD, SCHEMA)
    monkeypatch.setattr(conversations, "CHUNK_ROWS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = reported(conversations.report(conversations.damaged(df)).withColumnRenamed("conv", "conv_id"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == expected(ODD)


def test_one_long_conversation_takes_few_rounds():
    n = 200_000
    roles = np.array([ord("ua"[k % 2]) for k in range(n)])
    faults = np.full(n, conversations.SOUND)
    faults[7] = conversations.BLANK
    found = conversations.least_repairs(roles, faults, np.array([n]))
    assert found.cost.tolist() == [5] and found.ends.tolist() == [n + 1]
