"""Secret scan: all rules in one deterministic automaton, one pass over the bytes of each line.

The pass goes from the end of a line to its begin, so the automaton tells at which bytes a match
of which rules begins; the same rules compiled forward give the ends, from those bytes only. No
rule matches across a line break, so lines are scanned side by side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.automaton import compile_rules, leftmost_longest
from corpuslab.llm.batches import slices

# Kind, pattern, any case, least length. Order is rank within equal starts.
BASE_RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 0),
    ("access", r"AKIA[A-Z0-9]+", False, 20),
    ("hex", r"[0-9a-f]{24,}", False, 24),
)
MORE_RULES = (
    ("github", r"gh[pousr]_[A-Za-z0-9]+", False, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", False, 15),
    ("google", r"AIza[A-Za-z0-9_-]+", False, 39),
    ("stripe", r"[sr]k_live_[A-Za-z0-9]+", False, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 40),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False, 0),
    ("login", r"(https?|ftp|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._-]+:[A-Za-z0-9._%+-]+@", False, 0),
)
RULES = BASE_RULES + MORE_RULES
LEAST_VALUE = 6
_ASSIGN = re.compile(BASE_RULES[0][1].encode(), re.IGNORECASE | re.ASCII)
SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _accepts(rule: int, found: bytes) -> bool:
    kind, _, _, least = RULES[rule]
    if kind == "assign":
        return len(_ASSIGN.match(found)[2]) >= LEAST_VALUE
    return len(found) >= least


class _Scanner:
    def __init__(self):
        rules = [(pattern, any_case) for _, pattern, any_case, _ in RULES]
        self.forward, self.backward = compile_rules(rules), compile_rules(rules, backward=True)

    def spans(self, column: pa.Array) -> Iterator[list[dict]]:
        """Spans of each text, by start and then rule."""
        for texts in slices(column):
            rows: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
            breaks = np.flatnonzero(texts.data == 10)
            edges = np.unique(np.concatenate([texts.offsets, breaks, breaks + 1]))
            for a, rule, b in leftmost_longest(self.forward, self.backward, texts.data, edges[:-1], edges[1:]):
                if _accepts(rule, texts.data[a:b].tobytes()):
                    rows[int(np.searchsorted(texts.offsets, a, side="right")) - 1].append((a, rule, b))
            for row, found in enumerate(rows):
                yield self._in_code_points(texts, row, found) if found else []

    @staticmethod
    def _in_code_points(texts, row: int, found: list[tuple[int, int, int]]) -> list[dict]:
        first = texts.offsets[row]
        own = texts.data[first:texts.offsets[row + 1]]
        before = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
        return [{"kind": RULES[rule][0], "start": int(before[a - first]), "end": int(before[b - first])}
                for a, rule, b in sorted(found)]


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: every secret as (kind, start, end), in code points, end exclusive.

    Within a kind, matches are leftmost and do not overlap; too short ones are dropped. Null
    and empty texts have no spans; other columns and repeated rows stay, an empty table gives an
    empty one. A column named ``spans`` is replaced. Time grows with the bytes of a text, however
    long, and with its matches.
    """
    kept = [c for c in docs.columns if c != "spans"]
    inner = docs.select([F.col(f"`{c}`") for c in kept])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema] + [f"spans {SPAN}"])
    position = kept.index(text)
    scanner = _Scanner()  # compiled once; tasks get the arrays

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = pa.array(scanner.spans(batch.column(position)), _SPAN_ARROW)
            yield pa.RecordBatch.from_arrays([*batch.columns, spans], names=[*kept, "spans"])

    return inner.mapInArrow(run, schema)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_digest(spans: Column, kinds: list[str]) -> Column:
    return F.sha2(listed(F.filter(spans, lambda s: s["kind"].isin(kinds))), 256)


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
