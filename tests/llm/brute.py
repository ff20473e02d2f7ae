"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def quality_counts(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = SPACE_WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i:i + 8])].append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def base_failed(text: str | None) -> bool:
    n, _, _, _, repeated = quality_counts(text)
    return n < 20 or 100 * repeated > 30 * n


def shingles(text: str | None) -> set:
    words = SPACE_WORD.findall(lower(text))
    found = [tuple(words[i:i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])
    seen = Counter()
    labelled = set()
    for s in found:
        labelled.add((s, seen[s]))
        seen[s] += 1
    return labelled


def near_classes(texts: dict[int, str | None], similarity: float = 0.8) -> dict[int, int]:
    """Smallest id of each id's class of equal or similar texts."""
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            common = len(own[a] & own[b])
            near = common and common >= similarity * (len(own[a]) + len(own[b]) - common)
            if near or (texts[a] or "") == (texts[b] or ""):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in texts}


def shared_passage(doc: str | None, item: str | None, least: int = 13) -> bool:
    """Whether some alignment has a stretch of that many words (or the item) four fifths equal."""
    a, b = ALNUM_WORD.findall(lower(doc)), ALNUM_WORD.findall(lower(item))
    need = min(least, len(b))
    for shift in range(-len(b), len(a)):
        same = [0 <= i + shift < len(a) and a[i + shift] == b[i] for i in range(len(b))]
        for i in range(len(b)):
            for j in range(i + need, len(b) + 1):
                if need and sum(same[i:j]) > 0.8 * (j - i):
                    return True
    return False


def ppm_scores(texts: dict[int, str | None], order: int = 4) -> dict[int, tuple]:
    """(held_out, n_tokens, n_known, train_tokens, base_score, score) by definition."""
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    tokens = {i: [*SPACE_WORD.findall(lower(t)), None] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    follow = defaultdict(Counter)

    def symbols(t):
        return b"\xfe" * order + lower(t).encode() + b"\xff"

    for i, t in texts.items():
        if not held[i]:
            b = symbols(t)
            for p in range(order, len(b)):
                for k in range(order + 1):
                    follow[b[p - k:p]][b[p]] += 1

    def code(context, x):
        left_out, value = set(), 0.0
        for k in range(order, -1, -1):
            seen = {s: n for s, n in follow.get(context[order - k:], {}).items() if s not in left_out}
            if seen:
                room = sum(seen.values()) + len(seen)
                if x in seen:
                    return value + math.log10(seen[x] / room)
                value += math.log10(len(seen) / room)
                left_out |= set(seen)
        return value - math.log10(257 - len(left_out))

    result = {}
    for i, t in texts.items():
        b = symbols(t)
        result[i] = (
            held[i], len(tokens[i]), sum(w in counts for w in tokens[i]), total,
            sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens[i]),
            sum(code(b[p - order:p], b[p]) for p in range(order, len(b))))
    return result


def phrase_places(text: str | None, phrases: dict[str, str]) -> tuple[int, list[int], set[str]]:
    words = ALNUM_WORD.findall(lower(text))
    places, labels = [], set()
    for phrase, label in phrases.items():
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i:i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return len(words), sorted(places), labels


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal_spans(text: str | None) -> list[tuple[str, int, int]]:
    text, found = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    rank = ["email", "ip", "card", "phone"]
    return sorted(found, key=lambda s: (s[1], rank.index(s[0])))


def matches(text: str | None, rules) -> list[tuple[str, int, int]]:
    """Spans of (kind, pattern, any case, least length) rules, each by itself, by start and then rule."""
    found = []
    for rank, (kind, pattern, any_case, least) in enumerate(rules):
        for m in re.finditer(pattern, text or "", (re.IGNORECASE if any_case else 0) | re.ASCII):
            if m.end() - m.start() >= least:
                found.append((m.start(), rank, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def secret_spans(text: str | None) -> list[tuple[str, int, int]]:
    text, found = text or "", []
    assign = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
    for m in re.finditer(assign, text, re.ASCII):
        if len(m[2]) >= 6:
            found.append(("assign", *m.span()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            found.append(("access", *m.span()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            found.append(("hex", *m.span()))
    rank = ["assign", "access", "hex"]
    return sorted(found, key=lambda s: (s[1], rank.index(s[0])))


def cotrained(rows: list[tuple], labels: dict[int, dict[str, int]]) -> dict[str, list]:
    """Weights of both views of each head, by dense matrices and sorted log odds, one row at a time."""
    import pyarrow as pa

    from corpuslab.llm import cotraining as c
    from corpuslab.llm.batches import slices

    def matrix(n, triples, width):
        dense = np.zeros((n, width + 1))
        dense[:, -1] = 1
        for r, s, x in triples:
            dense[r, s] = x
        return dense

    texts = next(slices(pa.array([r[1] for r in rows]), 1 << 30))
    words = [(r, s, float(np.float16(x))) for r, s, x in zip(*c._text_view(texts))]
    on = c._meta_view(texts, *([None if r[k] is None else str(r[k]) for r in rows] for k in (2, 3, 4)))
    views = [matrix(len(rows), words, c.WORD_SLOTS + c.SHAPE_SLOTS),
             matrix(len(rows), [(r, s, 1.0) for r in range(len(rows)) for s in on[r]], c.META_SLOTS)]
    known = sorted((i for i, r in enumerate(rows) if r[0] in labels), key=lambda i: rows[i][0])
    pool = [i for i, r in enumerate(rows) if r[0] not in labels]
    known = [i for k, i in enumerate(known) if k % 4]

    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    def downhill(weights, slope, steps, rate):
        m, q = np.zeros_like(weights), np.zeros_like(weights)
        for t in range(1, steps + 1):
            g = slope(weights) + 1e-5 * np.append(weights[:-1], 0)
            m, q = 0.9 * m + 0.1 * g, 0.99 * q + 0.01 * g * g
            weights = weights - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(q / (1 - 0.99 ** t)) + 1e-9)
        return weights

    def surest(odds, wanted):
        """Weight of each row: the largest bins first, the last one in equal parts."""
        bins = np.floor((odds + c.REACH) * c.BINS / (2 * c.REACH))
        weight, left = np.zeros(len(odds)), wanted
        for b in sorted(set(bins), reverse=True):
            inside = bins == b
            weight[inside] = min(left / inside.sum(), 1)
            left -= weight[inside].sum()
        return weight

    result = {}
    for head in c.HEADS:
        y = np.array([labels[rows[i][0]][head] for i in known], float)
        share = y.mean()
        prior = np.log((share * len(y) + 1) / ((1 - share) * len(y) + 1))
        own = lambda v, w: views[v][known].T @ (sigmoid(views[v][known] @ w) - y) / len(y)
        weights = [downhill(np.append(np.zeros(views[v].shape[1] - 1), prior), lambda w, v=v: own(v, w), 80, 0.3) for v in (0, 1)]
        for turn in range(c.ROUNDS):
            wanted = max(c.PER_ROUND * len(pool) * (turn + 1), 1)
            odds = [views[v][pool] @ weights[v] for v in (0, 1)]
            good = [surest(o, wanted * share) for o in odds]
            # bins of the negated odds would have their edges elsewhere
            flipped = [2 * np.floor((o + c.REACH) * c.BINS / (2 * c.REACH)) + 1 - c.BINS for o in odds]
            bad = [surest(-f * c.REACH / c.BINS, wanted * (1 - share)) for f in flipped]

            def slope(w, v):
                chance = sigmoid(views[v][pool] @ w)
                taught = views[v][pool].T @ (good[1 - v] * (chance - 1) + bad[1 - v] * chance)
                return (own(v, w) + c.TRUST * taught / wanted) / (1 + c.TRUST)

            for v in (0, 1):
                ahead = weights[v]
                for t in range(1, c.STEPS + 1):
                    new = ahead - (2.0, 4 / 11)[v] * slope(ahead, v)
                    ahead, weights[v] = new + (t - 1) / (t + 2) * (new - weights[v]), new
        result[head] = weights
    return result
