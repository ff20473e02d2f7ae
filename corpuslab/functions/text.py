"""Column expressions for cleaning text."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed value: the markup pattern (shortest span, not across newlines).
TAG_PATTERN = "<.*?>"

# Visible ASCII but "<": cleaning keeps such a character, so text that starts with one has content.
_PLAIN_START = "^[!-;=-~]"


def strip_tags(column: Column) -> Column:
    return F.regexp_replace(column, TAG_PATTERN, "")


def is_blank(column: Column) -> Column:
    """True for the empty string; null stays null, as in ``column = ''``."""
    return column == F.lit("")


def _spans(points) -> list[tuple[int, int]]:
    """Runs of neighbouring code points."""
    spans: list[list[int]] = []
    for p in points:
        if spans and p == spans[-1][1] + 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return [tuple(s) for s in spans]


def _java_class(points) -> str:
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _spans(points))


@cache
def _combining_points() -> list[int]:
    return [p for p in range(sys.maxunicode + 1) if unicodedata.combining(chr(p))]


@cache
def _vanishing_points() -> list[int]:
    """Code points of which accent removal leaves nothing: all that they decompose to combines."""
    return [p for p in range(sys.maxunicode + 1)
            if all(unicodedata.combining(c) for c in unicodedata.normalize("NFKD", chr(p)))]


@cache
def _combining_pattern() -> str:
    """Pattern of combining characters for Python's ``re``."""
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _spans(_combining_points())) + "]"


# Code points that Catalyst's translate() can handle alone: Latin letters,
# combining marks and common punctuation, as far as each maps to at most one
# character. Decomposition works per character, so a text made only of these
# needs no Python.
_LATIN_BLOCKS = (
    range(0x0080, 0x0250),  # Latin-1 Supplement to Latin Extended-B
    range(0x0300, 0x0370),  # combining marks
    range(0x1E00, 0x1F00),  # Latin Extended Additional
    range(0x2010, 0x2030),  # dashes, quotes, bullets
    range(0x20A0, 0x20C1),  # currency signs
)


@cache
def _direct_mapping() -> dict[str, str]:
    mapped = {
        chr(p): re.sub(_combining_pattern(), "", unicodedata.normalize("NFKD", chr(p)))
        for block in _LATIN_BLOCKS for p in block
    }
    return {c: m for c, m in mapped.items() if len(m) <= 1}


@cache
def _translation() -> tuple[str, str]:
    """Arguments of translate(), which deletes characters that have no counterpart."""
    mapping = _direct_mapping()
    replaced = [c for c, m in mapping.items() if len(m) == 1 and m != c]
    removed = [c for c, m in mapping.items() if not m]
    return "".join(replaced + removed), "".join(mapping[c] for c in replaced)


def _decompose():
    """The Arrow function for rare characters.

    It is defined in here so that it travels to the executors whole; they need
    not have this package installed.
    """
    combining = _combining_pattern()

    @F.pandas_udf(StringType())
    def decomposed(texts: pd.Series) -> pd.Series:
        return texts.str.normalize("NFKD").str.replace(combining, "", regex=True)

    return decomposed


_ASCII_RUN = "[\\x00-\\x7F]+"


def remove_accents(column: Column) -> Column:
    """Compatibility decomposition (NFKD) without combining characters; null stays null.

    Spark SQL has no normalisation function. ASCII text (as many bytes as
    characters) passes as it is, text of common Latin letters goes through
    ``translate``, and only rows with other characters carry their text to the
    Arrow function. The rare characters are sought among those beyond ASCII,
    because a class of many ranges is slow on long text.
    """
    is_ascii = F.length(column) == F.octet_length(column)
    not_direct = f"[^{_java_class(sorted(map(ord, _direct_mapping())))}]"
    has_rare = F.regexp_replace(column, _ASCII_RUN, "").rlike(not_direct)
    rare = _decompose()(F.when(~is_ascii & has_rare, column))
    common = F.when(is_ascii, column).otherwise(F.translate(column, *_translation()))
    return F.coalesce(rare, common)


def has_content(column: Column) -> Column:
    """Whether trimmed text still holds a character once tags and accents are gone.

    The test needs neither the cleaned text nor Python, so the optimizer can
    run it first. Most texts are settled by their first character.
    """
    trimmed = F.trim(column)
    return F.when(trimmed.rlike(_PLAIN_START), True).otherwise(
        ~strip_tags(trimmed).rlike(f"\\A[{_java_class(_vanishing_points())}]*\\z")
    )


# Fixed value: the whitespace characters of Java's \s.
_WHITESPACE = " \t\n\x0b\f\r"


def whitespace_tokens(column: Column) -> Column:
    """Lower-cased text cut at each whitespace character, as ``ml.feature.Tokenizer`` does.

    Inner empty tokens stay and trailing ones go; text of whitespace only has
    no tokens, while the empty string has one empty token.
    """
    kept = F.rtrim(F.lower(column), F.lit(_WHITESPACE))
    only_space = (kept == "") & (column != "")
    return F.when(only_space, F.array().cast("array<string>")).otherwise(F.split(kept, "\\s"))


def pattern_tokens(column: Column, pattern: str, gaps: bool = True, min_length: int = 1) -> Column:
    """Lower-cased text cut at, or into, matches of ``pattern``, as ``RegexTokenizer`` does."""
    if min_length < 0:
        raise ValueError("min_length must not be negative")
    lowered = F.lower(column)
    parts = F.split(lowered, pattern) if gaps else F.regexp_extract_all(lowered, F.lit(pattern), F.lit(0))
    return F.filter(parts, lambda t: F.length(t) >= min_length)


def without_words(tokens: Column, words: list[str]) -> Column:
    """Tokens that are not among ``words``, whatever their case; repeats stay."""
    listed = [w.lower() for w in words]
    return F.filter(tokens, lambda t: ~F.lower(t).isin(listed))


def joined_ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring tokens joined by spaces; none if there are fewer tokens."""
    starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, runs).otherwise(F.array().cast("array<string>"))


def bound(value: Column, use) -> Column:
    """``use`` applied to a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def counted_elements(array: Column) -> Column:
    """Distinct elements of an array with their number: (term, tf), ordered by term.

    Equal elements lie together once sorted; a run's length is the distance from the end of
    the run before. Null elements are not expected; a null array gives null.
    """
    def run_ends(ordered: Column) -> Column:
        pairs = F.zip_with(ordered, F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1))),
                           lambda x, after: F.struct(x.alias("term"), after.alias("after")))
        placed = F.transform(pairs, lambda p, i: F.struct(p["term"].alias("term"), p["after"].alias("after"), i.alias("at")))
        return F.filter(placed, lambda p: p["after"].isNull() | (p["after"] != p["term"]))

    def lengths(ends: Column) -> Column:
        before = F.slice(F.concat(F.array(F.lit(-1)), F.transform(ends, lambda e: e["at"])), 1, F.size(ends))
        return F.zip_with(ends, before, lambda e, b: F.struct(
            e["term"].alias("term"), (e["at"] - b).cast("bigint").alias("tf")))

    return F.when(array.isNotNull(), bound(bound(F.sort_array(array), run_ends), lengths))
