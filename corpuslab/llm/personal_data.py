"""Personal data by weak supervision: labelers vote on candidate spans, a classifier decides.

Patterns propose spans; pattern validity, gazetteers, context words and span borders vote.
Expectation-maximisation weighs the labelers from their agreement, and its posteriors train
a naive Bayes span classifier. Valid base patterns are always kept.

Everything is DataFrame functions and happens inside each row; only vote patterns and
feature counts (a fixed number of combinations) are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import bound
from corpuslab.llm.voting import Reliability, fit_reliability
from corpuslab.session import materialize

# Base patterns. Possessive repeats and the look-behinds change no match; they
# keep long runs from being searched again from each of their characters.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # further kinds, decided by the classifier alone
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?",
}
NEEDS = {"email": "@", "phone": "+", "ip": ".", "name": ". "}
BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = list(PATTERNS)
_DIGIT_KINDS = ("ip", "card", "ssn", "iban")

# Gazetteers and context words; votes only.
DOMAINS = "com org net edu gov info io de fr es uk eu ch at it nl".split()
DIALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 61 81 82 86 90 91".split()
COUNTRIES = "AT BE CH DE DK ES FR GB IE IT LU NL NO PL PT SE".split()
GIVEN = "John Mary James Anna Peter Maria Paul Laura David Sofia Hans Marie Juan Pierre Carlos Emma".split()
FOR_WORDS = r"(e-?mail|mail|contact|write|call|tel|phone|fax|mobile|card|visa|account|ip|host|address|ssn|iban|dear|from)"
AGAINST_WORDS = r"(version|release|section|figure|chapter|isbn|issn|page|build|rev)"
CONTEXT = 40

SPAN_TYPE = ("struct<kind:string,start:bigint,end:bigint,valid:boolean,"
             "v_pattern:int,v_gazetteer:int,v_context:int,v_border:int,size:int>")
VOTES = ["v_pattern", "v_gazetteer", "v_context", "v_border"]
FEATURES = ["kind", *VOTES, "size"]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit fits."""
    turned = F.reverse(digits)
    double = F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), lambda i: (
        F.substring(turned, i, F.lit(1)).cast("int") * (1 + (i - 1) % 2)))
    total = F.aggregate(double, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d))
    return total % 10 == 0


RUN = 128  # matches that are placed together


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.coalesce(
            F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^[0-9]{1,3}$")
            & (F.regexp_replace(p, "^0+(?=[0-9])", "").substr(1, 3).cast("int") <= 255), F.lit(False)))
    if kind == "card":
        n = F.length(_digits(x))
        return F.when((n >= 12) & (n <= 19), _luhn(_digits(x))).otherwise(False)
    if kind == "phone":
        n = F.length(_digits(x))
        return (n >= 9) & (n <= 15)
    return F.lit(kind == "email")


def _gazetteer(kind: str, x: Column) -> Column:
    if kind == "email":
        return F.when(F.lower(F.substring_index(x, ".", -1)).isin(DOMAINS), 1).otherwise(-1)
    if kind == "ip":
        return F.when(x.rlike(r"^(0|10|127|192\.168|172\.(1[6-9]|2[0-9]|3[01])|22[4-9]|2[3-5][0-9])\."), -1).otherwise(1)
    if kind == "card":
        return F.when(x.rlike("^[3-6]"), 1).otherwise(-1)
    if kind == "phone":
        return F.when(F.regexp_extract(x, r"^\+([0-9]+)", 1).isin(DIALLING), 1).otherwise(0)
    if kind == "ssn":
        return F.when(x.rlike("^(000|666|9)"), -1).otherwise(1)
    if kind == "iban":
        return F.when(F.substring(x, 1, 2).isin(COUNTRIES), 1).otherwise(-1)
    return F.when(F.regexp_extract(x, r" ([A-Z][a-z]+)", 1).isin(GIVEN), 1).otherwise(0)


def _pattern_vote(kind: str, valid: Column) -> Column:
    if kind in BASE_KINDS:
        return F.when(valid, 1).otherwise(-1)
    return F.lit(0 if kind == "name" else 1)


def _candidates(kind: str, body: Column) -> Column:
    """All matches of a pattern as spans with votes; offsets follow from the pieces between them.

    Matches are taken in runs of ``RUN``: places inside a run, then the runs' own places. Growing
    arrays thus stay short and the time is about linear in the matches of a text.
    """
    pattern = PATTERNS[kind]
    found, pieces = F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), F.split(body, pattern, -1)
    n = F.size(found)
    rows = F.arrays_zip(found.alias("m"), F.slice(pieces, 1, n).alias("g"), F.slice(pieces, 2, n).alias("h"))

    def add(a: Column, x: Column) -> Column:
        begin = a["pos"] + F.length(x["g"])
        end = begin + F.length(x["m"])
        valid = _valid(kind, x["m"])
        before = F.lower(F.right(x["g"], F.lit(CONTEXT)))
        context = F.when(before.rlike(r"\b" + AGAINST_WORDS + r"\b"), -1).when(
            before.rlike(r"\b" + FOR_WORDS + r"\b"), 1).otherwise(0)
        border = F.when(F.right(x["g"], F.lit(1)).rlike("[A-Za-z0-9]") | F.left(x["h"], F.lit(1)).rlike("[A-Za-z0-9]"),
                        -1).otherwise(1)
        span = F.struct(
            F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), valid.alias("valid"),
            _pattern_vote(kind, valid).alias("v_pattern"), _gazetteer(kind, x["m"]).alias("v_gazetteer"),
            context.alias("v_context"), border.alias("v_border"),
            F.least(F.floor(F.length(x["m"]) / 4), F.lit(10)).cast("int").alias("size"))
        return F.struct(end.alias("pos"), F.array_append(a["spans"], span.cast(SPAN_TYPE)).alias("spans"))

    none = F.array().cast(f"array<{SPAN_TYPE}>")
    nothing = F.struct(F.lit(0).cast("bigint").alias("pos"), none.alias("spans"))

    def run(matches: Column) -> Column:
        return F.aggregate(matches, nothing, add)

    def placed(runs: Column) -> Column:
        begins = F.aggregate(
            runs, F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast("array<bigint>").alias("begins")),
            lambda a, r: F.struct((a["pos"] + r["pos"]).alias("pos"), F.array_append(a["begins"], a["pos"]).alias("begins")),
            lambda a: a["begins"])
        return F.flatten(F.zip_with(runs, begins, lambda r, at: F.transform(
            r["spans"], lambda s: s.withField("start", s["start"] + at).withField("end", s["end"] + at))))

    return bound(rows, lambda all_: bound(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1)), F.lit(RUN)), lambda k: run(F.slice(all_, k, RUN))), placed))


def proposals(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with all candidate spans and their votes in ``_spans``."""
    kept = [c for c in docs.columns if c not in {text, "_spans"}]
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(f"array<{SPAN_TYPE}>")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], body.alias("_body"), body.rlike("[0-9]").alias("_digit"))
    arrays = []
    for kind in KINDS:
        able = F.col("_digit") if kind in _DIGIT_KINDS or kind == "phone" else F.lit(True)
        if kind in NEEDS:
            able = able & F.contains(F.col("_body"), F.lit(NEEDS[kind]))
        if kind == "name":
            able = F.col("_body").rlike(r"(Mr|Mrs|Ms|Dr)\.? [A-Z]")
        arrays.append(F.when(able, _candidates(kind, F.col("_body"))).otherwise(none))
    return rows.select(*[F.col(f"`{c}`") for c in kept], F.concat(*arrays).alias("_spans"))


def fit(proposed: DataFrame) -> tuple[Reliability, dict[str, float]]:
    """Labeler reliabilities, and the span classifier's log odds per feature value."""
    spans = proposed.select(F.explode("_spans").alias("s")).select("s.*")
    patterns = materialize(spans.groupBy(*FEATURES).agg(F.count("*").alias("_n")), "span-patterns")
    model = fit_reliability(patterns, VOTES, weight="_n")
    good = model.posterior([F.col(v) for v in VOTES])
    values = patterns.withColumn("_good", good).select("_n", "_good", F.explode(F.array(*[
        F.concat(F.lit(f"{f}="), F.col(f).cast("string")) for f in FEATURES])).alias("value"))
    sums = values.groupBy("value").agg(
        F.sum(F.col("_n") * F.col("_good")).alias("g"), F.sum(F.col("_n") * (1 - F.col("_good"))).alias("b")).collect()
    total_g = sum(r.g for r in sums if r.value.startswith("kind="))
    total_b = sum(r.b for r in sums if r.value.startswith("kind="))
    odds = {r.value: math.log((r.g + 1) / (total_g + 2)) - math.log((r.b + 1) / (total_b + 2)) for r in sums}
    odds["prior"] = math.log((total_g + 1) / (total_b + 1))
    return model, odds


def decide(proposed: DataFrame, odds: dict[str, float]) -> DataFrame:
    """Add ``spans``: base spans and the candidates that the classifier accepts, by start and kind."""
    table = F.create_map(*[F.lit(x) for pair in odds.items() for x in pair])

    def score(s: Column) -> Column:
        total = F.lit(odds["prior"])
        for f in FEATURES:
            total = total + F.coalesce(F.try_element_at(table, F.concat(F.lit(f"{f}="), s[f].cast("string"))), F.lit(0.0))
        return total

    rank = F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)])
    base = lambda s: s["valid"] & s["kind"].isin(BASE_KINDS)
    chosen = F.filter("_spans", lambda s: base(s) | (score(s) > 0))
    ordered = F.array_sort(F.transform(chosen, lambda s: F.struct(
        s["start"].alias("start"), F.try_element_at(rank, s["kind"]).alias("rank"), s["end"].alias("end"),
        s["kind"].alias("kind"), base(s).alias("is_base"))))
    return proposed.withColumn("spans", ordered).drop("_spans")


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``spans`` (start, rank, end, kind, is_base) of personal data.

    Offsets are code points, end exclusive. Null and empty texts have no spans; an empty
    table gives no rows; repeated rows and other columns stay, a column ``spans`` is replaced.
    """
    inner = docs.drop("spans") if text != "spans" else docs
    proposed = materialize(proposals(inner, text), "span-proposals")
    _, odds = fit(proposed)
    return decide(proposed, odds)
