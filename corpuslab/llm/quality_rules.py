"""Quality rules under weak supervision: rules vote or abstain, and the posterior decides.

Everything is DataFrame functions. Features are computed inside each row, so nothing but
the vote patterns is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import bound
from corpuslab.llm.voting import Reliability, fit_reliability

# Word characters, symbols, windows and limits of the base rules.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

# Frequent words of the languages in use; prose holds some of them, lists and noise few.
STOP_WORDS = (
    "the of and to in is that for was with as by on are this from have not "
    "le la les de des et un une est que qui en pour dans du au "
    "der die das und ist ein eine zu von mit den nicht auf "
    "el los las y del por con su para una se no lo"
).split()

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VOTES = ["_v_length", "_v_word_length", "_v_symbols", "_v_lines", "_v_repeats", "_v_stop_words",
         "_v_capitals", "_v_marks", "_v_bare"]


def _alias(name: str) -> str:
    return f"_qr_{name}"


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with counts and votes in place of columns of these names, all from whole texts.

    Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long),
    ``base_failed`` and the votes. Null text counts as empty: no words, base failed.
    Columns of ``docs`` whose names clash with the added ones are replaced; all others,
    and repeated rows, stay as they are.
    """
    kept = [c for c in docs.columns if c not in {*FEATURES, *VOTES, "base_failed"}]
    body = F.coalesce(F.col(text), F.lit(""))
    tidy = F.trim(body, F.lit(SPACES))
    rows = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        F.when(tidy == "", F.array().cast("array<string>")).otherwise(F.split(tidy, SPACE_RUN))
        .alias(_alias("words")),
        F.filter(F.split(body, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "").alias(_alias("lines")),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(body, F.lit("[A-Z]")).alias(_alias("capitals")),
        F.regexp_count(body, F.lit("[!?#*$%&|<>]{2}")).alias(_alias("marks")),
        F.regexp_count(body, F.lit(r"\x20[#*$%&|<>=~_-]+(?=[\x20\n])")).alias(_alias("bare")),
    )
    words, lines = F.col(_alias("words")), F.col(_alias("lines"))
    n = F.size(words)
    rows = rows.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        _alias("n_lines"): F.size(lines),
        _alias("stops"): F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))),
        "n_repeat_words": bound(words, _repeated_words).cast("long"),
    })
    rows = rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))
    return rows.select(*[F.col(f"`{c}`") for c in kept], *FEATURES, "base_failed", *_votes())


def _repeated_words(words: Column) -> Column:
    """Words in windows found twice or more. What inner functions read is bound first, so that a
    filter on the result, moved below the projection, does not work it out for every window."""
    # a 64-bit hash stands for the eight words; windows compare only within one text
    n = F.size(words)
    hashes = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    return bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), bound(
        F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), _covered_by_repeats)).otherwise(F.lit(0)))


def _covered_by_repeats(order: Column) -> Column:
    def has_equal_neighbour(x: Column, k: Column) -> Column:
        return ((k > 0) & (F.get(order, k - 1)["h"] == x["h"])) | F.coalesce(F.get(order, k + 1)["h"] == x["h"], F.lit(False))

    return _covered(F.array_sort(F.transform(F.filter(order, has_equal_neighbour), lambda x: x["i"])))


def _covered(starts: Column) -> Column:
    """Words in the windows that begin at the sorted positions, each counted once."""
    first = F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(starts, first, lambda a, p: F.struct(
        (a["total"] + F.least(F.lit(WINDOW), p - a["last"])).alias("total"), p.alias("last")),
        lambda a: a["total"])


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def _votes() -> list[Column]:
    """One vote per rule; a rule abstains where its measure says little."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / n
    symbols, repeats = F.col("n_symbols") / n, F.col("n_repeat_words") / n
    lines = F.col(_alias("n_lines"))
    dup = F.col("n_dup_lines") / F.greatest(lines, F.lit(1))
    stops, capitals = F.col(_alias("stops")) / n, F.col(_alias("capitals")) / F.greatest(F.col("word_chars"), F.lit(1))
    marks, bare = F.col(_alias("marks")) / n, F.col(_alias("bare")) / n
    enough = F.col("n_words") >= LEAST_WORDS
    columns = [
        _vote(F.lit(False), F.col("n_words") >= 2 * LEAST_WORDS),  # too short: a base rule
        _vote((mean < 2.5) | (mean > 14), (mean >= 3.5) & (mean <= 10)),
        _vote(symbols > 0.2, symbols < 0.02),
        _vote(dup > 0.3, (dup == 0) & (lines >= 3)),
        _vote(repeats > 0.2, enough & (repeats < 0.05)),
        _vote(enough & (stops < 0.01), stops > 0.08),
        _vote(enough & (capitals > 0.4), enough & (capitals < 0.1)),
        _vote(enough & (marks > 0.15), enough & (marks < 0.02)),
        _vote(enough & (bare > 0.1), enough & (bare < 0.02)),
    ]
    return [c.alias(name) for c, name in zip(columns, VOTES)]


def fit(voted: DataFrame) -> Reliability:
    """Rule reliabilities from the votes of :func:`features`, over all rows."""
    return fit_reliability(voted, VOTES)


def judge(voted: DataFrame, model: Reliability) -> DataFrame:
    """Add ``posterior`` (of good quality, 0 to 1) and ``kept``; the votes are dropped."""
    posterior = model.posterior([F.col(v) for v in VOTES])
    rows = voted.withColumn("posterior", posterior)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)).drop(*VOTES)
