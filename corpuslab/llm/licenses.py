"""License scan: exact set-similarity join of text blocks with license templates.

Blocks are overlapping windows of words. A template matches a block that contains at least
``CONTAINED`` of its distinct words. Words are ordered by their frequency in the corpus,
rarest first; a block can only reach the threshold if it holds one of the first
|T| - ceil(0.8 |T|) + 1 words of template T, so only blocks with such a word are compared.

Everything is DataFrame functions. Templates are a fixed list, so what is broadcast or
collected (their words and word counts) does not grow with the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.session import materialize

# Word separators, phrases with labels, license notices.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software "
            "and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", "licensed under the gnu general public license version"),
    ("lgpl", "licensed under the gnu lesser general public license version"),
    ("agpl", "licensed under the gnu affero general public license version"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("all-rights-reserved", "all rights reserved"),
)
CONTAINED = 0.8
STRIDE = 32  # a notice of up to this many words lies whole in some block of twice as many

_WORDS = [sorted(set(t.split())) for _, t in TEMPLATES]
VOCABULARY = sorted({w for ws in _WORDS for w in ws} | {w for p in PHRASES for w in p.split()})
_ASCII_SEPARATORS = "".join(chr(b) for b in range(128) if not (chr(b).isdigit() or chr(b).islower()))
# For each template the others that share the threshold of the shorter one's words.
_ALIKE = [
    [o for o in range(len(_WORDS)) if o != t and len(set(_WORDS[t]) & set(_WORDS[o])) >= CONTAINED * min(len(set(_WORDS[t])), len(set(_WORDS[o])))]
    for t in range(len(_WORDS))]
ADDED = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def known_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_words`` and the places of all words that templates use."""
    # the Kelvin sign would lower-case to an ASCII k and must stay what it is
    body = F.lower(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("K"), F.lit("ĸ")))
    tidy = F.trim(body, F.lit(_ASCII_SEPARATORS))
    kept = [c for c in docs.columns if c not in {text, "n_words", "_known", "_row"}]
    rows = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        F.when(tidy == "", F.array().cast("array<string>")).otherwise(F.split(tidy, SEPARATORS)).alias("_words"))
    known = F.filter(F.transform(F.col("_words"), lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
                     lambda x: x["w"].isin(VOCABULARY))
    return rows.select(*[F.col(f"`{c}`") for c in kept], F.size("_words").cast("long").alias("n_words"),
                       known.alias("_known"), F.monotonically_increasing_id().alias("_row"))


def _phrase_starts(phrase: str) -> Column:
    """Places where the words of a phrase stand one after the other."""
    parts, known = phrase.split(), F.col("_known")

    def here(x: Column, j: Column) -> Column:
        found = x["w"] == parts[0]
        for k, part in enumerate(parts[1:], start=1):
            later = F.get(known, j + k)
            found = found & F.coalesce((later["w"] == part) & (later["i"] == x["i"] + k), F.lit(False))
        return found

    return F.transform(F.filter(known, here), lambda x: x["i"].cast("long"))


def _template_hits(rows: DataFrame) -> DataFrame:
    """(row, label, score): the templates that a block of the row contains.

    All templates at the threshold count, but one that nearly equals another (gpl, lgpl) gives
    way where the other fits the same block better, or as well with more words.
    """
    counted = rows.select(F.explode("_known.w").alias("w")).groupBy("w").count().collect()  # template words only
    count = {r["w"]: r["count"] for r in counted}
    rank = {w: k for k, w in enumerate(sorted(VOCABULARY, key=lambda w: (count.get(w, 0), w)))}
    spark = rows.sparkSession
    templates, prefixes = [], []
    for number, (label, _) in enumerate(TEMPLATES):
        ordered = sorted(_WORDS[number], key=rank.get)
        needed = math.ceil(CONTAINED * len(ordered) - 1e-9)
        templates.append((number, label, ordered, needed))
        # positional filter: with its first common word at place p, a block shares at most len - p
        prefixes += [(w, number) for p, w in enumerate(ordered) if len(ordered) - p >= needed]
    first_words = sorted({w for w, _ in prefixes})
    templates = spark.createDataFrame(templates, "template int, label string, ordered array<string>, needed int")
    prefixes = spark.createDataFrame(prefixes, "w string, template int")
    able = rows.where(F.exists("_known", lambda x: x["w"].isin(first_words)))
    words = able.select("_row", F.explode("_known").alias("k")).select(
        "_row", F.col("k.w").alias("w"), F.floor(F.col("k.i") / STRIDE).alias("block"))
    blocks = words.select("_row", "w", F.explode(F.array("block", F.col("block") - 1)).alias("block")).groupBy(
        "_row", "block").agg(F.collect_set("w").alias("words"))  # at most the vocabulary
    pairs = blocks.select("_row", "block", "words", F.explode("words").alias("w")).join(
        F.broadcast(prefixes), "w").select("_row", "block", "words", "template").distinct()
    pairs = pairs.join(F.broadcast(templates), "template").where(F.size("words") >= F.col("needed"))  # length filter
    shared = F.size(F.array_intersect("words", "ordered"))
    found = pairs.where(shared >= F.col("needed")).select(
        "_row", "block", F.struct((shared / F.size("ordered")).alias("score"), F.size("ordered").alias("size"), "label", "template").alias("hit"))
    hits = found.groupBy("_row", "block").agg(F.collect_set("hit").alias("hits"))  # at most the templates
    alike = F.create_map(*[x for t in range(len(TEMPLATES)) for x in (F.lit(t), F.array(*[F.lit(o) for o in _ALIKE[t]]).cast("array<int>"))])
    beaten = lambda h: F.exists("hits", lambda g: (F.struct(g["score"], g["size"]) > F.struct(h["score"], h["size"])) & F.array_contains(
        F.element_at(alike, h["template"]), g["template"]))
    return hits.select("_row", F.explode(F.filter("hits", lambda h: ~beaten(h))).alias("h")).select("_row", "h.label", "h.score")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with places of the base phrases and all license labels.

    Adds ``n_words``, ``n_base`` (places of the phrases), ``first_word`` and ``last_word`` (their
    smallest and largest start, else null), ``base_labels`` and ``labels`` (sorted,
    comma-joined) and ``score``: 1 with a base phrase, else the best containment of a
    matching template, else 0. Null text counts as empty; empty tables give no rows;
    repeated rows stay; columns with the names of added ones are replaced.
    """
    kept = [c for c in docs.columns if c not in {text, *ADDED}]
    rows = materialize(known_words(docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("_text")), "_text"), "known-words")
    hits = _template_hits(rows).groupBy("_row").agg(
        F.collect_set("label").alias("_labels"), F.max("score").alias("_score"))
    starts = {label: _phrase_starts(p) for p, label in PHRASES.items()}
    based = rows.withColumns({f"_at_{i}": s for i, s in enumerate(starts.values())})
    places = F.concat(*[F.col(f"_at_{i}") for i in range(len(starts))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"_at_{i}") > 0, label) for i, label in enumerate(starts)]))
    based = based.select(
        *[F.col(f"`{c}`") for c in kept], "_row", "n_words", F.size(places).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), labels.alias("_base"))
    empty = F.array().cast("array<string>")
    joined = based.join(hits, "_row", "left")
    every = F.array_union(F.col("_base"), F.coalesce("_labels", empty))
    return joined.select(
        *[F.col(f"`{c}`") for c in kept], "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"))
