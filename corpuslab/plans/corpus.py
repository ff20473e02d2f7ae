"""Cleaning, auditing and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions.text import strip_tags
from corpuslab.operators import cleaning, sampling
from corpuslab.plans import fragments as sql
from corpuslab.plans.registry import query
from corpuslab.sources.tables import first_line, load_table

SEED = 1234
TRAIN_TEST = [0.7, 0.3]
UNEVEN_WEIGHTS = [0.7, 0.4]
LANGUAGE_FRACTIONS = {"en": 0.2, "fr": 0.5, "de": 0.8}


def _documents(spark, sf_dir, *columns):
    return load_table(spark, sf_dir, "documents", list(columns), "doc_id")


def _pages(spark, sf_dir):
    return load_table(spark, sf_dir, "pages", ["page_id", "html"], "page_id")


@query("project_label_text", "SELECT lang AS label, text AS features FROM documents")
def project_label_text(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents", ["lang", "text"])
    return cleaning.label_features(docs, "lang", "text")


@query("trim_text", "SELECT doc_id, trim(text) AS text FROM documents")
def trim_text(spark, sf_dir):
    return cleaning.trim_columns(_documents(spark, sf_dir, "doc_id", "text"), ["text"])


@query("strip_tags", f"SELECT page_id, {sql.without_tags('html')} AS html FROM pages")
def strip_tags_query(spark, sf_dir):
    return cleaning.strip_tag_columns(_pages(spark, sf_dir), ["html"])


@query("remove_accents", "SELECT doc_id, strip_accents(text) AS text FROM documents")
def remove_accents(spark, sf_dir):
    return cleaning.remove_accent_columns(_documents(spark, sf_dir, "doc_id", "text"), ["text"])


@query(
    "clean_pages",
    f"SELECT page_id, strip_accents({sql.without_tags('trim(html)')}) AS html FROM pages "
    f"WHERE strip_accents({sql.without_tags('trim(html)')}) <> ''",
)
def clean_pages(spark, sf_dir):
    return cleaning.clean_corpus(_pages(spark, sf_dir), ["html"], required="html")


@query(
    "drop_blank_text",
    "SELECT conv_id, turn, trim(regexp_replace(text,'<.*?>','','g')) AS text FROM conversations "
    "WHERE trim(regexp_replace(text,'<.*?>','','g')) <> ''",
)
def drop_blank_text(spark, sf_dir):
    turns = load_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    return cleaning.drop_blank(turns.withColumn("text", F.trim(strip_tags(F.col("text")))), "text")


_AFTER_FIRST_LINE = "CASE WHEN strpos(text,chr(10))=0 THEN '' ELSE substr(text,strpos(text,chr(10))+1) END"


@query(
    "count_blank",
    f"SELECT count(*) FILTER (WHERE trim({_AFTER_FIRST_LINE})='') AS rest, "
    "count(*) FILTER (WHERE trim(split_part(text,chr(10),1))='') AS summary FROM documents",
)
def count_blank(spark, sf_dir):
    """Documents with nothing after their first line, and with a blank first line."""
    newline = F.instr("text", "\n")
    rest = F.when(newline == 0, "").otherwise(F.substr(F.col("text"), newline + 1))
    docs = load_table(spark, sf_dir, "documents", ["text"]).select(
        F.trim(rest).alias("rest"), F.trim(first_line("text")).alias("summary")
    )
    return cleaning.count_blank(docs, ["rest", "summary"])


def _audit_sql(table, floats, others):
    parts = [f"count(*) FILTER (WHERE {c} IS NULL OR isnan({c})) AS {c}" for c in floats]
    parts += [f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in others]
    return f"SELECT {', '.join(parts)} FROM {table}"


@query("null_audit", _audit_sql(
    "lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"],
))
def null_audit(spark, sf_dir):
    return cleaning.null_audit(load_table(spark, sf_dir, "lineitem"))


@query("null_audit_documents", _audit_sql(
    "documents LEFT JOIN labels USING (doc_id)", [],
    ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"],
))
def null_audit_documents(spark, sf_dir):
    """Documents with their labels, which only some have."""
    docs = load_table(spark, sf_dir, "documents")
    labels = load_table(spark, sf_dir, "labels")
    return cleaning.null_audit(docs.join(labels, "doc_id", "left"))


_BODY = "SELECT doc_id, lang, trim(text) AS text, 'body' AS part FROM documents WHERE trim(text) <> ''"
_SUMMARY = (
    "SELECT doc_id, lang, trim(split_part(text, chr(10), 1)) AS text, 'summary' AS part "
    "FROM documents WHERE trim(split_part(text, chr(10), 1)) <> ''"
)


@query("corpus_by_text_column", f"{_BODY} UNION ALL {_SUMMARY}")
def corpus_by_text_column(spark, sf_dir):
    docs = _documents(spark, sf_dir, "doc_id", "lang", "text").select(
        "doc_id", "lang", F.trim("text").alias("body"), F.trim(first_line("text")).alias("summary")
    )
    parts = [
        cleaning.corpus_of(docs, c, ["doc_id", "lang"]).withColumn("part", F.lit(c))
        for c in ("body", "summary")
    ]
    return parts[0].unionByName(parts[1])


@query("bernoulli_sample")
def bernoulli_sample(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents", ["doc_id", "lang"])
    return sampling.bernoulli_sample(docs, 0.05, 42)


@query("hash_sample", f"SELECT doc_id, lang FROM documents WHERE {sql.unit('doc_id')} < 0.05")
def hash_sample(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents", ["doc_id", "lang"])
    return sampling.hash_sample(docs, "doc_id", 0.05)


@query("sample_by")
def sample_by(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents", ["doc_id", "lang"])
    return sampling.class_sample(docs, "lang", LANGUAGE_FRACTIONS, SEED)


_FRACTIONS = "CASE lang WHEN 'en' THEN 0.2 WHEN 'fr' THEN 0.5 WHEN 'de' THEN 0.8 ELSE 0 END"


@query(
    "hash_sample_by",
    f"SELECT doc_id, lang FROM documents WHERE {sql.unit('doc_id', SEED)} < {_FRACTIONS}",
)
def hash_sample_by(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents", ["doc_id", "lang"])
    return sampling.hash_class_sample(docs, "doc_id", "lang", LANGUAGE_FRACTIONS, SEED)


_SHARE_SAMPLE = (
    f"WITH c AS ({sql.class_table('documents', 'lang')}) "
    f"SELECT doc_id, lang FROM documents JOIN c USING (lang) WHERE {sql.unit('doc_id', SEED)} < share"
)


@query("share_sample", _SHARE_SAMPLE)
def share_sample(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents", ["doc_id", "lang"])
    return sampling.share_sample(docs, "doc_id", "lang", SEED)


@query("random_split")
def random_split(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents", ["doc_id", "lang"])
    parts = sampling.random_split(docs, TRAIN_TEST, SEED)
    numbered = [p.withColumn("split", F.lit(i).cast("bigint")) for i, p in enumerate(parts)]
    return numbered[0].unionByName(numbered[1])


@query("random_split_cover", "SELECT doc_id, lang, 1::BIGINT AS n_parts FROM documents")
def random_split_cover(spark, sf_dir):
    """Each row is in exactly one part, whichever it is."""
    docs = load_table(spark, sf_dir, "documents", ["doc_id", "lang"])
    first, second = sampling.random_split(docs, UNEVEN_WEIGHTS, SEED)
    return first.unionByName(second).groupBy("doc_id", "lang").agg(F.count(F.lit(1)).alias("n_parts"))


@query(
    "hash_split",
    f"SELECT doc_id, CASE WHEN {sql.unit('doc_id', SEED)} < 0.7 THEN 0 ELSE 1 END::BIGINT AS split "
    "FROM documents",
)
def hash_split(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents", ["doc_id"])
    return sampling.hash_split(docs, "doc_id", TRAIN_TEST, SEED)


@query(
    "hash_split_uneven_weights",
    f"SELECT doc_id, CASE WHEN {sql.unit('doc_id', SEED)} < 0.7::DOUBLE/1.1::DOUBLE THEN 0 ELSE 1 END::BIGINT "
    "AS split FROM documents",
)
def hash_split_uneven_weights(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents", ["doc_id"])
    return sampling.hash_split(docs, "doc_id", UNEVEN_WEIGHTS, SEED)
