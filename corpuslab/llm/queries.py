"""Registered queries of the subpackage, one per operator, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import (
    conversations, cotraining, decontamination, licenses, mixing, order_minhash, personal_data, ppm, quality_rules,
    resampling, secrets, token_files, warc,
)
from corpuslab.llm.registry import QUERIES, documents, query  # noqa: F401
from corpuslab.session import materialize, scratch_path


@query("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the weighed verdict for each document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    voted = materialize(quality_rules.features(docs).drop("text"), "quality-votes")
    judged = quality_rules.judge(voted, quality_rules.fit(voted))
    return judged.select("doc_id", *quality_rules.FEATURES, "base_failed", "kept", "posterior")


@query("op3_order_minhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class of exact and near copies."""
    return order_minhash.classes(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "class_id")


@query("op5_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that share an aligned passage."""
    docs = documents(spark, sf_dir)
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    found = decontamination.overlaps(docs, items)
    ids = docs.select("doc_id", decontamination.text_key("text").alias("key"))
    item_ids = items.select("item_id", decontamination.text_key("text").alias("item"))
    return found.join(ids, "key").join(item_ids, "item").select(
        "doc_id", "item_id", "n_equal", "n_span", "first_word")


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document, as counts of the base kinds and digests of the spans."""
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    spans, kinds = F.col("spans"), [r[0] for r in secrets.BASE_RULES]
    return found.select(
        "doc_id", *[secrets.count_of(spans, k) for k in kinds],
        secrets.base_digest(spans, kinds).alias("base_sha256"), secrets.listed(spans).alias("spans"))


@query("op8_license_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates found in each document."""
    return licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))


@query("op9_personal_data")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each document, as counts of the base kinds and digests of the spans."""
    found = personal_data.find(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["is_base"])
    counts = [secrets.count_of(base, k) for k in personal_data.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"),
                        secrets.listed(F.col("spans")).alias("spans"))


END_ID = 2


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_token_files")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents in binary files, as digests of the files read back."""
    return token_files.round_trip(documents(spark, sf_dir), tokenizer_file(), END_ID)


@query("op2_ppm_score")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PPM and word-frequency scores of all documents."""
    return ppm.score(documents(spark, sf_dir))


SQL_MIX = r"""
WITH rows_ AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(concat_ws(':', CAST(doc_id AS VARCHAR), text)) AS key
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM rows_ GROUP BY source),
limits AS (
  SELECT *, CAST(rank % 3 + 1 AS BIGINT) AS weight, 3 * source_size AS limit_ FROM sources),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(limit_) OVER w, 0) AS DOUBLE)
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level
  FROM limits
  WINDOW w AS (ORDER BY limit_ / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
common AS (
  SELECT arg_min(level, (limit_ / weight, rank)) AS level FROM levels WHERE level * weight < limit_),
targets AS (
  SELECT source, source_size, rank,
         coalesce(least((SELECT level FROM common) * weight, CAST(limit_ AS DOUBLE)), CAST(limit_ AS DOUBLE)) AS target
  FROM levels),
streams AS (
  SELECT doc_id, source, size, key,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           + size / 2 AS middle
  FROM rows_),
plan AS (
  SELECT s.*, t.source_size, t.target, t.rank,
         CAST(CASE WHEN s.size = 0 THEN 0
                   ELSE greatest(0, least(3, ceil((t.target - s.middle) / t.source_size))) END AS BIGINT) AS copies
  FROM streams s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
-- each copy's share of its source's words, and the time at which weights of 1.5 falling to 0.5, of 1, or of
-- 0.5 rising to 1.5 have that share due
shares AS (
  SELECT *, (middle + copy * source_size) / target AS share FROM (SELECT *, unnest(range(copies)) AS copy FROM plan)),
timed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN (sqrt(greatest(1.5 * 1.5 + 2 * -1.0 * share, 0.0)) - 1.5) / -1.0
                          WHEN 1 THEN share
                          ELSE (sqrt(greatest(0.5 * 0.5 + 2 * 1.0 * share, 0.0)) - 0.5) / 1.0 END AS at_ FROM shares),
placed AS (SELECT *, row_number() OVER (ORDER BY at_, key, copy) - 1 AS place FROM timed)
SELECT p.doc_id, CAST(p.size AS BIGINT) AS size, p.source_size, p.target, CAST(p.copies * p.size AS BIGINT) AS taken,
       round(f.at_, 9) AS first_at, f.place AS first_place
FROM plan p LEFT JOIN placed f ON f.copy = 0 AND f.doc_id IS NOT DISTINCT FROM p.doc_id AND f.key = p.key
"""


@query("op6_curriculum_mix", SQL_MIX)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, with its source's size and target, and when it first comes."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    sizes = materialize(mixing.sized(docs).drop("text"), "mix-sizes")
    plan = materialize(mixing.planned(sizes), "mix-plan")
    return mixing.sequenced(plan).select("doc_id", "size", "source_size", "target", "taken",
                                         F.round("first_at", 9).alias("first_at"), "first_place")


@query("op4_cotraining")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of all documents from two co-trained views."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return cotraining.score(docs, cotraining.fit(docs, labels))


SQL_WARC = """
WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
hashed AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS h,
           min(page_id) OVER (PARTITION BY body) AS smallest FROM bodies)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM smallest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM smallest THEN smallest END AS refers_to
FROM hashed
"""


@query("op11_warc_archives", SQL_WARC)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, digest and kind of the record of each page, read back from the archives."""
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")
    path = scratch_path(spark, "archives")
    warc.write(pages, path)
    id_type = pages.schema["page_id"].dataType
    return warc.read(spark, path).select(
        F.col("page_id").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(id_type).alias("refers_to"))


SQL_RESAMPLING = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k:
      CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(n))),
texts AS (
  SELECT doc_id, row_number() OVER () AS nr, true AS own, text FROM documents
  UNION ALL SELECT NULL, 0, false, text FROM benchmark),
words AS (
  SELECT nr, own, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
buckets AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(word)),
      lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM words), crc_table),
counts AS (
  SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM words JOIN buckets USING (word) GROUP BY bucket),
totals AS (SELECT sum(s) AS s, sum(t) AS t FROM counts),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(c.t + 1 AS DOUBLE) * CAST(z.s + 10000 AS DOUBLE)
    / (CAST(c.s + 1 AS DOUBLE) * CAST(z.t + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM counts c, totals z),
weights AS (
  SELECT nr, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight
  FROM words JOIN buckets USING (word) JOIN gains USING (bucket) WHERE own GROUP BY nr),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT
      AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM texts LEFT JOIN weights USING (nr) WHERE texts.own),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (n_features >= 20) OVER () AS n_enough FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND place <= 10 * n_enough // 100 THEN place END AS rank FROM ranked
"""


@query("op12_importance_resampling", SQL_RESAMPLING)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of all documents in a draw that resembles the benchmark."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return resampling.resampled(documents(spark, sf_dir), items).select(
        F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cost, audit and digest of each conversation, damaged on purpose and repaired."""
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")
    return conversations.report(conversations.damaged(rows)).withColumnRenamed("conv", "conv_id")
