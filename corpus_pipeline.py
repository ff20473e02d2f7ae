"""Corpus pipeline: quality rules, near-duplicates, decontamination, mix, token files.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but
the last return the columns of documents. Results between stages are stored in the shared
folder and read again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import decontamination, mixing, order_minhash, quality_rules, token_files
from corpuslab.llm.queries import END_ID, tokenizer_file
from corpuslab.session import materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are more likely good than not.

    Null and empty texts fail; repeated rows are judged alike; texts count whole. An empty table
    gives no rows. Columns keep their values, whatever their names.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text")
    voted = materialize(quality_rules.features(packed).drop("text"), "pipeline-votes")
    judged = quality_rules.judge(voted, quality_rules.fit(voted))
    return judged.where("kept").select("_doc.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies, the one with the smallest id.

    Null and empty texts are one group, null ids come last, of repeated rows one stays. An empty
    table gives no rows.
    """
    return order_minhash.deduplicated(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark.

    Null and empty texts share none; repeated rows stay. An empty table, or an empty benchmark,
    takes nothing away.
    """
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order; see :func:`mixing.mix` for odd rows."""
    return mixing.mix(docs)


def to_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents in the order in which the mix stored them, as digests of what is read back.

    The mix's files are numbered in training order and rows lie in order in each; documents that
    do not come from files are taken by id. Null texts give the end id alone; repeated rows stay.
    """
    try:
        stored = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    except AnalysisException:  # not read from files
        return token_files.round_trip(docs, tokenizer_file(), END_ID)
    order = [F.col("_file"), F.col("_index")]
    return token_files.round_trip(stored, tokenizer_file(), END_ID, order=order)


STAGES = [
    ("quality rules", keep_good),
    ("near-duplicates", keep_one_of_each),
    ("decontamination", keep_clean),
    ("mix", mix_sources),
    ("token files", to_token_files),
]

# Weighed votes, sketches and tokens have no SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-stage-{k + 1}")
    return docs


QUERY = {"pipeline": (run, ORACLE_SQL)}
