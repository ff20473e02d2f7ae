"""Class balance and the moving average."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.operators import cleaning, profiling, sampling, windows
from corpuslab.plans import fragments as sql
from corpuslab.plans.corpus import _SHARE_SAMPLE, SEED
from corpuslab.plans.registry import query
from corpuslab.sources.tables import load_table

EXCLUDED_BRANDS = ["Brand#11", "Brand#12", "Brand#13"]


def _brands(spark, sf_dir):
    return load_table(spark, sf_dir, "part", ["p_partkey", "p_brand"])


def _languages(spark, sf_dir):
    return load_table(spark, sf_dir, "documents", ["doc_id", "lang"])


def clean_documents(spark, sf_dir, *columns):
    """Documents through the whole cleaning chain."""
    docs = load_table(spark, sf_dir, "documents", ["doc_id", "lang", "text", *columns], "doc_id")
    return cleaning.clean_corpus(docs, ["text"], ["lang"], required="text")


@query(
    "clean_class_counts",
    "SELECT lang, count(*) AS n FROM documents "
    f"WHERE strip_accents({sql.without_tags('trim(text)')}) <> '' GROUP BY lang",
)
def clean_class_counts(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents", ["doc_id", "lang", "text"], "doc_id")
    return cleaning.clean_class_counts(docs, "lang", required="text")


@query("exclude_classes",
       "SELECT p_partkey, p_brand FROM part WHERE p_brand NOT IN ('Brand#11','Brand#12','Brand#13')")
def exclude_classes(spark, sf_dir):
    return profiling.exclude_classes(_brands(spark, sf_dir), "p_brand", EXCLUDED_BRANDS)


_TIERS = (
    f"WITH c AS ({sql.class_table('part', 'p_brand')}), t AS (SELECT *, "
    "CASE WHEN class_index < 5 THEN 1 WHEN class_index < 14 THEN 2 WHEN class_index < 27 THEN 3 "
    "ELSE 0 END::BIGINT AS tier FROM c) "
)


@query("class_size_tiers", _TIERS + "SELECT p_brand, n, round(share,6) AS share, class_index, tier FROM t")
def class_size_tiers(spark, sf_dir):
    tiers = profiling.class_size_tiers(_brands(spark, sf_dir), "p_brand")
    return tiers.withColumn("share", F.round("share", 6))


@query("rows_in_tier", _TIERS + "SELECT p_partkey, p_brand FROM part JOIN t USING (p_brand) WHERE tier = 2")
def rows_in_tier(spark, sf_dir):
    return profiling.in_tier(_brands(spark, sf_dir), "p_brand", "p_partkey", 2)


@query("class_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def class_counts(spark, sf_dir):
    return profiling.class_counts(_languages(spark, sf_dir), "lang")


@query("class_counts_desc", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def class_counts_desc(spark, sf_dir):
    return profiling.sorted_counts(load_table(spark, sf_dir, "documents", ["source"]), "source")


@query("class_counts_asc", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def class_counts_asc(spark, sf_dir):
    return profiling.sorted_counts(_brands(spark, sf_dir), "p_brand", ascending=True)


@query("top_k_classes",
       "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 20")
def top_k_classes(spark, sf_dir):
    return profiling.extreme_classes(_brands(spark, sf_dir), "p_brand")


@query("bottom_k_classes",
       "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n, p_brand LIMIT 20")
def bottom_k_classes(spark, sf_dir):
    return profiling.extreme_classes(_brands(spark, sf_dir), "p_brand", largest=False)


@query("class_share",
       f"WITH c AS ({sql.class_table('documents', 'lang')}) SELECT lang, n, round(share,6) AS share FROM c")
def class_share(spark, sf_dir):
    table = profiling.class_table(_languages(spark, sf_dir), "lang")
    return table.select("lang", "n", F.round("share", 6).alias("share"))


@query("num_classes", "SELECT count(DISTINCT p_brand) AS n_classes FROM part")
def num_classes(spark, sf_dir):
    return profiling.number_of_classes(_brands(spark, sf_dir), "p_brand")


@query("class_count_stddev",
       "SELECT round(stddev_samp(n),6) AS stddev_n FROM (SELECT count(*) AS n FROM part GROUP BY p_brand)")
def class_count_stddev(spark, sf_dir):
    spread = profiling.class_count_spread(_brands(spark, sf_dir), "p_brand")
    return spread.select(F.round("stddev_n", 6).alias("stddev_n"))


@query("index_counts",
       f"WITH c AS ({sql.class_table('part', 'p_brand')}) SELECT class_index, n FROM c")
def index_counts(spark, sf_dir):
    return profiling.index_counts(_brands(spark, sf_dir), "p_brand")


@query("sampled_class_counts", f"SELECT lang, count(*) AS n FROM ({_SHARE_SAMPLE}) GROUP BY lang")
def sampled_class_counts(spark, sf_dir):
    sample = sampling.share_sample(_languages(spark, sf_dir), "doc_id", "lang", SEED)
    return profiling.class_counts(sample, "lang")


@query(
    "moving_avg",
    "SELECT o_orderkey, o_custkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey "
    "ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING),4) AS moving_avg FROM orders",
)
def moving_avg(spark, sf_dir):
    orders = load_table(
        spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"]
    )
    averaged = windows.moving_average(
        orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", 1, 1,
    )
    return averaged.select("o_orderkey", "o_custkey", F.round("moving_avg", 4).alias("moving_avg"))
