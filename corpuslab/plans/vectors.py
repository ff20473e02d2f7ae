"""Label indexes and numeric vectors."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from corpuslab.operators import features
from corpuslab.plans import fragments as sql
from corpuslab.plans.registry import query
from corpuslab.sources.tables import load_table

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]
INDEXED = ["l_quantity", "l_discount", "l_tax"]
LINE = ["l_orderkey", "l_linenumber"]
# Category limits in use.
MAX_CATEGORIES = 29

_INDEX = f"WITH c AS ({sql.class_table('part', 'p_brand')}) "


def _brand_index(spark, sf_dir):
    parts = load_table(spark, sf_dir, "part", ["p_partkey", "p_brand"])
    model = features.fit_string_index(parts, "p_brand", "brand_index")
    return model, model.transform(parts)


@query("string_index", _INDEX + "SELECT p_partkey, class_index::DOUBLE AS brand_index FROM part JOIN c USING (p_brand)")
def string_index(spark, sf_dir):
    return _brand_index(spark, sf_dir)[1].select("p_partkey", "brand_index")


@query(
    "index_to_string",
    _INDEX + "SELECT p_partkey, class_index::DOUBLE AS brand_index, p_brand AS brand FROM part JOIN c USING (p_brand)",
)
def index_to_string(spark, sf_dir):
    model, indexed = _brand_index(spark, sf_dir)
    named = features.index_to_string(indexed.drop("p_brand"), "brand_index", model.labels, "brand")
    return named.select("p_partkey", "brand_index", "brand")


def _lines(spark, sf_dir, columns):
    return load_table(spark, sf_dir, "lineitem", [*LINE, *columns])


@query(
    "vector_index_slots",
    " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS slot, count(DISTINCT {c}) AS n_values, "
        f"count(DISTINCT {c}) <= {MAX_CATEGORIES} AS is_categorical FROM lineitem"
        for i, c in enumerate(NUMBERS)
    ),
)
def vector_index_slots(spark, sf_dir):
    return features.slot_cardinality(_lines(spark, sf_dir, NUMBERS), NUMBERS, MAX_CATEGORIES)


@query(
    "vector_index_values",
    "SELECT l_orderkey, l_linenumber, l_quantity AS quantity, "
    "(dense_rank() OVER (ORDER BY l_discount)-1)::DOUBLE AS discount, "
    "(dense_rank() OVER (ORDER BY l_tax)-1)::DOUBLE AS tax FROM lineitem",
)
def vector_index_values(spark, sf_dir):
    """Discount and tax have few values and become indexes; quantity stays a number."""
    vectors = features.assemble(_lines(spark, sf_dir, INDEXED), INDEXED)
    slots = vector_to_array("indexed")
    return features.index_vector(vectors, "features", MAX_CATEGORIES).select(
        *LINE, slots[0].alias("quantity"), slots[1].alias("discount"), slots[2].alias("tax")
    )


@query(
    "assemble_features",
    "SELECT l_orderkey, l_linenumber, l_quantity AS f0, l_extendedprice AS f1, l_discount AS f2 FROM lineitem",
)
def assemble_features(spark, sf_dir):
    slots = vector_to_array("features")
    return features.assemble(_lines(spark, sf_dir, NUMBERS), NUMBERS).select(
        *LINE, *[slots[i].alias(f"f{i}") for i in range(len(NUMBERS))]
    )


@query(
    "vector_roundtrip",
    "SELECT vec_id, generate_subscripts(embedding,1)-1 AS slot, round(unnest(embedding)::DOUBLE,6) AS value "
    "FROM embeddings",
)
def vector_roundtrip(spark, sf_dir):
    rows = load_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    slots = features.vector_slots(features.to_vector(rows, "embedding"), "features", ["vec_id"])
    return slots.withColumn("value", F.round("value", 6))


@query(
    "standard_scale",
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(
        f"round(({c}-avg({c}) OVER ())/stddev_samp({c}) OVER (),6) AS z{i}" for i, c in enumerate(NUMBERS)
    )
    + " FROM lineitem",
)
def standard_scale(spark, sf_dir):
    vectors = features.assemble(_lines(spark, sf_dir, NUMBERS), NUMBERS)
    slots = vector_to_array("scaled")
    return features.standard_scale(vectors, "features").select(
        *LINE, *[F.round(slots[i], 6).alias(f"z{i}") for i in range(len(NUMBERS))]
    )
