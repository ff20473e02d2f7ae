import pytest
from pyspark.sql import functions as F

from corpuslab.operators import profiling

# Class counts of the news corpus.
NEWS_COUNTS = {
    "Politica": 187803, "Judiciario": 114835, "Economia": 93441, "Saude": 63747, "Educacao": 38337,
    "Violencia": 29667, "Meio Ambiente": 20939, "Agronegocio": 20053, "Esporte": 15672,
    "Transporte": 14276, "Energia": 13987, "Infraestrutura": 13608, "Trabalho": 12736,
    "Cultura": 11146, "Politica GDF": 6146, "Habitacao": 6146, "Aviacao": 6082,
    "Contas Publicas": 5419, "Telecomunicacoes": 5329, "Previdencia": 5290, "Legislacao": 5286,
    "Turismo e lazer": 4641, "Petroleo": 4237, "Consumo": 2926, "Comercio Exterior": 2477,
    "Credito": 2062, "Especial": 1970, "Mineracao": 751, "Producao": 529,
}


@pytest.fixture(scope="module")
def news(spark):
    counts = spark.createDataFrame(list(NEWS_COUNTS.items()), "classificacao string, n int")
    return counts.select("classificacao", F.explode(F.sequence(F.lit(1), "n")).alias("codigo"))


def test_tiers_of_the_news_corpus(news):
    tiers = {r.classificacao: r.tier for r in profiling.class_size_tiers(news, "classificacao").collect()}
    assert [sum(t == k for t in tiers.values()) for k in (1, 2, 3, 0)] == [5, 9, 13, 2]
    assert tiers["Educacao"] == 1 and tiers["Cultura"] == 2 and tiers["Especial"] == 3
    assert tiers["Producao"] == tiers["Mineracao"] == 0


@pytest.mark.parametrize("tier, rows", [(1, 498163), (2, 152084), (3, 58011)])
def test_rows_in_tier(news, tier, rows):
    assert profiling.in_tier(news, "classificacao", "codigo", tier).count() == rows


def test_share_within_the_largest_tier(news):
    largest = profiling.in_tier(news, "classificacao", "codigo", 1)
    shares = {r.classificacao: r.share for r in profiling.class_table(largest, "classificacao").collect()}
    # Published to four places, cut rather than rounded.
    published = {"Educacao": 0.0769, "Saude": 0.1279, "Economia": 0.1875, "Judiciario": 0.2305, "Politica": 0.3769}
    assert {k: int(v * 10000) / 10000 for k, v in shares.items()} == published
    assert sum(shares.values()) == pytest.approx(1.0)


def test_order_and_extremes(news):
    desc = [r.classificacao for r in profiling.sorted_counts(news, "classificacao").collect()]
    asc = [r.classificacao for r in profiling.sorted_counts(news, "classificacao", ascending=True).collect()]
    assert desc[:2] == ["Politica", "Judiciario"] and asc[:2] == ["Producao", "Mineracao"]
    assert desc.index("Habitacao") < desc.index("Politica GDF")
    assert [r.n for r in profiling.extreme_classes(news, "classificacao", 3).collect()] == [187803, 114835, 93441]
    assert profiling.number_of_classes(news, "classificacao").first().n_classes == 29


def test_index_follows_count_order(news):
    indexed = {r.class_index: r.n for r in profiling.index_counts(news, "classificacao").collect()}
    assert [indexed[i] for i in range(29)] == sorted(NEWS_COUNTS.values(), reverse=True)


def test_label_ties_are_ordered_by_name(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3), ("c", 4)], "k string, id bigint")
    got = {r.k: r.class_index for r in profiling.with_class_index(df, "k", "id").collect()}
    assert got == {"c": 0, "a": 1, "b": 2}


def test_exclusion_drops_null_classes(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert [r.k for r in profiling.exclude_classes(df, "k", ["a"]).collect()] == ["b"]


def test_sql_counts(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "k string")
    rows = profiling.sql_class_counts(df, "k", "tmp_news").collect()
    assert [(r.k, r.n) for r in rows] == [("b", 1), ("a", 2)]
