"""From a delimited news file to scored predictions, as a user would write it."""

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import cleaning, metrics, naive_bayes, profiling, sampling
from corpuslab.session import scratch_path
from corpuslab.sources import delimited

WORDS = {
    "Saúde": "hospital médico vacina saúde", "Política": "voto senado ministro lei",
    "Economia": "banco juros mercado inflação",
}


@pytest.fixture(scope="module")
def news(spark):
    rows = []
    for i in range(300):
        name = "Política" if i % 2 else ("Saúde" if i % 3 else "Economia")
        words = WORDS[name].split()
        body = f"  <p>{words[i % 4]} {words[(i + 1) % 4]}; {words[i % 3]}</p> "
        rows.append((i, f" {name} ", None if i % 50 == 0 else "<br>" if i % 51 == 0 else body, f"resumo {i}", "t\nt"))
    path = scratch_path(spark, "news")
    delimited.write_delimited(spark.createDataFrame(rows, delimited.NEWS_SCHEMA), path)
    return delimited.read_delimited(spark, path)


def test_news_flow(news):
    audit = cleaning.null_audit(news).first().asDict()
    assert audit == {"codigo": 0, "classificacao": 0, "conteudo": 6, "resumo": 0, "titulo": 0}

    clean = cleaning.clean_corpus(
        news, ["conteudo", "resumo", "titulo"], ["classificacao"], required="conteudo"
    )
    blank = {i for i in range(300) if i % 50 == 0 or i % 51 == 0}
    assert {r.codigo for r in clean.select("codigo").collect()} == set(range(300)) - blank
    counts = [(r.classificacao, r.n) for r in profiling.sorted_counts(clean, "classificacao").collect()]
    assert [name for name, _ in counts] == ["Politica", "Saude", "Economia"]

    split = sampling.hash_split(clean, "codigo", [0.7, 0.3], 1234)
    model = naive_bayes.fit_naive_bayes(
        split, "classificacao", "conteudo", F.col("split") == 0, idf=naive_bayes.IDF_TRAIN
    )
    test = split.where("split = 1")
    scored = model.predict(test, "codigo", "conteudo", "classificacao")
    assert scored.count() == test.count()
    assert metrics.accuracy(metrics.confusion_matrix(scored)).first().accuracy == 1.0
