"""Naive Bayes over a vocabulary that is too large for the driver."""

import pytest
from pyspark.ml.feature import CountVectorizer

from corpuslab.operators import classifiers, tokens


@pytest.mark.parametrize("weighted", [True, False])
def test_a_large_vocabulary_gives_the_same_answers_from_tables(spark, monkeypatch, weighted):
    data = [(i % 97, "abc"[i * i % 7 % 3], " ".join(f"w{(i * k * k) % 41}" for k in range(1, 2 + i % 9)) + (" " + "abc"[i * i % 7 % 3]) * (i % 4)) for i in range(200)]
    data += [(None, "c", "w1 b b"), (None, "new", "never seen"), (5, None, "w2"), (6, "a", ""), (7, "b", "B W3")]
    docs = spark.createDataFrame(data, "id bigint, label string, text string")
    train, test = docs.where("id < 60"), docs
    width = tokens.vocabulary(train, "text").count()

    def answers():
        model = classifiers.fit_classifier(train, "label", classifiers.naive_bayes(), classifiers.counted_text_stages("text", width, weighted=weighted))
        return sorted(map(str, classifiers.predictions(model, test, "id", "label").collect()))

    plain = answers()
    monkeypatch.setattr(classifiers, "VOCABULARY_BYTES", 0)
    monkeypatch.setattr(CountVectorizer, "_fit", None)  # nothing as long as the vocabulary is fitted on the driver
    assert answers() == plain and len(plain) == 205 and len({a.rpartition("prediction=")[2] for a in plain}) == 3
    with pytest.raises(ValueError, match="do not fit"):
        classifiers.fit_classifier(train, "label", classifiers.naive_bayes(), classifiers.counted_text_stages("text", width - 1))
