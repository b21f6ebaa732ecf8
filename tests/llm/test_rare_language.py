"""A language with few labelled rows is learned."""

from heddle.llm import language_id


def test_a_rare_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "TRAIN_DOCS", 20)
    rows = [(i, "some words of the usual language " + str(i), "aa") for i in range(2000)] + [(5000 + i, "ßöü wöß tüß öwü " + str(i), "cc") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.fit(docs).languages == ["aa", "cc"]
