"""The language model and the bars of the pipeline come from all texts to learn from."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from touchline.llm import language_id
from touchline.llm.shared import fold


@pytest.fixture(scope="module")
def docs(spark):
    # More texts than any fixed number of some 1,500 a language would take.
    rows = [(i, f"words {i} of a text" if i % 2 else f"un texte {i}", "en" if i % 2 else "fr", "web", 10) for i in range(6000)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_every_text_to_learn_from_is_counted(spark, docs, monkeypatch):
    seen = {}

    def build(langs, lengths, grams, counts, order):
        seen["bytes"] = int(counts[lengths == 1].sum())
        return whole(langs, lengths, grams, counts, order)

    whole = language_id.build
    monkeypatch.setattr(language_id, "build", build)
    kept = corpus_pipeline.known_language(spark, docs, "")
    learned = docs.filter(fold("doc_id", 5) != 0)
    assert seen["bytes"] == learned.agg(F.sum(F.octet_length("text"))).first()[0]
    assert kept.count() == docs.count()


def test_bars_are_means_over_all_texts(docs):
    model = language_id.fit(docs, F.lit(True))
    judged = [r for r in language_id.predict(docs, model).collect() if r["lang"] == r["lang_pred"]]
    for lang, bits in language_id.own_bits(docs, model, F.lit(True)).items():
        mine = [(len(r["text"]), r["bits_per_byte"]) for r in judged if r["lang"] == lang]
        assert bits == pytest.approx(sum(n * b for n, b in mine) / sum(n for n, _ in mine))
