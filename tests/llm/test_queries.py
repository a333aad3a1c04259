"""The registered queries and the pipeline, on whole small tables."""

import random
import re
from collections import Counter

import pytest
import public_tokenizers
import sentencepiece
from check import compare, connection
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from touchline.llm import decontaminate, language_id
from touchline.llm.queries import ORACLES, QUERIES
from touchline.llm.shared import table

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["vec_id", "n_links", "component_id", "kept"],
    "op2": ["doc_id", "held_out", "score", "predicted"],
    "op3": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op4": ["page_id", "host", "path", "rule", "verdict"],
    "op5": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op6": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op7": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op8": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op9": ["doc_id", "n_shingles", "component_id"],
    "op10": ["doc_id", "held_out", "lang_pred", "score"],
    "op11": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    "op12": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op13": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
}
TABLES = {"op1": "embeddings", "op4": "pages", "op11": "embeddings"}
ROWS_EACH = {"op11": 16}


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert set(QUERIES) <= names and "pipeline" in names
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted(COLUMNS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_row_for_each_row(spark, name):
    op = name.split("_")[0]
    got = QUERIES[name](spark, SF)
    assert got.columns[: len(COLUMNS[op])] == COLUMNS[op]
    source = table(spark, SF, TABLES.get(op, "documents"))
    assert Counter(r[0] for r in got.collect()) == Counter(r[0] for r in source.select(COLUMNS[op][0]).collect() for _ in range(ROWS_EACH.get(op, 1)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connection(SF), ORACLES[name]) is None


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate({i: i + 32 for i in range(65, 91)}))


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = table(spark, SF, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if number < 4:
            assert sorted(out.columns) == ["doc_id", "lang", "n_chars", "source", "text"]
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = {r.doc_id: r for r in docs.collect()}
        assert len(after) == docs.count() and set(after) <= set(before)
        if name == "language_id":
            assert set(before) == set(after)  # all of them are prose in a known language
        if name == "quality_vote":
            quality = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
            assert all(quality.get(i, 0) == 0 for i in set(before) - set(after))
        if name == "jaccard_join":
            sets = {i: set(zip(*(words(r.text)[k:] for k in range(5)))) for i, r in before.items()}
            for gone in set(before) - set(after):
                assert any(100 * len(sets[gone] & sets[i]) >= 80 * len(sets[gone] | sets[i]) for i in before if i != gone and len(words(before[i].text)) > 4) \
                    or any(words(before[gone].text) == words(before[i].text) for i in after)
        if name == "decontaminate":
            hit = decontaminate.find_passages(docs.select("doc_id", "text"), table(spark, SF, "benchmark")).filter("size(word_spans) > 0").count()
            assert hit == 0 and all(r.n_chars == len(r.text) for r in after.values())
        if name == "piece_codec":
            for i, r in after.items():
                assert r.token_ids == library.encode(before[i].text, add_bos=True, add_eos=True)
        before = after
    assert 0 < len(before) < table(spark, SF, "documents").count()


def test_language_stage_judges_by_the_byte(spark):
    """Noise and other languages go, whatever their length; clean texts stay, short ones, too."""
    rng = random.Random(1)
    docs = table(spark, SF, "documents")
    prose = [r.text for r in docs.filter("lang = 'en' AND length(text) > 400").limit(20).collect()]
    letters = "abcdefghijklmnopqrstuvwxyz     "
    strange = ["".join(rng.choice(letters) for _ in range(n)) for n in (40, 300, 5000)]
    strange += ["Wszyscy ludzie rodzą się wolni i równi w swojej godności i prawach. " * k for k in (1, 20)]
    strange += ["人人生而自由,在尊严和权利上一律平等。", "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(900)), "12 34", "", None]
    clean = [p[:n].rsplit(" ", 1)[0] for p in prose for n in (40, 120, 400)]
    rows = [(10**6 + i, t, None, "s", 0) for i, t in enumerate(strange + clean)]
    more = docs.unionByName(spark.createDataFrame(rows, docs.select("doc_id", "text", "lang", "source", "n_chars").schema))
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, more, SF).select("doc_id").collect()}
    assert {i for i, *_ in rows if i in kept} == {10**6 + len(strange) + i for i in range(len(clean))}


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, clashing columns and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, predicted string, n_words int, extra int"
    prose = [r.text for r in table(spark, SF, "documents").limit(5).collect()]
    rows = [(1, None, "en", None, None, "x", 1, 1), (2, "", None, "s", 0, "x", 1, 1), (None, prose[0], "en", "s", 1, "x", 1, 1), (4, "12 34", "en", "s", 5, None, 1, 1)]
    rows += [(10 + i, t, None if i else "en", "s", len(t), "x", 1, 7) for i, t in enumerate(prose)] + [(10, prose[0], "en", "s", 1, "x", 1, 7)] * 2
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            path = str(tmp_path / f"{name}-{frame is docs}-{len(frame.head(1))}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        kept = [r.doc_id for r in docs.collect()]
        assert len(kept) == len(set(kept)) and {1, 2, 4}.isdisjoint(kept)
        assert bool(kept) == bool(frame.head(1))


def test_no_language_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "!!", None)], "doc_id long, text string, lang string")
    assert language_id.fit(docs, F.lit(True)) is None
    assert [r.doc_id for r in corpus_pipeline.known_language(spark, docs, SF).collect()] == [1]
