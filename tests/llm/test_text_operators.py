"""Operators that judge, count or encode one text at a time."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from touchline.llm import byteblocks, language_id, piece_codec, quality_vote, token_counts
from touchline.llm.shared import fold, ship_package

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def odd_texts():
    rng = random.Random(5)
    out = ["", None, " ", "a.", "\n\n", "  a  b\n c ", "<|startoftext|>x <|STARTOFTEXT|>.", "é ≠ ́x", "it's. dont'.", "x...!? y", "▁ ▁▁x",
           "İ ΑΣ ΑΣ.", "①ﬁ́é\x00 <0x0A> <s>", "　梦🙂🙂a🙂", " " * 91 + "x", "lalalala lolo", "A" * 3000, "ab " * 2000, "a" * 500 + "." * 500]
    out += ["".join(rng.choice(" \n.,!'sabE<|>étiñ1*") for _ in range(rng.randrange(1, 50))) for _ in range(300)]
    return out + ["same text"] * 3


# Word hashes

def test_words_are_those_of_the_pattern():
    texts = [t or "" for t in odd_texts()]
    for pattern, ends in ((r"[^\x20\x09-\x0D]+", byteblocks.SPACE_ENDED), (r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", byteblocks.ALNUM_ONLY)):
        names = {}
        for limit in (1 << 20, 50):
            at = 0
            for block in byteblocks.blocks(pa.array(texts), limit):
                found = byteblocks.words(block, ends)
                for row in range(block.rows):
                    folded = texts[at].translate({i: i + 32 for i in range(65, 91)})
                    want = re.findall(pattern, folded)
                    got = found.hashes[found.rows[row]: found.rows[row + 1]].tolist()
                    assert len(got) == len(want)
                    for word, value in zip(want, got):
                        assert names.setdefault(word, value) == value
                    at += 1
            assert at == len(texts)
        assert len(set(names.values())) == len(names)


def test_blocks_of_a_sliced_column():
    column = pa.array(["xx", None, "abc", "", "de"]).slice(1)
    got = b"".join(b.data.tobytes() for b in byteblocks.blocks(column, 3))
    assert got == b"abcde"


# Language identification

def brute_bits(texts_by_lang, text, order=3):
    """Code lengths by the definition, context by context."""
    fold_bytes = lambda t: [b + 32 if 65 <= b <= 90 else b for b in t.encode()]
    out = {}
    for lang, texts in texts_by_lang.items():
        trees = defaultdict(Counter)
        for t in texts:
            data = fold_bytes(t)
            for i, b in enumerate(data):
                for k in range(min(i, order) + 1):
                    trees[tuple(data[i - k: i])][b] += 1
        seen = {b for ts in texts_by_lang.values() for t in ts for b in fold_bytes(t)}
        data, bits = fold_bytes(text), 0.0
        for i, b in enumerate(data):
            context = [-1] * max(0, order - i) + data[max(0, i - order): i]
            for k in range(order, -1, -1):
                known = tuple(context[order - k:])
                if any(c not in seen for c in known) or known not in trees:
                    continue
                n, q = sum(trees[known].values()), len(trees[known])
                if b in trees[known]:
                    bits += math.log2((n + q) / trees[known][b])
                    break
                bits += math.log2((n + q) / q)
            else:
                bits += 8.0
        out[lang] = bits
    return out


def test_code_lengths_match_the_trees(spark):
    train = [(1, "the cat sat on the mat", "en"), (2, "Then THE rat", "en"), (3, "der hund und die katze", "de"), (4, "über", "de"), (6, "x", "de")]
    model = language_id.fit(spark.createDataFrame(train, DOCS), F.lit(True))
    by_lang = {"en": [train[0][1], train[1][1]], "de": [t for _, t, lang in train if lang == "de"]}
    texts = ["the hat", "Ünd", "zzz qq!", "die", "a", "katze und cat", "the"]
    for block in byteblocks.blocks(pa.array(texts), 9):
        got = language_id.code_lengths(model, block)
        for row in range(block.rows):
            want = brute_bits(by_lang, texts[block.first + row])
            assert got[row] == pytest.approx([want["de"], want["en"]], rel=1e-5)


@pytest.mark.parametrize("order, dense", [(0, 1 << 24), (1, 1), (2, 1 << 24), (4, 1 << 24), (5, 100)])
def test_code_lengths_of_any_order_and_alphabet(spark, monkeypatch, order, dense):
    """Thirty languages with letters of their own; contexts looked up in tables and by search."""
    monkeypatch.setattr(language_id, "DENSE_CODES", dense)
    rng = random.Random(order)
    letters = ["".join(chr(rng.choice([0x61, 0xE0, 0x410, 0x5D0, 0x4E00]) + rng.randrange(20)) for _ in range(12)) for _ in range(30)]
    text = lambda i, n: "".join(rng.choice(letters[i] + " ") for _ in range(n))
    train = [(i, text(i % 30, 60), f"l{i % 30:02}") for i in range(90)]
    model = language_id.fit(spark.createDataFrame(train, DOCS), F.lit(True), order=order)
    by_lang = defaultdict(list)
    for _, t, lang in train:
        by_lang[lang].append(t)
    texts = [text(i, 25) for i in (0, 7, 29)] + ["", "zzz ~", train[4][1]]
    for block in byteblocks.blocks(pa.array(texts), 64):
        for row, bits in enumerate(language_id.code_lengths(model, block)):
            want = brute_bits(by_lang, texts[block.first + row], order)
            assert bits == pytest.approx([want[lang] for lang in model.languages], rel=1e-5)


def test_all_contexts_stay(spark):
    """More different contexts than 60,000, and none is lost."""
    rng = random.Random(4)
    data = ["".join(chr(0x800 + rng.randrange(50_000)) for _ in range(6000)) for _ in range(20)]
    model = language_id.fit(spark.createDataFrame([(i, t, "zh" if i % 2 else "ja") for i, t in enumerate(data)], DOCS), F.lit(True))
    raw = [t.encode() for t in data]
    for length, level in enumerate(model.levels):
        assert len(level.codes) == len({t[i: i + length] for t in raw for i in range(len(t) - length)})
    assert len(model.levels[3].codes) > 60_000


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs, fold("doc_id", 5) != 0)
    rows = language_id.predict(docs, model).filter(fold("doc_id", 5) == 0).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) > 0
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !?", None), (None, "the cat", "en"), (4, "the cat", None), (4, "the cat", None), (5, "le chat " * 20000, "fr")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("mine"))
    got = {(r.doc_id, r.text): r for r in language_id.predict(docs, language_id.fit(docs, F.lit(True))).collect()}
    assert [got[k].lang_pred for k in ((1, None), (2, ""), (3, "12 !?"), (4, "the cat"))] == ["und", "und", "und", "en"]
    assert got[(1, None)].score == 0.0 and got[(1, None)].bits_per_byte is None
    assert got[(5, "le chat " * 20000)].lang_pred == "fr"
    empty = docs.limit(0)
    assert language_id.fit(empty, F.lit(True)) is None
    assert language_id.predict(empty, None).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}


# Quality

def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    voters = quality_vote.fit(docs, labels, fold("doc_id", 5) != 0)
    rows = quality_vote.score(docs.select("doc_id", "text"), voters).join(labels, "doc_id").filter(fold("doc_id", 5) == 0).collect()
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert sum(r.predicted == 0 for r in bad) >= 0.8 * len(bad) > 0


def test_vote_is_that_of_the_nearest():
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    known, labels = unit(rng.normal(size=(60, 5))).astype(np.float32), (rng.random(60) < 0.6).astype(np.int8)
    voters = quality_vote.Voters(None, None, known, labels, np.array([0.5, 2.0]), 0.6, 7)
    asked = unit(rng.normal(size=(30, 5)))
    got = quality_vote.vote(voters, asked)
    for x, score in zip(asked.astype(np.float32), got):
        cosine = [float(x @ k) for k in known]
        near = sorted(range(60), key=lambda i: -cosine[i])[:7]
        weight = [max(cosine[i], 0) ** 2 * (2.0 if labels[i] else 0.5) for i in near]
        assert score == pytest.approx(sum(w for w, i in zip(weight, near) if labels[i]) / sum(weight), rel=1e-4)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b c d e"), (3, "a b c d e"), (4, "X!! Y!! Z!!"), (None, "a b"), (5, "w " * 60000)], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (3, 1), (4, 0), (2, None), (None, 1), (9, 0)], "doc_id long, quality int")
    voters = quality_vote.fit(docs, labels, F.lit(True))
    rows = quality_vote.score(docs.withColumn("predicted", F.lit("old")), voters).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    by_text = {r.text: r for r in rows}
    assert by_text["a b c d e"].predicted == 1 and by_text["X!! Y!! Z!!"].predicted == 0
    assert by_text[None].score == by_text[""].score == pytest.approx(0.5)
    assert quality_vote.fit(docs, labels.filter("quality = 1"), F.lit(True)) is None
    assert {r.score for r in quality_vote.score(docs, None).collect()} == {1.0}
    assert quality_vote.score(docs.limit(0), voters).count() == 0


# Token counts

@pytest.mark.parametrize("chunk,overlap", [(49152, 512), (2000, 64), (40, 4)])
def test_token_counts_are_those_of_the_library(spark, chunk, overlap):
    texts = odd_texts() + [t for (t,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("old"))
    library = tokenizers.Tokenizer.from_file(WORD_BPE)
    for row in token_counts.token_counts(docs, WORD_BPE, limit=20, chunk=chunk, overlap=overlap).collect():
        text = texts[row.doc_id] or ""
        want = len(library.encode(text, add_special_tokens=False))
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), want, want > 20), text[:80]


def test_spliced_ids_are_those_of_the_library(spark):
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcé1.") for _ in range(rng.randrange(1, 30))) for _ in range(3000)) + "x" * 5000 + " end"
    ids = token_counts.load(WORD_BPE).encode_huge(text, 700, 8).tolist()
    assert ids == tokenizers.Tokenizer.from_file(WORD_BPE).encode(text, add_special_tokens=False).ids
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert token_counts.token_ids(docs, WORD_BPE, chunk=700, overlap=8).first().token_ids == ids


SPACELESS = {
    "chinese": list("的一是不了人我在有他，。！"), "kana": list("かがはバ゙。ッ、"), "base64": list("ABCXYZabcxyz0189+/="), "one word": list("abcdefgh"),
    "special": ["a", "<|endoftext|>", "1", "'s", "'", "t2", "<", "<|", "endoftext", "|>", "é", "e\u0301", "Σ."],
}


@pytest.mark.parametrize("kind", SPACELESS)
@pytest.mark.parametrize("chunk,overlap", [(49152, 512), (64, 4)])
def test_texts_without_white_space(kind, chunk, overlap):
    tokenizer, library, rng = token_counts.load(WORD_BPE), tokenizers.Tokenizer.from_file(WORD_BPE), random.Random(11)
    for size in (60_000, 130_000) if chunk > 1000 else (100, 300, 1500):
        text = "".join(rng.choices(SPACELESS[kind], k=size))
        assert tokenizer.encode_huge(text, chunk, overlap).tolist() == library.encode(text, add_special_tokens=False).ids


def test_chunks_without_a_boundary_are_encoded_a_few_times_only(monkeypatch):
    tokenizer, text, read = token_counts.load(WORD_BPE), "abcdefgh" * 40_000, []
    encode = tokenizer.encode
    monkeypatch.setattr(tokenizer, "encode", lambda part: read.append(len(part)) or encode(part))
    tokenizer.encode_huge(text, 1000, 50)
    assert sum(read) < 3 * len(text)


def test_token_counts_edges(spark):
    long = "word, wörd; " * 9000 + "的一。" * 20_000
    rows = [(1, None), (1, None), (None, "a b"), (2, ""), (3, long), (3, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("over_limit", F.lit("old"))
    n = len(tokenizers.Tokenizer.from_file(WORD_BPE).encode(long, add_special_tokens=False))
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, WORD_BPE).collect())
    assert got == [(0, 3, 2, False), (1, 0, 0, False), (1, 0, 0, False), (2, 0, 0, False), *[(3, len(long.encode()), n, True)] * 2]
    assert token_counts.token_counts(docs.limit(0), WORD_BPE).count() == 0


def test_token_counts_refuse_other_tokenizers():
    with pytest.raises(ValueError):
        token_counts.StableTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


# Pieces

def test_pieces_of_a_long_text_without_spaces(spark):
    text = "".join(random.Random(3).choices("etaoinshrdlu", k=100_000))
    row = piece_codec.encoded_digests(spark.createDataFrame([(None, text)], "doc_id long, text string"), PIECE_BPE).first()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    ids = library.encode(text, add_bos=True, add_eos=True)
    assert row.doc_id is None and row.n_tokens == len(ids)
    assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_pieces_are_those_of_the_library(spark):
    texts = odd_texts() + [t for (t,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids_sha256", F.lit("old"))
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    for row in piece_codec.encoded_digests(docs, PIECE_BPE, with_ids=True).collect():
        ids = library.encode(texts[row.doc_id] or "", add_bos=True, add_eos=True)
        assert row.token_ids == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert piece_codec.encoded_digests(docs.limit(0), PIECE_BPE).count() == 0


def test_round_trip(spark):
    texts = [t for t in odd_texts() if t and "▁" not in t]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    back = piece_codec.decoded(piece_codec.encoded(docs, PIECE_BPE), PIECE_BPE).collect()
    assert all(r.decoded_text == r.text for r in back)
    nothing = spark.createDataFrame([(1, None)], "doc_id long, token_ids array<int>")
    assert piece_codec.decoded(nothing, PIECE_BPE).first().decoded_text is None


def test_decoding_of_any_ids():
    library, model = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE), piece_codec.load(PIECE_BPE)
    rng = random.Random(2)
    for _ in range(2000):
        ids = [rng.choice([0, 1, 2, 5, 35, 198, 172, 243, 162, 156, 133, 259, 260, 300, 29871]) for _ in range(rng.randrange(9))]
        assert piece_codec.decode_ids(model, ids).decode() == library.decode(ids)


def test_memory_of_segments_may_start_afresh(monkeypatch):
    monkeypatch.setattr(piece_codec, "MEMO", 5)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    texts = ["one two three four", "five six seven eight nine", "one nine"]
    encoder = piece_codec.Encoder(piece_codec.load(PIECE_BPE))
    for text in texts:
        (ids, _), = encoder.encode(pa.array([text]))
        assert ids.tolist() == library.encode(text)
