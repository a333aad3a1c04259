"""Registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import functions as F

from touchline.llm import (
    decontaminate, jaccard_join, kneser_ney, language_id, line_dedup, periodic_runs, piece_codec, quality_vote, sharding, token_counts, url_trust,
    vector_dedup, whitening,
)
from touchline.llm.oracles import BY_QUERY
from touchline.llm.shared import fold, ship_package, table
from touchline.plans.registry import Registry

REGISTRY = Registry()


def _registered(build):
    """Registers a query that first sends this package to the executors."""
    @wraps(build)
    def run(spark, sf_dir):
        ship_package(spark)
        return build(spark, sf_dir)
    return REGISTRY.query(BY_QUERY.get(build.__name__))(run)


@_registered
def op9_jaccard_classes(spark, sf_dir):
    return jaccard_join.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_registered
def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = fold("doc_id", 5)
    model = language_id.fit(docs, remainder != 0)
    held_out = docs.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "text")
    return language_id.predict(held_out, model, keep_text=False)


@_registered
def op1_vector_dedup(spark, sf_dir):
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@_registered
def op2_quality_vote(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    voters = quality_vote.fit(docs, labels, fold("doc_id", 5) != 0)
    held_out = docs.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text")
    return quality_vote.score(held_out, voters, keep_text=False)


@_registered
def op3_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))


#: The rules of the query.
PAGE_RULES = [
    url_trust.Rule("net", "/", "block"),
    url_trust.Rule("example.net", "/en/", "allow"),
    url_trust.Rule("example.com", "/de/", "block"),
    url_trust.Rule("org", "/fr/", "allow"),
]


@_registered
def op4_url_trust(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return url_trust.judged(pages, PAGE_RULES).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


@_registered
def op5_kneser_ney(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = fold("doc_id", 7)
    model = kneser_ney.train(docs, remainder != 2, order=3)
    held_out = docs.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "text")
    scored = kneser_ney.score(held_out, model, keep_text=False)
    train_tokens = F.lit(model.tokens if model else 0).cast("long")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", train_tokens.alias("train_tokens"), "base_score", "score", "perplexity")


@_registered
def op6_benchmark_passages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.words_hit()
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@_registered
def op7_piece_codec(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_codec.encoded_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


@_registered
def op8_minimax_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign_shards(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_registered
def op11_embedding_whitening(spark, sf_dir):
    return whitening.by_component(whitening.whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def with_planted_periods(docs):
    """Every tenth document by crc32 of its id, from some word on, repeats a number of words given by the same crc32."""
    digest = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.withColumn("g", F.floor(digest / 10)).withColumn("words", F.when(digest % 10 == 0, words))
    n = F.size("words")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    place = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    planted = F.array_join(F.transform(place, lambda i: F.get("words", i)), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


@_registered
def op12_periodic_runs(spark, sf_dir):
    docs = with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.with_runs(docs).withColumn("best", periodic_runs.longest(F.col("runs")))
    length, period = F.col("best.length"), F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(periodic_runs.listed(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@_registered
def op13_line_dedup(spark, sf_dir):
    kept = line_dedup.without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES, ORACLES = REGISTRY.queries, REGISTRY.oracles
