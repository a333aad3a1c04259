"""From raw documents to encoded training texts, one operator a stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet and reads it again as the next stage's docs.  All stages but the
last return the columns of documents; columns beside them pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import decontaminate, jaccard_join, language_id, piece_codec, quality_vote
from touchline.llm.shared import fold, packed, ship_package, small_batches, table, unpacked
from touchline.runtime import scratch_path

#: A document goes if its bytes take more than so many times the bits of its language's training texts.
MOST_BITS = 4.0


def prepare(spark: SparkSession) -> None:
    """Executors get this library, and Python workers few texts at once: one executor's workers serve all stages."""
    ship_package(spark)
    small_batches(spark)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from these documents.

    Those without a letter go, and those that even the likeliest language finds
    far stranger than its own texts: noise, and languages that were not learned.
    The measure is per byte, so long texts are not surer of a place than short
    ones.  Where no document has a language to learn from, all documents with a
    letter stay.
    """
    prepare(spark)
    learn = fold("doc_id", 5) != 0
    model = language_id.fit(docs, learn)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    bars = language_id.own_bits(docs, model, learn)
    judged = language_id.predict(packed(docs, "text"), model)
    bar = F.lit(None).cast("double")
    for lang, bits in bars.items():
        bar = F.when(F.col("lang_pred") == lang, MOST_BITS * bits).otherwise(bar)
    strange = F.coalesce(F.col("bits_per_byte") > bar, F.lit(False))
    kept = judged.filter((F.col("lang_pred") != language_id.UNDETERMINED) & ~strange)
    return unpacked(kept, docs.columns, "text")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the vote of labelled ones does not put at low quality; all, where a class has no labels."""
    prepare(spark)
    voters = quality_vote.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    kept = quality_vote.score(packed(docs, "text"), voters).filter("predicted = 1")
    return unpacked(kept, docs.columns, "text")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies."""
    prepare(spark)
    return jaccard_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; texts that are mostly such passages go."""
    prepare(spark)
    clean = decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and n_chars with the ids of each text, their number, and digests of ids and decoded text."""
    prepare(spark)
    found = piece_codec.encoded_digests(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)
    kept = [c for c in ("doc_id", "lang", "source", "n_chars") if c in found.columns]
    return found.select(*kept, "n_tokens", "ids_sha256", "decoded_sha256", "token_ids")


STAGES = [
    ("language_id", known_language),
    ("quality_vote", good_quality),
    ("jaccard_join", one_of_near_copies),
    ("decontaminate", without_benchmark),
    ("piece_codec", encoded),
]

#: Byte contexts, neighbour votes and merge rounds have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
