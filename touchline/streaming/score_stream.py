"""Scores match rows as their files arrive.

Each row is scored on its own, so the stream keeps no state and needs no
watermark.  The league table is fixed when the query starts; ``live_table`` has
one that grows with the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from touchline.operators.scoring import score_fixtures
from touchline.runtime import Lookup


def fixture_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def start_scoring(fixtures: DataFrame, stats: Lookup, output: str, checkpoint: str, key: str = "match_id") -> StreamingQuery:
    """Scores what is there now and stops; the file sink writes every row exactly once."""
    return (
        score_fixtures(fixtures, stats, key)
        .writeStream.format("parquet").outputMode("append")
        .option("path", output).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
