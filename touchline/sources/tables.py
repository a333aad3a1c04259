"""Persisted tables: matches, features, team stats, scores, predictions, run metadata.

Parquet is the default so that later reads can prune columns, skip seasons and
push filters down.  Outputs never go to the folder the season files are read from.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.schema import TEAM_STATS_SCHEMA


def write_table(df: DataFrame, path: str, format: str = "parquet") -> str:
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if format == "csv" else writer).format(format).save(path)
    return path


def write_features(features: DataFrame, path: str) -> str:
    """One folder per season; the hint spreads a large season over several files and merges small ones."""
    balanced = features.hint("rebalance", F.col("Season"))
    balanced.write.mode("overwrite").partitionBy("Season").parquet(path)
    return path


def read_table(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """The table at ``path``, or at ``fallback`` where the first does not exist."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if fallback is None or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.read.parquet(fallback)


def read_team_stats(spark: SparkSession, path: str) -> DataFrame:
    """The league table at ``path``, or an empty one with the same columns."""
    try:
        return spark.read.schema(TEAM_STATS_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], TEAM_STATS_SCHEMA)


def export_predictions(predictions: DataFrame, folder: str, name: str | None = None) -> str:
    """CSV with a header under a time-stamped name unless one is given."""
    name = name or f"predictions_{datetime.now():%Y%m%d_%H%M%S}"
    return write_table(predictions, f"{folder.rstrip('/')}/{name}", "csv")


def run_metadata(df: DataFrame, team_count: DataFrame, model_type: str, features: tuple[str, ...], classes: tuple[str, ...]) -> DataFrame:
    """One row describing a training run: model, inputs, classes and data size."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(model_type).alias("model_type"),
        F.array(*[F.lit(f) for f in features]).alias("features"),
        F.array(*[F.lit(c) for c in classes]).alias("classes"),
        "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"),
        team_count.agg(F.count(F.lit(1)).alias("n")).scalar().alias("team_count"),
    )
