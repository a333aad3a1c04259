"""JSON envelopes for predictions, pruned records, and rejected requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.labels import form_record_text, half_time_label, result_label, score_text
from touchline.functions.parsing import blank_to_null
from touchline.functions.validation import (
    FIELD_LIMITS, no_errors, range_errors, stat_errors, team_errors, with_numbers, without_numbers,
)
from touchline.operators.scoring import TEAM_COLUMNS, rate_fixtures
from touchline.runtime import Lookup


def json_ready(column: Column, kind: T.DataType, blanks_to_null: bool = False) -> Column:
    """The value with what JSON cannot carry (NaN, infinities) as null, at any depth."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)
    if isinstance(kind, T.StringType):
        return F.nullif(column, F.lit("")) if blanks_to_null else column
    if isinstance(kind, T.StructType):
        fields = [json_ready(column[f.name], f.dataType, blanks_to_null).alias(f.name) for f in kind]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        # Blank list elements stay; only fields are pruned.
        inner = blanks_to_null and not isinstance(kind.elementType, T.StringType)
        return F.transform(column, lambda x: json_ready(x, kind.elementType, inner))
    if isinstance(kind, T.MapType):
        values = F.transform_values(column, lambda _, v: json_ready(v, kind.valueType, blanks_to_null))
        return F.map_filter(values, lambda _, v: v.isNotNull()) if blanks_to_null else values
    return column


def _record(df: DataFrame, columns: list[str], blanks_to_null: bool = False) -> Column:
    return F.struct(*[json_ready(F.col(c), df.schema[c].dataType, blanks_to_null).alias(c) for c in columns])


def pruned_json(df: DataFrame, key: str) -> DataFrame:
    """Each row as JSON without its null and empty-text fields."""
    columns = [c for c in df.columns if c != key]
    return df.select(key, F.to_json(_record(df, columns, True)).alias("json"))


def _probabilities() -> Column:
    return F.struct(*[F.round(F.col(f"prob_{c}"), 3).alias(c) for c in "HDA"])


def prediction_envelope(
    scored: DataFrame, key: str, timestamp: str, inputs: tuple[str, ...] = (), metadata: dict[str, str] | None = None
) -> DataFrame:
    """Success envelope per scored row; ``timestamp`` is given so that reruns agree."""
    parts = [
        F.lit(True).alias("success"), F.col("prediction"), _probabilities().alias("probabilities"),
        F.lit(timestamp).alias("timestamp"),
    ]
    if inputs:
        parts.append(_record(scored, list(inputs)).alias("input_data"))
    if metadata:
        parts.append(F.struct(*[F.lit(v).alias(k) for k, v in metadata.items()]).alias("metadata"))
    return scored.select(key, F.to_json(F.struct(*parts)).alias("json"))


def prediction_responses(fixtures: DataFrame, stats: Lookup, key: str = "match_id") -> DataFrame:
    """The nested answer to each prediction request, as one JSON text."""
    rows = rate_fixtures(fixtures, stats)

    def whole(name: str) -> Column:
        return F.col(name).cast("bigint")

    def team(side: str) -> Column:
        return F.struct(*[F.col(f"{side}_{c}").alias(c) for c in TEAM_COLUMNS])

    analysis = F.struct(
        whole("HS").alias("home_shots"), whole("AS").alias("away_shots"),
        whole("HST").alias("home_shots_target"), whole("AST").alias("away_shots_target"),
        score_text(F.col("HTHG"), F.col("HTAG")).alias("halftime_score"),
        F.col("HTR").alias("halftime_result"),
    )
    answer = F.struct(
        F.lit(True).alias("success"), "prediction", "confidence", _probabilities().alias("probabilities"),
        "predicted_score", F.col("HomeTeam").alias("home_team"), F.col("AwayTeam").alias("away_team"),
        F.struct(team("home").alias("home"), team("away").alias("away")).alias("team_stats"),
        analysis.alias("match_analysis"),
    )
    return rows.select(key, F.to_json(answer).alias("json"))


_TEAM_DDL = "Points bigint, Wins bigint, Draws bigint, Losses bigint, GoalsFor double, GoalsAgainst double"
RESPONSE_DDL = (
    "success boolean, prediction string, confidence double, probabilities struct<H: double, D: double, A: double>, "
    "predicted_score string, home_team string, away_team string, "
    f"team_stats struct<home: struct<{_TEAM_DDL}>, away: struct<{_TEAM_DDL}>>, "
    "match_analysis struct<home_shots: bigint, away_shots: bigint, home_shots_target: bigint, "
    "away_shots_target: bigint, halftime_score: string, halftime_result: string>"
)


def result_cards(responses: DataFrame, key: str = "match_id") -> DataFrame:
    """Responses read back into the lines a result page shows."""
    r = responses.select(key, F.from_json("json", RESPONSE_DDL).alias("r")).select(key, "r.*")

    def form(side: str) -> Column:
        return form_record_text(*[F.col(f"team_stats.{side}.{c}") for c in ("Wins", "Draws", "Losses")])

    return r.select(
        key, "success", F.concat("home_team", F.lit(" vs "), "away_team").alias("title"),
        result_label(F.col("prediction")).alias("outcome"), "confidence", "predicted_score",
        F.col("probabilities.H").alias("prob_H"), F.col("probabilities.D").alias("prob_D"), F.col("probabilities.A").alias("prob_A"),
        F.col("team_stats.home.Points").alias("home_points"), F.col("team_stats.away.Points").alias("away_points"),
        form("home").alias("home_form"), form("away").alias("away_form"),
        F.concat_ws(" - ", "match_analysis.home_shots", "match_analysis.away_shots").alias("total_shots"),
        F.concat_ws(" - ", "match_analysis.home_shots_target", "match_analysis.away_shots_target").alias("on_target"),
        F.col("match_analysis.halftime_score").alias("halftime_score"),
        half_time_label(F.col("match_analysis.halftime_result")).alias("halftime_label"),
    )


# Error codes of rejected requests, in the order they are tested.
MISSING_TEAM, INVALID_STATS, OUT_OF_RANGE = "MISSING_TEAM", "INVALID_STATS", "OUT_OF_RANGE"


def checked_requests(requests: DataFrame) -> DataFrame:
    """Requests with blank teams as null plus ``errors`` and ``error_code`` (null when fine)."""
    teams, stats, ranges = F.col("team_errors"), F.col("stat_errors"), F.col("range_errors")
    code = (
        F.when(F.size(teams) > 0, MISSING_TEAM)
        .when(F.size(stats) > 0, INVALID_STATS)
        .when(F.size(ranges) > 0, OUT_OF_RANGE)
    )
    named = requests.withColumns({c: blank_to_null(F.col(c)) for c in ("HomeTeam", "AwayTeam")})
    checked = (
        with_numbers(named)
        .withColumns({"team_errors": team_errors(), "stat_errors": stat_errors(), "range_errors": range_errors()})
        .withColumns({"errors": F.concat(teams, stats, ranges), "error_code": code})
        .drop("team_errors", "stat_errors", "range_errors")
    )
    return without_numbers(checked)


def accepted(requests: DataFrame) -> DataFrame:
    """Requests without any error, their fields as numbers."""
    numbers = with_numbers(requests.withColumns({c: blank_to_null(F.col(c)) for c in ("HomeTeam", "AwayTeam")}))
    fine = numbers.where(no_errors())
    return without_numbers(fine.withColumns({c: F.col(f"__{c}") for c in FIELD_LIMITS}))


def rejects(requests: DataFrame, key: str = "match_id") -> DataFrame:
    """Every refused request with all its messages."""
    bad = checked_requests(requests).where(F.col("error_code").isNotNull())
    return bad.select(key, "errors", "error_code")


def error_envelopes(rejected: DataFrame, key: str, timestamp: str) -> DataFrame:
    """Failure envelope per rejected row."""
    envelope = F.struct(
        F.lit(False).alias("success"), F.try_element_at("errors", F.lit(1)).alias("error"),
        F.lit(timestamp).alias("timestamp"), F.col("error_code"), F.col("errors").alias("details"),
    )
    return rejected.select(key, F.to_json(envelope).alias("json"))
