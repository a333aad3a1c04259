"""Column lists and row types shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# The match table's columns, in the order files list them.
MATCH_COLUMNS = (
    "Date", "HomeTeam", "AwayTeam",
    "HTHG", "HTAG", "HTR",
    "FTHG", "FTAG", "FTR",
    "HS", "AS", "HST", "AST", "HC", "AC",
    "HF", "AF", "HY", "AY", "HR", "AR",
)

# The numeric match measures.
MEASURES = (
    "HTHG", "HTAG", "FTHG", "FTAG", "HS", "AS", "HST", "AST",
    "HC", "AC", "HF", "AF", "HY", "AY", "HR", "AR",
)

# The twelve in-match statistics a prediction request carries.
MATCH_STATS = (
    "HS", "AS", "HST", "AST", "HC", "AC",
    "HF", "AF", "HY", "AY", "HR", "AR",
)

HALF_TIME_GOALS = ("HTHG", "HTAG")

# Engineered columns of the widest model, in feature order.
ENGINEERED = (
    "TotalShots", "ShotDifference", "ShotsOnTargetRatio",
    "HomeShotAccuracy", "AwayShotAccuracy", "ShotAccuracyDiff",
    "TotalCorners", "CornerDifference", "TotalFouls", "FoulDifference",
    "TotalCards", "HomeCards", "AwayCards", "CardDifference",
    "HTGoalDifference", "HTTotalGoals", "HTR_encoded",
    "Month", "DayOfWeek", "IsWeekend",
)

STATS_FEATURES = MATCH_STATS
HALF_TIME_FEATURES = MATCH_STATS + HALF_TIME_GOALS + ("HTR_encoded",)
FULL_FEATURES = MATCH_STATS + HALF_TIME_GOALS + ENGINEERED

# Per-team inputs of the points model.
TEAM_FEATURES = (
    "AvgGoalsFor", "AvgGoalsAgainst", "AvgShotsFor", "AvgShotsAgainst",
    "AvgSOTFor", "AvgSOTAgainst", "AvgYellowCards", "AvgRedCards",
    "AvgFouls", "AvgCornersFor", "AvgCornersAgainst", "WinRate",
)

# Result codes in sorted order, which is also their class index.
RESULT_CODES = ("A", "D", "H")

# What each request column means.
FEATURE_DESCRIPTIONS = {
    "HS": "Home Team Shots",
    "AS": "Away Team Shots",
    "HST": "Home Shots on Target",
    "AST": "Away Shots on Target",
    "HC": "Home Team Corners",
    "AC": "Away Team Corners",
    "HF": "Home Team Fouls",
    "AF": "Away Team Fouls",
    "HY": "Home Yellow Cards",
    "AY": "Away Yellow Cards",
    "HR": "Home Red Cards",
    "AR": "Away Red Cards",
    "HTHG": "Half Time Home Goals",
    "HTAG": "Half Time Away Goals",
    "HTR": "Half Time Result (H/D/A)",
}

RAW_MATCH_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in MATCH_COLUMNS])


def _match_type(column: str) -> T.DataType:
    if column == "Date":
        return T.DateType()
    return T.DoubleType() if column in MEASURES else T.StringType()


MATCH_SCHEMA = T.StructType([T.StructField(c, _match_type(c)) for c in MATCH_COLUMNS])

TEAM_STATS_SCHEMA = T.StructType(
    [T.StructField("Team", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("Matches", "Wins", "Draws", "Losses")]
    + [T.StructField(c, T.DoubleType()) for c in ("GoalsFor", "GoalsAgainst", "GoalDifference")]
    + [T.StructField("Points", T.LongType()), T.StructField("WinPercentage", T.DoubleType())]
)
TEAM_STATS_COLUMNS = tuple(TEAM_STATS_SCHEMA.names)
