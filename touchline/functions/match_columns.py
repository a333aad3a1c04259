"""Derived match columns; one builder serves training and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.schema import FULL_FEATURES, HALF_TIME_GOALS, MATCH_STATS, RESULT_CODES

# What scoring assumes when a request has no date (September, Saturday).
DEFAULT_MONTH = 9
DEFAULT_DAY_OF_WEEK = 5


def result_index(code: Column) -> Column:
    """Index of a result code among the sorted codes; missing or unknown counts as a draw."""
    known = F.when(code == RESULT_CODES[0], 0.0).when(code == RESULT_CODES[2], 2.0)
    return known.otherwise(1.0)


def with_match_features(matches: DataFrame) -> DataFrame:
    """Adds the nine analysis columns of the feature table."""
    c = F.col
    return matches.withColumns({
        "TotalGoals": c("FTHG") + c("FTAG"),
        "Season": F.year("Date"),
        "Month": F.month("Date"),
        "GoalDifference": c("FTHG") - c("FTAG"),
        "HTGoalDifference": c("HTHG") - c("HTAG"),
        "HomeShotEfficiency": F.try_divide(c("FTHG"), c("HS") + 1),
        "AwayShotEfficiency": F.try_divide(c("FTAG"), c("AS") + 1),
        "HomeSOTRatio": F.try_divide(c("HST"), c("HS") + 1),
        "AwaySOTRatio": F.try_divide(c("AST"), c("AS") + 1),
    })


def with_full_features(matches: DataFrame, mode: str = "train") -> DataFrame:
    """Keeps every input column and adds the 34 model features.

    ``train`` fills what is missing with 0; ``score`` takes a missing date as a
    September Saturday.  The arithmetic is the same in both.
    """
    if mode not in ("train", "score"):
        raise ValueError(f"mode must be 'train' or 'score', not {mode!r}")
    inputs = {name: F.coalesce(F.col(name).cast("double"), F.lit(0.0)) for name in MATCH_STATS + HALF_TIME_GOALS}
    c = F.col
    ratios = {
        "TotalShots": c("HS") + c("AS"),
        "ShotDifference": c("HS") - c("AS"),
        "ShotsOnTargetRatio": F.coalesce(F.try_divide(c("HST") + c("AST"), c("HS") + c("AS") + 1), F.lit(0.0)),
        "HomeShotAccuracy": F.coalesce(F.try_divide(c("HST"), c("HS") + 1), F.lit(0.0)),
        "AwayShotAccuracy": F.coalesce(F.try_divide(c("AST"), c("AS") + 1), F.lit(0.0)),
        "TotalCorners": c("HC") + c("AC"),
        "CornerDifference": c("HC") - c("AC"),
        "TotalFouls": c("HF") + c("AF"),
        "FoulDifference": c("HF") - c("AF"),
        "HomeCards": c("HY") + c("HR"),
        "AwayCards": c("AY") + c("AR"),
        "HTGoalDifference": c("HTHG") - c("HTAG"),
        "HTTotalGoals": c("HTHG") + c("HTAG"),
        "HTR_encoded": result_index(c("HTR")),
    }
    combined = {
        "ShotAccuracyDiff": c("HomeShotAccuracy") - c("AwayShotAccuracy"),
        "TotalCards": c("HomeCards") + c("AwayCards"),
        "CardDifference": c("HomeCards") - c("AwayCards"),
    }
    month, day = (0, 0) if mode == "train" else (DEFAULT_MONTH, DEFAULT_DAY_OF_WEEK)
    # A missing day is no weekend in training, and a Saturday in scoring.
    calendar = {
        "Month": F.coalesce(F.month("Date"), F.lit(month)).cast("double"),
        "DayOfWeek": F.coalesce(F.weekday("Date"), F.lit(day)).cast("double"),
        "IsWeekend": (F.coalesce(F.weekday("Date"), F.lit(day)) >= 5).cast("double"),
    }
    return matches.withColumns(inputs).withColumns(ratios | calendar).withColumns(combined)


def feature_vectors(matches: DataFrame, mode: str, *keep: str) -> DataFrame:
    """``keep`` columns plus exactly the 34 features, in feature order."""
    return with_full_features(matches, mode).select(*keep, *FULL_FEATURES)
