"""Rule-based match prediction over a table of fixtures.

Both teams' table rows are looked up through a size-checked join; everything
else is arithmetic on one row, so scoring adds no shuffle to the fixtures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.labels import score_text
from touchline.runtime import Lookup
from touchline.schema import HALF_TIME_GOALS, MATCH_STATS

# The table row taken for each side unless both teams are known.
DEFAULT_HOME = {"Points": 60, "Wins": 15, "Draws": 8, "Losses": 15, "GoalsFor": 45.0, "GoalsAgainst": 40.0}
DEFAULT_AWAY = {"Points": 55, "Wins": 14, "Draws": 7, "Losses": 17, "GoalsFor": 42.0, "GoalsAgainst": 45.0}
# Weight of shots, shots on target, corners and half-time goals.
MATCH_WEIGHTS = (0.1, 0.2, 0.05, 0.3)
GOAL_DIFFERENCE_WEIGHT = 0.1
HOME_ADVANTAGE = 5
HALF_TIME_SWING = 10
# Result and its H/D/A probabilities per band of the strength difference.
BANDS = {
    "clear home": ("H", 0.65, 0.20, 0.15),
    "clear away": ("A", 0.20, 0.25, 0.55),
    "level": ("D", 0.35, 0.35, 0.30),
    "home": ("H", 0.50, 0.30, 0.20),
    "away": ("A", 0.25, 0.30, 0.45),
}

TEAM_COLUMNS = tuple(DEFAULT_HOME)


def request_defaults(fixtures: DataFrame) -> DataFrame:
    """A missing number counts as 0, a missing half-time result as a draw."""
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in MATCH_STATS + HALF_TIME_GOALS}
    return fixtures.withColumns(filled | {"HTR": F.coalesce("HTR", F.lit("D"))})


def with_team_rows(fixtures: DataFrame, stats: Lookup) -> DataFrame:
    """Adds ``home_<stat>`` and ``away_<stat>``; both fall back unless both teams are known."""
    for side, team in (("home", "HomeTeam"), ("away", "AwayTeam")):
        fixtures = stats.join(fixtures, {team: "Team"}, {c: f"{side}_{c}" for c in TEAM_COLUMNS})
    known = F.col("home_Points").isNotNull() & F.col("away_Points").isNotNull()
    fixtures = fixtures.withColumn("both_known", known)
    fallback = {
        f"{side}_{c}": F.when(F.col("both_known"), F.col(f"{side}_{c}")).otherwise(F.lit(row[c]))
        for side, row in (("home", DEFAULT_HOME), ("away", DEFAULT_AWAY)) for c in TEAM_COLUMNS
    }
    return fixtures.withColumns(fallback)


def _team_strength(side: str, fallback: dict) -> Column:
    difference = F.col(f"{side}_GoalsFor") - F.col(f"{side}_GoalsAgainst")
    formula = F.col(f"{side}_Points") + difference * GOAL_DIFFERENCE_WEIGHT
    # An unknown pairing is rated by its default points alone.
    return F.when(F.col("both_known"), formula).otherwise(F.lit(float(fallback["Points"])))


def _match_strength(shots: str, target: str, corners: str, goals: str) -> Column:
    a, b, c, d = MATCH_WEIGHTS
    return F.col(shots) * a + F.col(target) * b + F.col(corners) * c + F.col(goals) * d


def _band_row(name: str) -> Column:
    code, home, draw, away = BANDS[name]
    return F.struct(
        F.lit(code).alias("prediction"), F.lit(home).alias("prob_H"),
        F.lit(draw).alias("prob_D"), F.lit(away).alias("prob_A"),
    )


def band(difference: Column) -> Column:
    """The band a strength difference falls into; tests apply in this order."""
    return (
        F.when(difference > 15, _band_row("clear home"))
        .when(difference < -10, _band_row("clear away"))
        .when(F.abs(difference) <= 5, _band_row("level"))
        .when(difference > 0, _band_row("home"))
        .otherwise(_band_row("away"))
    )


def predicted_goals(half_time: Column, strength: Column) -> Column:
    return F.greatest(F.bround(half_time + strength / 10), F.lit(0.0)).cast("bigint")


def rate_fixtures(fixtures: DataFrame, stats: Lookup) -> DataFrame:
    """Every fixture column plus team rows, strengths and the prediction."""
    rows = with_team_rows(request_defaults(fixtures), stats)
    swing = F.when(F.col("HTR") == "H", HALF_TIME_SWING).when(F.col("HTR") == "A", -HALF_TIME_SWING).otherwise(0)
    rows = rows.withColumns({
        "home_match": _match_strength("HS", "HST", "HC", "HTHG"),
        "away_match": _match_strength("AS", "AST", "AC", "HTAG"),
    })
    home = _team_strength("home", DEFAULT_HOME) + F.col("home_match") + HOME_ADVANTAGE + swing
    away = _team_strength("away", DEFAULT_AWAY) + F.col("away_match")
    rows = rows.withColumn("strength_difference", home - away)
    rows = rows.withColumn("band", band(F.col("strength_difference")))
    return rows.withColumns({
        "prediction": F.col("band.prediction"),
        "prob_H": F.col("band.prob_H"), "prob_D": F.col("band.prob_D"), "prob_A": F.col("band.prob_A"),
        "home_goals": predicted_goals(F.col("HTHG"), F.col("home_match")),
        "away_goals": predicted_goals(F.col("HTAG"), F.col("away_match")),
    }).withColumns({
        "confidence": F.bround(F.greatest("prob_H", "prob_D", "prob_A") * 100, 1),
        "predicted_score": score_text(F.col("home_goals"), F.col("away_goals")),
    }).drop("band")


SCORE_COLUMNS = ("prediction", "confidence", "prob_H", "prob_D", "prob_A", "predicted_score")


def score_fixtures(fixtures: DataFrame, stats: Lookup, key: str = "match_id") -> DataFrame:
    return rate_fixtures(fixtures, stats).select(key, *SCORE_COLUMNS)


def likeliest(probabilities: dict[str, Column]) -> Column:
    """Class with the greatest probability; on ties the one listed first wins."""
    top = F.greatest(*probabilities.values())
    choice = F.lit(None).cast("string")
    for code, value in reversed(probabilities.items()):
        choice = F.when(value == top, F.lit(code)).otherwise(choice)
    return choice


def accuracy_summary(results: DataFrame, stats: Lookup) -> DataFrame:
    """How often the half-time result held, and how often the prediction was right."""
    rows = rate_fixtures(results, stats)
    right = F.count_if(F.col("prediction") == F.col("FTR"))
    total = F.count(F.lit(1))
    return rows.agg(
        F.try_divide(F.count_if(F.col("HTR") == F.col("FTR")) * 100.0, total).alias("half_time_accuracy"),
        F.try_divide(right * 100.0, total).alias("full_time_accuracy"),
        total.alias("total_predictions"), right.alias("correct_predictions"),
    )


