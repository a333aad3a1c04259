"""Aggregates behind the charts and headline numbers.

Everything here is one pass over the matches: either a global aggregate, whose
partial sums are one row per task, or a group-by on a handful of values.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.labels import percent_text, result_label
from touchline.schema import MATCH_COLUMNS, MEASURES


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole)


def _mean(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def outcome_distribution(matches: DataFrame) -> DataFrame:
    """Count and percent of every result code.

    The total is a window over the aggregated rows, one per result code.
    """
    counts = matches.groupBy("FTR").agg(F.count(F.lit(1)).alias("matches"))
    percent = _share(F.col("matches"), F.sum("matches").over(Window.partitionBy()))
    return counts.select(
        "FTR", result_label(F.col("FTR")).alias("outcome"), "matches",
        percent.alias("percent"), percent_text(percent).alias("percent_text"),
    )


def top_scoring(matches: DataFrame, team: str, goals: str, n: int = 10) -> DataFrame:
    """Teams with the highest mean of one goal column."""
    means = matches.groupBy(F.col(team).alias("Team")).agg(F.avg(goals).alias("avg_goals"))
    return means.orderBy(F.desc("avg_goals"), "Team").limit(n)


def histogram(matches: DataFrame, values: dict[str, Column], bins: int) -> DataFrame:
    """Unit-width bins from 0; the last one also holds its right edge, the rest is dropped.

    Bins without rows stay in the result with 0.
    """
    counters, shown = [], []
    for series, value in values.items():
        for left in range(bins):
            inside = (value >= left) & ((value <= left + 1) if left == bins - 1 else (value < left + 1))
            name = f"{series}_{left}"
            counters.append(F.count_if(inside).alias(name))
            shown.append(F.struct(F.lit(series).alias("series"), F.lit(left).alias("bin"), F.col(name).alias("n")))
    return matches.agg(*counters).select(F.inline(F.array(*shown)))


def goals_histogram(matches: DataFrame) -> DataFrame:
    return histogram(matches, {"FTHG": F.col("FTHG"), "FTAG": F.col("FTAG")}, 7)


def total_goals_histogram(matches: DataFrame) -> DataFrame:
    return histogram(matches, {"TotalGoals": F.col("FTHG") + F.col("FTAG")}, 11)


def avg_cards(matches: DataFrame) -> DataFrame:
    return matches.agg(*[F.avg(c).alias(c) for c in ("HY", "AY", "HR", "AR")])


def correlation_pairs(matches: DataFrame, columns: tuple[str, ...] = MEASURES, places: int = 6) -> DataFrame:
    """Pearson correlation of every column with each one listed before it.

    One pass keeps n, the sums and the sums of products.  The measures are whole
    numbers, so these sums are exact up to 2^53; a constant column gives null.
    """
    pairs = [(later, earlier) for earlier, later in combinations(columns, 2)]
    sums = [F.sum(c).alias(f"s_{c}") for c in columns]
    squares = [F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in columns]
    products = [F.sum(F.col(x) * F.col(y)).alias(f"p_{x}_{y}") for x, y in pairs]
    total = matches.agg(F.count(F.lit(1)).cast("double").alias("n"), *sums, *squares, *products)

    def cell(x: str, y: str) -> Column:
        parts = {"sx": f"s_{x}", "sy": f"s_{y}", "qx": f"q_{x}", "qy": f"q_{y}", "p": f"p_{x}_{y}"}
        return F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), *[F.col(c).alias(name) for name, c in parts.items()])

    cells = total.select("n", F.inline(F.array(*[cell(x, y) for x, y in pairs])))
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    spread = F.sqrt(n * F.col("qx") - sx * sx) * F.sqrt(n * F.col("qy") - sy * sy)
    r = F.try_divide(n * F.col("p") - sx * sy, spread)
    return cells.select("x", "y", F.round(r, places).alias("r"))


def dataset_summary(matches: DataFrame) -> DataFrame:
    """Date range, sizes and team count from one pass: pairs first, then their teams."""
    pairs = matches.groupBy("HomeTeam", "AwayTeam").agg(
        F.count(F.lit(1)).alias("n"), F.min("Date").alias("first"), F.max("Date").alias("last"),
    )
    nothing = (F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("date").alias("first"), F.lit(None).cast("date").alias("last"))
    home = F.struct(F.col("HomeTeam").alias("Team"), F.col("n"), F.col("first"), F.col("last"))
    away = F.struct(F.col("AwayTeam").alias("Team"), *nothing)
    teams = pairs.select(F.inline(F.array(home, away))).groupBy("Team").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"),
    )
    return teams.agg(
        F.min("first").alias("first_date"), F.max("last").alias("last_date"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("matches"),
        F.lit(len(MATCH_COLUMNS)).alias("columns"),
        F.count("Team").alias("teams"),
    )


def kpi_summary(matches: DataFrame) -> DataFrame:
    """Headline numbers of the dashboard, computed instead of fixed."""
    c = F.col
    return matches.agg(
        (_mean(c("FTR") == "H") * 100).alias("home_win_pct"),
        F.avg("FTHG").alias("avg_home_goals"),
        F.avg("FTAG").alias("avg_away_goals"),
        (F.avg(c("HS") + c("AS")) / 2).alias("shots_per_team"),
        (F.avg(c("HST") + c("AST")) / 2).alias("shots_on_target_per_team"),
        F.try_divide(F.sum(c("FTHG") + c("FTAG")), F.sum(c("HST") + c("AST"))).alias("goals_per_shot_on_target"),
        (F.avg(c("HY") + c("AY")) / 2).alias("yellows_per_team"),
        (_mean(c("HR") + c("AR") > 0) * 100).alias("red_card_match_pct"),
    )


def goal_buckets(matches: DataFrame) -> DataFrame:
    """Percent of matches with 0, 1, 2, 3 and 4 or more goals."""
    goals = F.col("FTHG") + F.col("FTAG")
    inside = {str(g): goals == g for g in range(4)} | {"4+": goals >= 4}
    total = matches.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(test).alias(f"g{b}") for b, test in inside.items()])
    rows = [
        F.struct(F.lit(b).alias("goals"), F.col(f"g{b}").alias("matches"), _share(F.col(f"g{b}"), F.col("n")).alias("percent"))
        for b in inside
    ]
    return total.select(F.inline(F.array(*rows)))


def fouls_vs_win(matches: DataFrame) -> DataFrame:
    """Home and away win rate by which side fouled more (1 home, -1 away, 0 equal)."""
    return matches.groupBy(F.signum(F.col("HF") - F.col("AF")).cast("int").alias("foul_sign")).agg(
        F.count(F.lit(1)).alias("matches"),
        _mean(F.col("FTR") == "H").alias("home_win_rate"),
        _mean(F.col("FTR") == "A").alias("away_win_rate"),
    )


# Chart -> (x column, y column).
SCATTER_PAIRS = {
    "home_shots_goals": ("HS", "FTHG"),
    "home_target_goals": ("HST", "FTHG"),
    "home_fouls_cards": ("HF", "HY"),
    "away_fouls_cards": ("AF", "AY"),
}


def scatter_points(matches: DataFrame, stats: DataFrame) -> DataFrame:
    """Points of the scatter charts with how many rows share each of them."""
    dots = F.array(*[
        F.struct(F.lit(chart).alias("chart"), F.col(x).alias("x"), F.col(y).alias("y"))
        for chart, (x, y) in SCATTER_PAIRS.items()
    ])
    drawn = matches.select(F.inline(dots)).groupBy("chart", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    teams = stats.groupBy(
        F.lit("team_difference_points").alias("chart"),
        F.col("GoalDifference").alias("x"), F.col("Points").cast("double").alias("y"),
    ).agg(F.count(F.lit(1)).alias("n"))
    return drawn.unionByName(teams)
