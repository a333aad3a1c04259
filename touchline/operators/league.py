"""Team tables from matches: league table, averages, home record, rankings.

Matches are first summed per (home, away) pair, so each match is touched once
and partial aggregation leaves at most one row per pair and task to shuffle,
however many matches one team has.  Only those sums are turned into a home and
an away view and summed again per team.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from touchline.functions.labels import form_record_text
from touchline.schema import TEAM_STATS_COLUMNS

# Team-view sums: name -> (home team's column, away team's column).
_SIDES = {
    "GoalsFor": ("FTHG", "FTAG"), "GoalsAgainst": ("FTAG", "FTHG"),
    "ShotsFor": ("HS", "AS"), "ShotsAgainst": ("AS", "HS"),
    "SOTFor": ("HST", "AST"), "SOTAgainst": ("AST", "HST"),
    "YellowCards": ("HY", "AY"), "RedCards": ("HR", "AR"), "Fouls": ("HF", "AF"),
    "CornersFor": ("HC", "AC"), "CornersAgainst": ("AC", "HC"),
}


PAIR = ("HomeTeam", "AwayTeam")
TABLE_SUMS = ("GoalsFor", "GoalsAgainst")


def pair_sums(matches: DataFrame, sums: tuple[str, ...] = TABLE_SUMS) -> DataFrame:
    """One row per (home, away) pair: matches, results and what the named sums of both teams need."""
    needed = sorted({column for name in sums for column in _SIDES[name]})
    return matches.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("FTR") == "H").alias("home_wins"),
        F.count_if(F.col("FTR") == "A").alias("away_wins"),
        F.count_if(F.col("FTR") == "D").alias("draws"),
        *[F.sum(c).alias(f"sum_{c}") for c in needed],
    )


def added_pairs(some: DataFrame, more: DataFrame) -> DataFrame:
    """Pair sums of two sets of matches together."""
    both = some.unionByName(more)
    return both.groupBy(*PAIR).agg(*[F.sum(c).alias(c) for c in both.columns if c not in PAIR])


def pair_sides(pairs: DataFrame, sums: tuple[str, ...]) -> DataFrame:
    """Home and away view of pair sums."""
    def view(side: int) -> Column:
        return F.struct(
            F.col(("HomeTeam", "AwayTeam")[side]).alias("Team"),
            F.lit(("home", "away")[side]).alias("Side"),
            F.col("n").alias("Matches"),
            F.col(("home_wins", "away_wins")[side]).alias("Wins"),
            F.col("draws").alias("Draws"),
            *[F.col(f"sum_{_SIDES[name][side]}").alias(name) for name in sums],
        )

    return pairs.select(F.inline(F.array(view(0), view(1)))).where(F.col("Team").isNotNull())


def team_sides(matches: DataFrame, sums: tuple[str, ...]) -> DataFrame:
    """Per (team, side): Matches, Wins, Draws and the named sums, one row per pair."""
    return pair_sides(pair_sums(matches, sums), sums)


def _totals(sides: DataFrame, sums: tuple[str, ...]) -> DataFrame:
    return sides.groupBy("Team").agg(*[F.sum(c).alias(c) for c in ("Matches", "Wins", "Draws") + sums])


def team_totals(matches: DataFrame, sums: tuple[str, ...]) -> DataFrame:
    return _totals(team_sides(matches, sums), sums)


def _table_columns(totals: DataFrame) -> DataFrame:
    return totals.withColumns({
        "Losses": F.col("Matches") - F.col("Wins") - F.col("Draws"),
        "GoalDifference": F.col("GoalsFor") - F.col("GoalsAgainst"),
        "Points": F.col("Wins") * 3 + F.col("Draws"),
        "WinPercentage": F.coalesce(F.try_divide(F.col("Wins"), F.col("Matches")) * 100, F.lit(0.0)),
    }).select(*TEAM_STATS_COLUMNS)


def team_stats(matches: DataFrame) -> DataFrame:
    """The league table, unordered."""
    return stats_of_pairs(pair_sums(matches))


def stats_of_pairs(pairs: DataFrame) -> DataFrame:
    """The league table from pair sums."""
    return _table_columns(_totals(pair_sides(pairs, TABLE_SUMS), TABLE_SUMS))


def in_table_order(stats: DataFrame) -> DataFrame:
    return stats.orderBy(F.desc("Points"), "Team")


def league_table(matches: DataFrame) -> DataFrame:
    return in_table_order(team_stats(matches))


def home_record(matches: DataFrame) -> DataFrame:
    """The league table counting home matches only."""
    home = team_sides(matches, TABLE_SUMS).where(F.col("Side") == "home")
    return in_table_order(_table_columns(_totals(home, TABLE_SUMS)))


def red_card_ranking(matches: DataFrame) -> DataFrame:
    cards = team_totals(matches, ("RedCards", "YellowCards"))
    return cards.select("Team", "Matches", "RedCards", "YellowCards").orderBy(F.desc("RedCards"), "Team")


def team_features(matches: DataFrame) -> DataFrame:
    """Twelve per-match averages and the total points of every team."""
    totals = team_totals(matches, tuple(_SIDES))

    def average(column: str) -> Column:
        return F.try_divide(F.col(column), F.col("Matches"))

    return totals.select(
        "Team",
        *[average(name).alias(f"Avg{name}") for name in _SIDES],
        average("Wins").alias("WinRate"),
        (F.col("Wins") * 3 + F.col("Draws")).alias("TotalPoints"),
    )


def distinct_teams(matches: DataFrame) -> DataFrame:
    both = matches.select(F.explode(F.array("HomeTeam", "AwayTeam")).alias("Team"))
    return both.where(F.col("Team").isNotNull()).distinct()


def top_goals_for(stats: DataFrame, n: int = 10) -> DataFrame:
    return stats.orderBy(F.desc("GoalsFor"), F.desc("Points"), "Team").limit(n)


def best_defence(stats: DataFrame, n: int = 10) -> DataFrame:
    return stats.orderBy("GoalsAgainst", F.desc("Points"), "Team").limit(n)


def table_head(stats: DataFrame, n: int = 10) -> DataFrame:
    return in_table_order(stats).limit(n)


def table_top(stats: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` teams with a running rank and their record as text.

    The rank's window has no partition key, but sees only the ``n`` rows kept.
    """
    place = F.row_number().over(Window.orderBy(F.desc("Points"), "Team"))
    return table_head(stats, n).select(
        place.alias("Rank"), "Team", "Points",
        form_record_text(F.col("Wins"), F.col("Draws"), F.col("Losses")).alias("Record"),
    )


def form_bands(stats: DataFrame) -> DataFrame:
    """Win rate over decided and drawn matches, with the two wordings of its band."""
    games = F.greatest(F.col("Wins") + F.col("Draws") + F.col("Losses"), F.lit(1))
    rate = F.try_divide(F.col("Wins"), games) * 100
    return stats.select(
        "Team", "Wins", games.alias("Games"), rate.alias("WinRate"),
        form_band(rate, "needs improvement").alias("StatsForm"),
        form_band(rate, "inconsistent").alias("RecentForm"),
    )


def form_band(rate: Column, low: str) -> Column:
    return F.when(rate > 60, "excellent").when(rate > 40, "good").otherwise(low)


def upcoming(matches: DataFrame, since: str, n: int = 8) -> DataFrame:
    """The next ``n`` fixtures from a day on."""
    due = matches.where(F.col("Date") >= F.to_date(F.lit(since)))
    return due.orderBy("Date", "match_id").limit(n)
