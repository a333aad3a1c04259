"""Two-team comparisons: stats side by side, winners per stat, picks and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.labels import one_decimal
from touchline.runtime import Lookup
from touchline.schema import TEAM_STATS_COLUMNS

STATS = tuple(c for c in TEAM_STATS_COLUMNS if c != "Team")

# Fixed values of the points pick: least and greatest confidence, and that of a draw.
PICK_BASE, PICK_CAP, PICK_DRAW = 65, 80, 45
# Fixed value: the draw share of the head-to-head split.
DRAW_SHARE = 25.0


def pairings(matches: DataFrame) -> DataFrame:
    """Every (home, away) pair that has met, as (team1, team2)."""
    return matches.select(F.col("HomeTeam").alias("team1"), F.col("AwayTeam").alias("team2")).distinct()


def paired_stats(pairs: DataFrame, stats: Lookup, how: str = "inner") -> DataFrame:
    """Both teams' table rows next to each other, as ``<stat>_1`` and ``<stat>_2``."""
    for side in ("1", "2"):
        pairs = stats.join(pairs, {f"team{side}": "Team"}, {c: f"{c}_{side}" for c in STATS}, how)
    return pairs


def team_comparison(pairs: DataFrame, stats: Lookup) -> DataFrame:
    """Pairs of known teams with rounded figures and who leads on points."""
    both = paired_stats(pairs, stats)
    figures = ("Points", "Matches", "Wins", "GoalsFor", "GoalsAgainst")
    p1, p2 = F.col("Points_1"), F.col("Points_2")
    leader = (
        F.when(p1 > p2, F.concat("team1", F.lit(" Leads")))
        .when(p2 > p1, F.concat("team2", F.lit(" Leads")))
        .otherwise("Equal Points")
    )
    return both.select(
        "team1", "team2",
        *[F.bround(F.col(f"{c}_{s}")).cast("bigint").alias(f"{c}_{s}") for s in "12" for c in figures],
        *[one_decimal(F.col(f"WinPercentage_{s}")).alias(f"WinPercentage_{s}") for s in "12"],
        leader.alias("leader"),
    )


def compare_stats(pairs: DataFrame, stats: Lookup) -> DataFrame:
    """One row per pair and statistic with the side that has more of it."""
    both = paired_stats(pairs, stats)
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("stat"),
            *[F.coalesce(F.col(f"{c}_{s}").cast("double"), F.lit(0.0)).alias(f"value{s}") for s in "12"],
        )
        for c in STATS
    ])
    v1, v2 = F.col("value1"), F.col("value2")
    return both.select("team1", "team2", F.inline(rows)).withColumn(
        "winner", F.when(v1 > v2, "team1").when(v2 > v1, "team2").otherwise("tie")
    )


def head_to_head(pairs: DataFrame, stats: Lookup) -> DataFrame:
    """Win shares from both win percentages around a fixed draw share; null if neither ever won."""
    both = paired_stats(pairs, stats)
    w1, w2 = F.col("WinPercentage_1"), F.col("WinPercentage_2")
    share = F.try_divide(w1, w1 + w2) * 100
    return both.select(
        "team1", "team2",
        F.bround(share).cast("bigint").alias("team1_share"),
        F.lit(DRAW_SHARE).cast("bigint").alias("draw_share"),
        F.bround(100 - share - DRAW_SHARE).cast("bigint").alias("team2_share"),
    )


def points_pick(pairs: DataFrame, stats: Lookup) -> DataFrame:
    """The side with more points and a confidence that grows with the gap."""
    return with_points_pick(paired_stats(pairs, stats, "left")).select("team1", "team2", "pick", "confidence")


def with_points_pick(both: DataFrame) -> DataFrame:
    """Adds ``pick`` and ``confidence`` to rows that carry ``Points_1`` and ``Points_2``."""
    p1, p2 = F.col("Points_1"), F.col("Points_2")
    known = p1.isNotNull() & p2.isNotNull()
    pick = (
        F.when(~known, "Close match expected")
        .when(p1 > p2, F.col("team1")).when(p2 > p1, F.col("team2")).otherwise("Draw")
    )
    confidence = F.when(p1 == p2, PICK_DRAW).when(known, F.least(PICK_BASE + F.abs(p1 - p2), F.lit(PICK_CAP)))
    return both.withColumns({"pick": pick, "confidence": confidence.cast("bigint")})
