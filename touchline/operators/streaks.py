"""Does a win make the next one likelier?  Previous result per team, without one task per team.

A team's matches are ordered by date, then by the digest of the match id.  The
digest cuts every (team, day) into even slices, so neither a team nor a day that
holds a large share of all rows ends up in one window.  Each slice is summed up
by its first and last result and its inner counts; the same summary is then
taken over the slices of a day and over the days of a team.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE_DIGITS = 2


def _team_results(matches: DataFrame) -> DataFrame:
    digest = F.md5("match_id")
    return matches.select("Date", digest.alias("digest"), F.inline(F.array(
        F.struct(F.col("HomeTeam").alias("Team"), F.lit(0).alias("side"), (F.col("FTR") == "H").cast("int").alias("won")),
        F.struct(F.col("AwayTeam").alias("Team"), F.lit(1).alias("side"), (F.col("FTR") == "A").cast("int").alias("won")),
    ))).where(F.col("Team").isNotNull())


def _joined(parts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Merge summaries that follow each other by ``order`` within ``keys``."""
    previous = F.lag("last_won").over(Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last()))
    position = F.struct(F.col(order).isNull(), F.col(order))
    return parts.withColumn("previous", previous).groupBy(*keys).agg(
        F.sum("matches").alias("matches"), F.sum("wins").alias("wins"),
        F.sum(F.col("after_win") + F.coalesce("previous", F.lit(0))).alias("after_win"),
        F.sum(F.col("win_after_win") + F.coalesce(F.col("previous") * F.col("first_won"), F.lit(0))).alias("win_after_win"),
        F.min_by("first_won", position).alias("first_won"), F.max_by("last_won", position).alias("last_won"),
    )


def streak_continuation(matches: DataFrame) -> DataFrame:
    """Per team: overall win rate, and win rate when the match before was won."""
    rows = _team_results(matches).withColumn("slice", F.substring("digest", 1, SLICE_DIGITS))
    slice_keys = ["Team", "Date", "slice"]
    before = F.lag("won").over(Window.partitionBy(*slice_keys).orderBy("digest", "side"))
    place = F.struct("digest", "side")
    slices = rows.withColumn("before", before).groupBy(*slice_keys).agg(
        F.count(F.lit(1)).alias("matches"), F.sum("won").alias("wins"),
        F.sum(F.coalesce("before", F.lit(0))).alias("after_win"),
        F.sum(F.coalesce(F.col("before") * F.col("won"), F.lit(0))).alias("win_after_win"),
        F.min_by("won", place).alias("first_won"), F.max_by("won", place).alias("last_won"),
    )
    days = _joined(slices, ["Team", "Date"], "slice")
    teams = _joined(days, ["Team"], "Date")
    return teams.select(
        "Team", "matches", F.try_divide("wins", "matches").alias("win_rate"),
        "after_win", F.try_divide("win_after_win", "after_win").alias("win_rate_after_win"),
    )
