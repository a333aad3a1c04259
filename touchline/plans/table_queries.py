"""Registered queries over matches: cleaning, features, league tables, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.labels import RESULT_LABELS, TEAM_DISPLAY_NAMES, team_display
from touchline.functions.match_columns import feature_vectors, with_match_features
from touchline.operators import clean, compare, league, streaks, summary
from touchline.plans.base_sql import CLEAN, GOALS, MATCHES, REQUESTS, WITH_MATCHES, WITH_STATS, columns, q, sides, table_sql, text
from touchline.plans.registry import Registry
from touchline.runtime import Lookup, written_table
from touchline.schema import FULL_FEATURES, HALF_TIME_GOALS, MATCH_COLUMNS, MATCH_STATS, MEASURES
from touchline.sources import star_tables

REGISTRY = Registry()
query = REGISTRY.query


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_tables.matches(spark, sf_dir)


def raw_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw matches as the stored texts they stand for, so that cleaning starts at a scan."""
    return written_table(star_tables.raw_matches(spark, sf_dir), "raw")


def request_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction requests as a stored table."""
    return written_table(star_tables.requests(spark, sf_dir), "requests")


def _stats(spark: SparkSession, sf_dir: str) -> Lookup:
    return Lookup(league.team_stats(_matches(spark, sf_dir)))


# --- cleaning and features -------------------------------------------------

@query(f"WITH {CLEAN} SELECT match_id, {columns(MATCH_COLUMNS)} FROM cleaned")
def clean_matches(spark, sf_dir):
    return clean.clean_matches(raw_table(spark, sf_dir))


@query(f"""WITH {CLEAN}, r AS (SELECT count(*) AS raw_rows, count(*) FILTER (WHERE "AwayTeam" IS NULL OR "HomeTeam" IS NULL) AS dropped_rows,
  count(*) FILTER (WHERE "FTR" IS NULL) AS defaulted_results, count(*) FILTER (WHERE "Date"='n/a') AS undated_rows,
  count(*) FILTER (WHERE "HS" IS NULL OR "HS"='x') AS zeroed_rows FROM raw) SELECT * FROM r""")
def cleaning_report(spark, sf_dir):
    return clean.cleaning_report(raw_table(spark, sf_dir))


FEATURES_SQL = """"FTHG"+"FTAG" AS "TotalGoals", year("Date") AS "Season", month("Date") AS "Month",
  "FTHG"-"FTAG" AS "GoalDifference", "HTHG"-"HTAG" AS "HTGoalDifference",
  "FTHG"/("HS"+1) AS "HomeShotEfficiency", "FTAG"/("AS"+1) AS "AwayShotEfficiency",
  "HST"/("HS"+1) AS "HomeSOTRatio", "AST"/("AS"+1) AS "AwaySOTRatio" """


@query(f"WITH {CLEAN} SELECT match_id, {columns(MATCH_COLUMNS)}, {FEATURES_SQL} FROM cleaned")
def match_features(spark, sf_dir):
    return with_match_features(clean_matches(spark, sf_dir))


def full_features_sql(source: str, month: str, day: str, keep: str = "match_id") -> str:
    return f"""SELECT {keep}, {columns(MATCH_STATS + HALF_TIME_GOALS)}, "HS"+"AS" AS "TotalShots", "HS"-"AS" AS "ShotDifference",
  ("HST"+"AST")/("HS"+"AS"+1) AS "ShotsOnTargetRatio", "HST"/("HS"+1) AS "HomeShotAccuracy", "AST"/("AS"+1) AS "AwayShotAccuracy",
  "HST"/("HS"+1) - "AST"/("AS"+1) AS "ShotAccuracyDiff", "HC"+"AC" AS "TotalCorners", "HC"-"AC" AS "CornerDifference",
  "HF"+"AF" AS "TotalFouls", "HF"-"AF" AS "FoulDifference", "HY"+"HR"+"AY"+"AR" AS "TotalCards", "HY"+"HR" AS "HomeCards",
  "AY"+"AR" AS "AwayCards", ("HY"+"HR")-("AY"+"AR") AS "CardDifference", "HTHG"-"HTAG" AS "HTGoalDifference",
  "HTHG"+"HTAG" AS "HTTotalGoals", (CASE "HTR" WHEN 'A' THEN 0 WHEN 'H' THEN 2 ELSE 1 END)::DOUBLE AS "HTR_encoded",
  coalesce(month("Date"), {month})::DOUBLE AS "Month", coalesce(isodow("Date")-1, {day})::DOUBLE AS "DayOfWeek",
  (CASE WHEN coalesce(isodow("Date")-1, {day}) >= 5 THEN 1 ELSE 0 END)::DOUBLE AS "IsWeekend" FROM {source}"""


@query(f"WITH {CLEAN} " + full_features_sql("cleaned", "0", "0", 'match_id, "FTR"'))
def match_features_full(spark, sf_dir):
    return feature_vectors(clean_matches(spark, sf_dir), "train", "match_id", "FTR")


_REQUEST_NUMBERS = ", ".join(f'coalesce(try_cast({q(c)} AS DOUBLE), 0.0::DOUBLE) AS {q(c)}' for c in MATCH_STATS + HALF_TIME_GOALS)


@query(f"""WITH {REQUESTS}, typed AS (SELECT match_id, "Date", "HTR", {_REQUEST_NUMBERS} FROM requests)
{full_features_sql('typed', '9', '5')}""")
def score_features(spark, sf_dir):
    requests = star_tables.typed_requests(request_table(spark, sf_dir))
    return feature_vectors(requests, "score", "match_id")


_DISPLAY_CASE = "CASE \"Team\" " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in TEAM_DISPLAY_NAMES.items()) + " ELSE \"Team\" END"


@query(f"""WITH {MATCHES}, teams AS (SELECT "HomeTeam" AS "Team" FROM matches UNION SELECT "AwayTeam" FROM matches
UNION ALL SELECT unnest([{', '.join(text(k) for k in TEAM_DISPLAY_NAMES)}]))
SELECT "Team", {_DISPLAY_CASE} AS display_name FROM teams""")
def team_display_names(spark, sf_dir):
    short = spark.createDataFrame([(name,) for name in TEAM_DISPLAY_NAMES], "Team string")
    teams = league.distinct_teams(_matches(spark, sf_dir)).unionByName(short)
    return teams.select("Team", team_display(F.col("Team")).alias("display_name"))


# --- league tables -----------------------------------------------------------

@query(WITH_STATS + "SELECT * FROM stats ORDER BY \"Points\" DESC, \"Team\"")
def league_table(spark, sf_dir):
    return league.league_table(_matches(spark, sf_dir))


_AVERAGES = {
    "AvgGoalsFor": ("FTHG", "FTAG"), "AvgGoalsAgainst": ("FTAG", "FTHG"), "AvgShotsFor": ("HS", "AS"), "AvgShotsAgainst": ("AS", "HS"),
    "AvgSOTFor": ("HST", "AST"), "AvgSOTAgainst": ("AST", "HST"), "AvgYellowCards": ("HY", "AY"), "AvgRedCards": ("HR", "AR"),
    "AvgFouls": ("HF", "AF"), "AvgCornersFor": ("HC", "AC"), "AvgCornersAgainst": ("AC", "HC"),
}


@query(WITH_MATCHES + f"""SELECT "Team", {', '.join(f'sum({q(a)})/count(*) AS {q(a)}' for a in _AVERAGES)},
(count(*) FILTER (WHERE won))::DOUBLE/count(*) AS "WinRate",
3*(count(*) FILTER (WHERE won)) + (count(*) FILTER (WHERE "FTR"='D')) AS "TotalPoints"
FROM ({sides('matches', _AVERAGES)}) GROUP BY "Team" """)
def team_features(spark, sf_dir):
    return league.team_features(_matches(spark, sf_dir))


@query(WITH_MATCHES + table_sql(f"SELECT * FROM ({sides('matches', GOALS)}) WHERE side = 0"))
def home_record(spark, sf_dir):
    return league.home_record(_matches(spark, sf_dir))


@query(WITH_MATCHES + f"""SELECT "Team", count(*) AS "Matches", sum(r) AS "RedCards", sum(y) AS "YellowCards"
FROM ({sides('matches', {'r': ('HR', 'AR'), 'y': ('HY', 'AY')})}) GROUP BY "Team" """)
def red_card_ranking(spark, sf_dir):
    return league.red_card_ranking(_matches(spark, sf_dir))


@query(WITH_STATS + 'SELECT "Team" FROM stats')
def distinct_teams(spark, sf_dir):
    return league.distinct_teams(_matches(spark, sf_dir))


@query(WITH_STATS + 'SELECT * FROM stats ORDER BY "GoalsFor" DESC, "Points" DESC, "Team" LIMIT 10')
def top_goals_for(spark, sf_dir):
    return league.top_goals_for(league.team_stats(_matches(spark, sf_dir)))


@query(WITH_STATS + 'SELECT * FROM stats ORDER BY "GoalsAgainst", "Points" DESC, "Team" LIMIT 10')
def best_defence(spark, sf_dir):
    return league.best_defence(league.team_stats(_matches(spark, sf_dir)))


@query(WITH_STATS + 'SELECT "Team", "WinPercentage", "Points" FROM stats ORDER BY "Points" DESC, "Team" LIMIT 10')
def win_percentage_top10(spark, sf_dir):
    return league.table_head(league.team_stats(_matches(spark, sf_dir)), 10).select("Team", "WinPercentage", "Points")


@query(WITH_STATS + """SELECT row_number() OVER (ORDER BY "Points" DESC, "Team") AS "Rank", "Team", "Points",
"Wins" || 'W-' || "Draws" || 'D-' || "Losses" || 'L' AS "Record" FROM stats ORDER BY "Points" DESC, "Team" LIMIT 5""")
def table_top5(spark, sf_dir):
    return league.table_top(league.team_stats(_matches(spark, sf_dir)), 5)


_RATE = '"Wins"::DOUBLE/greatest("Wins"+"Draws"+"Losses", 1)*100'


@query(WITH_STATS + f"""SELECT "Team", "Wins", greatest("Wins"+"Draws"+"Losses", 1) AS "Games", {_RATE} AS "WinRate",
CASE WHEN {_RATE}>60 THEN 'excellent' WHEN {_RATE}>40 THEN 'good' ELSE 'needs improvement' END AS "StatsForm",
CASE WHEN {_RATE}>60 THEN 'excellent' WHEN {_RATE}>40 THEN 'good' ELSE 'inconsistent' END AS "RecentForm" FROM stats""")
def team_form_band(spark, sf_dir):
    return league.form_bands(league.team_stats(_matches(spark, sf_dir)))


# --- summaries ----------------------------------------------------------------

_OUTCOME_CASE = 'CASE "FTR" ' + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RESULT_LABELS.items()) + ' ELSE "FTR" END'


@query(WITH_MATCHES + f""", counts AS (SELECT "FTR", count(*) AS n FROM matches GROUP BY "FTR"),
shares AS (SELECT *, n*100.0::DOUBLE/(SELECT count(*) FROM matches) AS p FROM counts)
SELECT "FTR", {_OUTCOME_CASE} AS outcome, n AS matches, p AS percent, printf('%.1f%%', round_even(p*10, 0)/10) AS percent_text FROM shares""")
def outcome_distribution(spark, sf_dir):
    return summary.outcome_distribution(_matches(spark, sf_dir))


@query(WITH_MATCHES + """SELECT "HomeTeam" AS "Team", sum("FTHG")/count(*) AS avg_goals FROM matches GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 10""")
def top_home_scoring(spark, sf_dir):
    return summary.top_scoring(_matches(spark, sf_dir), "HomeTeam", "FTHG")


@query(WITH_MATCHES + """SELECT "AwayTeam" AS "Team", sum("FTAG")/count(*) AS avg_goals FROM matches GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 10""")
def top_away_scoring(spark, sf_dir):
    return summary.top_scoring(_matches(spark, sf_dir), "AwayTeam", "FTAG")


def _histogram_sql(values: str, series: str, bins: int) -> str:
    return WITH_MATCHES + f""", v AS ({values}),
grid AS (SELECT s.series, b.bin FROM (SELECT unnest([{series}]) AS series) s, (SELECT unnest(range({bins})) AS bin) b)
SELECT grid.series, grid.bin::INTEGER AS bin, count(v.x) AS n FROM grid LEFT JOIN v ON v.series = grid.series
AND v.x >= 0 AND v.x <= {bins} AND least(floor(v.x), {bins - 1}) = grid.bin GROUP BY 1, 2"""


@query(_histogram_sql('SELECT \'FTHG\' AS series, "FTHG" AS x FROM matches UNION ALL SELECT \'FTAG\', "FTAG" FROM matches', "'FTHG', 'FTAG'", 7))
def goals_histogram(spark, sf_dir):
    return summary.goals_histogram(_matches(spark, sf_dir))


@query(_histogram_sql('SELECT \'TotalGoals\' AS series, "FTHG"+"FTAG" AS x FROM matches', "'TotalGoals'", 11))
def total_goals_histogram(spark, sf_dir):
    return summary.total_goals_histogram(_matches(spark, sf_dir))


@query(WITH_MATCHES + "SELECT " + ", ".join(f'sum("{c}")/count(*) AS "{c}"' for c in ("HY", "AY", "HR", "AR")) + " FROM matches")
def avg_cards(spark, sf_dir):
    return summary.avg_cards(_matches(spark, sf_dir))


_PAIRS_SQL = " UNION ALL ".join(
    f"SELECT '{y}' AS x, '{x}' AS y, round(corr({q(y)}, {q(x)}), 6) AS r FROM matches"
    for i, x in enumerate(MEASURES) for y in MEASURES[i + 1:]
)


@query(WITH_MATCHES + _PAIRS_SQL)
def correlation_pairs(spark, sf_dir):
    return summary.correlation_pairs(_matches(spark, sf_dir))


@query(WITH_MATCHES + f"""SELECT min("Date") AS first_date, max("Date") AS last_date, count(*) AS matches,
{len(MATCH_COLUMNS)} AS columns, (SELECT count(DISTINCT t) FROM (SELECT "HomeTeam" AS t FROM matches UNION ALL SELECT "AwayTeam" FROM matches)) AS teams
FROM matches""")
def dataset_summary(spark, sf_dir):
    return summary.dataset_summary(_matches(spark, sf_dir))


@query(WITH_MATCHES + """SELECT sum(CASE WHEN "FTR"='H' THEN 1.0::DOUBLE ELSE 0.0 END)/count(*)*100 AS home_win_pct,
sum("FTHG")/count(*) AS avg_home_goals, sum("FTAG")/count(*) AS avg_away_goals,
sum("HS"+"AS")/count(*)/2 AS shots_per_team, sum("HST"+"AST")/count(*)/2 AS shots_on_target_per_team,
sum("FTHG"+"FTAG")/sum("HST"+"AST") AS goals_per_shot_on_target, sum("HY"+"AY")/count(*)/2 AS yellows_per_team,
sum(CASE WHEN "HR"+"AR">0 THEN 1.0::DOUBLE ELSE 0.0 END)/count(*)*100 AS red_card_match_pct FROM matches""")
def kpi_summary(spark, sf_dir):
    return summary.kpi_summary(_matches(spark, sf_dir))


@query(WITH_MATCHES + """, b AS (SELECT CASE WHEN "FTHG"+"FTAG">=4 THEN '4+' ELSE ("FTHG"+"FTAG")::BIGINT::VARCHAR END AS goals FROM matches)
SELECT g.goals, count(b.goals) AS matches, count(b.goals)*100.0::DOUBLE/(SELECT count(*) FROM b) AS percent
FROM (SELECT unnest(['0','1','2','3','4+']) AS goals) g LEFT JOIN b ON b.goals = g.goals GROUP BY 1""")
def goal_buckets(spark, sf_dir):
    return summary.goal_buckets(_matches(spark, sf_dir))


@query(WITH_MATCHES + """SELECT sign("HF"-"AF")::INTEGER AS foul_sign, count(*) AS matches,
sum(CASE WHEN "FTR"='H' THEN 1.0::DOUBLE ELSE 0.0 END)/count(*) AS home_win_rate,
sum(CASE WHEN "FTR"='A' THEN 1.0::DOUBLE ELSE 0.0 END)/count(*) AS away_win_rate FROM matches GROUP BY 1""")
def fouls_vs_win(spark, sf_dir):
    return summary.fouls_vs_win(_matches(spark, sf_dir))


@query(WITH_STATS + " UNION ALL ".join(
    f"SELECT '{chart}' AS chart, {q(x)} AS x, {q(y)} AS y, count(*) AS n FROM matches GROUP BY 2, 3"
    for chart, (x, y) in summary.SCATTER_PAIRS.items()
) + " UNION ALL SELECT 'team_difference_points', \"GoalDifference\", \"Points\"::DOUBLE, count(*) FROM stats GROUP BY 2, 3")
def scatter_points(spark, sf_dir):
    matches = _matches(spark, sf_dir)
    return summary.scatter_points(matches, league.team_stats(matches))


@query(WITH_MATCHES + f""", v AS ({sides('matches', {})}),
w AS (SELECT "Team", won::INTEGER AS won, lag(won::INTEGER) OVER (PARTITION BY "Team" ORDER BY "Date" NULLS LAST, md5(match_id), side) AS before FROM v)
SELECT "Team", count(*) AS matches, sum(won)::DOUBLE/count(*) AS win_rate, (count(*) FILTER (WHERE before=1)) AS after_win,
(count(*) FILTER (WHERE before=1 AND won=1))::DOUBLE/nullif(count(*) FILTER (WHERE before=1), 0) AS win_rate_after_win FROM w GROUP BY "Team" """)
def streak_continuation(spark, sf_dir):
    return streaks.streak_continuation(_matches(spark, sf_dir))


@query(WITH_MATCHES + """SELECT match_id, "Date", "HomeTeam", "AwayTeam" FROM matches WHERE "Date" >= DATE '2001-01-01'
ORDER BY "Date", match_id LIMIT 8""")
def upcoming_top8(spark, sf_dir):
    return league.upcoming(_matches(spark, sf_dir), "2001-01-01").select("match_id", "Date", "HomeTeam", "AwayTeam")


# --- comparisons --------------------------------------------------------------

_PAIRED = WITH_STATS + """, pairs AS (SELECT DISTINCT "HomeTeam" AS team1, "AwayTeam" AS team2 FROM matches UNION ALL
SELECT DISTINCT "HomeTeam", "HomeTeam" || ' Reserves' FROM matches)
"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs that met, and each home team against one that is not in the table."""
    matches = _matches(spark, sf_dir)
    unknown = matches.select(F.col("HomeTeam").alias("team1")).distinct()
    return compare.pairings(matches).unionByName(unknown.withColumn("team2", F.concat("team1", F.lit(" Reserves"))))


_FIGURES = ("Points", "Matches", "Wins", "GoalsFor", "GoalsAgainst")


@query(_PAIRED + f"""SELECT team1, team2, {', '.join(f's{i}.{q(c)}::BIGINT AS {q(f"{c}_{i}")}' for i in (1, 2) for c in _FIGURES)},
{', '.join(f'round_even(s{i}."WinPercentage"*10, 0)/10 AS "WinPercentage_{i}"' for i in (1, 2))},
CASE WHEN s1."Points">s2."Points" THEN team1 || ' Leads' WHEN s2."Points">s1."Points" THEN team2 || ' Leads' ELSE 'Equal Points' END AS leader
FROM pairs JOIN stats s1 ON s1."Team"=team1 JOIN stats s2 ON s2."Team"=team2""")
def team_comparison(spark, sf_dir):
    return compare.team_comparison(_pairs(spark, sf_dir), _stats(spark, sf_dir))


@query(_PAIRED + ", c AS (" + " UNION ALL ".join(
    f"SELECT team1, team2, '{c}' AS stat, s1.{q(c)}::DOUBLE AS value1, s2.{q(c)}::DOUBLE AS value2 "
    'FROM pairs JOIN stats s1 ON s1."Team"=team1 JOIN stats s2 ON s2."Team"=team2' for c in compare.STATS
) + ") SELECT *, CASE WHEN value1>value2 THEN 'team1' WHEN value2>value1 THEN 'team2' ELSE 'tie' END AS winner FROM c")
def compare_stats(spark, sf_dir):
    return compare.compare_stats(_pairs(spark, sf_dir), _stats(spark, sf_dir))


@query(_PAIRED + """, c AS (SELECT team1, team2, s1."WinPercentage"/nullif(s1."WinPercentage"+s2."WinPercentage", 0)*100 AS share
FROM pairs JOIN stats s1 ON s1."Team"=team1 JOIN stats s2 ON s2."Team"=team2)
SELECT team1, team2, round_even(share, 0)::BIGINT AS team1_share, 25::BIGINT AS draw_share,
round_even(100-share-25, 0)::BIGINT AS team2_share FROM c""")
def head_to_head(spark, sf_dir):
    return compare.head_to_head(_pairs(spark, sf_dir), _stats(spark, sf_dir))


@query(_PAIRED + """SELECT team1, team2, CASE WHEN s1."Points" IS NULL OR s2."Points" IS NULL THEN 'Close match expected'
WHEN s1."Points">s2."Points" THEN team1 WHEN s2."Points">s1."Points" THEN team2 ELSE 'Draw' END AS pick,
CASE WHEN s1."Points"=s2."Points" THEN 45 ELSE CASE WHEN abs(s1."Points"-s2."Points") > 15 THEN 80
ELSE 65+abs(s1."Points"-s2."Points") END END::BIGINT * (CASE WHEN s1."Points" IS NULL OR s2."Points" IS NULL THEN NULL ELSE 1 END) AS confidence
FROM pairs LEFT JOIN stats s1 ON s1."Team"=team1 LEFT JOIN stats s2 ON s2."Team"=team2""")
def points_pick(spark, sf_dir):
    return compare.points_pick(_pairs(spark, sf_dir), _stats(spark, sf_dir))
