"""Registered queries over chat messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.labels import TEAM_DISPLAY_NAMES, mapped
from touchline.operators import compare, league, messages
from touchline.plans.base_sql import GOALS, MATCHES, q, sides, table_sql, text
from touchline.plans.registry import Registry
from touchline.runtime import Lookup
from touchline.sources import star_tables

REGISTRY = Registry()
query = REGISTRY.query

# Nations stand in for clubs, so that messages about clubs find a table row.
CLUBS = {
    "NATION_0": "Arsenal", "NATION_1": "Man City", "NATION_2": "Liverpool", "NATION_3": "Man United",
    "NATION_4": "Tottenham", "NATION_5": "Newcastle", "NATION_6": "West Ham", "NATION_7": "Brighton",
}

# Sample questions, which the conversations table does not contain.
QUESTIONS = (
    "Who will win between Arsenal and Chelsea?",
    "Who will win between Arsenal and Liverpool?",
    "What's Arsenal's win rate?",
    "Compare Liverpool vs Manchester City",
    "Predict Man City v Tottenham",
    "Predict the next Manchester United match",
    "Show me the current table",
    "What are the stats?",
    "Tell me about Chelsea",
    "Tottenham news",
    "Which team has the best home record?",
)


def club_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = star_tables.matches(spark, sf_dir)
    return matches.withColumns({c: mapped(F.col(c), CLUBS) for c in ("HomeTeam", "AwayTeam")})


def _stats(spark: SparkSession, sf_dir: str) -> Lookup:
    return Lookup(league.team_stats(club_matches(spark, sf_dir)))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, the sample questions, and a question about every pair that has met."""
    samples = spark.createDataFrame([(-1, i, "user", t) for i, t in enumerate(QUESTIONS)], "conv_id bigint, turn bigint, role string, text string")
    pairs = compare.pairings(club_matches(spark, sf_dir))
    asked = pairs.select(
        F.lit(-2).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), F.lit("user").alias("role"),
        F.concat(F.lit("Who will win between "), "team1", F.lit(" and "), "team2", F.lit("?")).alias("text"),
    )
    stats = pairs.select(
        F.lit(-3).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), F.lit("user").alias("role"),
        F.concat(F.lit("What are the stats of "), "team1", F.lit("?")).alias("text"),
    )
    return star_tables.conversations(spark, sf_dir).unionByName(samples).unionByName(asked).unionByName(stats)


# --- SQL --------------------------------------------------------------------------

_CLUB_CASE = {c: f"CASE {q(c)} " + " ".join(f"WHEN '{n}' THEN {text(v)}" for n, v in CLUBS.items()) + f" ELSE {q(c)} END" for c in ("HomeTeam", "AwayTeam")}

CHAT = f"""{MATCHES},
club AS (SELECT * REPLACE ({', '.join(f'{case} AS {q(c)}' for c, case in _CLUB_CASE.items())}) FROM matches),
stats AS ({table_sql(sides('club', GOALS))}),
pairs AS (SELECT DISTINCT "HomeTeam" AS team1, "AwayTeam" AS team2 FROM club),
chat AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT * FROM (VALUES {', '.join(f"(-1, {i}, 'user', {text(t)})" for i, t in enumerate(QUESTIONS))}) v
  UNION ALL SELECT -2, 0, 'user', 'Who will win between ' || team1 || ' and ' || team2 || '?' FROM pairs
  UNION ALL SELECT -3, 0, 'user', 'What are the stats of ' || team1 || '?' FROM pairs)"""


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(lower(text), {text(w)})" for w in words) + ")"


_INTENT = f"""CASE WHEN {_any(messages.PREDICTION_WORDS)} THEN CASE WHEN {_any(messages.PAIR_WORDS)} THEN 'prediction' ELSE 'prediction_help' END
WHEN {_any(messages.STATS_WORDS)} THEN 'team_stats' WHEN {_any(messages.TEAM_WORDS)} THEN 'team_info' WHEN {_any(messages.TABLE_WORDS)} THEN 'table' ELSE 'default' END"""

_FOUND = "[x FOR x IN [" + ", ".join(
    f"CASE WHEN contains(lower(text), {text(s)}) THEN {text(name)} END" for s, name in messages.TEAM_SPELLINGS.items()
) + "] IF x IS NOT NULL]"

_ROUTED = f"""WITH {CHAT},
routed AS (SELECT row_number() OVER () AS rn, conv_id, turn, role, text, {_INTENT} AS intent, {_FOUND} AS found FROM chat)"""

_RATE = '("Wins"::DOUBLE/greatest("Wins"+"Draws"+"Losses", 1)*100)'
_RATE_TEXT = f"printf('%.1f%% win rate', round_even({_RATE}*10, 0)/10)"


def _band(low: str) -> str:
    return f"CASE WHEN {_RATE}>60 THEN 'Excellent' WHEN {_RATE}>40 THEN 'Good' ELSE {text(low)} END"


_HITS = f"""hits AS (SELECT rn, s.* FROM (SELECT rn, s."Team" AS t, row_number() OVER (PARTITION BY rn ORDER BY s."Points" DESC, s."Team") AS place
  FROM routed JOIN stats s ON contains(lower(text), lower(s."Team"))) JOIN stats s ON s."Team"=t WHERE place=1),
cards AS (SELECT rn, "Team", '⚽ **' || "Team" || ' Statistics:**' || chr(10) || chr(10) || '• Points: ' || "Points" || chr(10) || '• Wins: ' || "Wins"
  || chr(10) || '• Draws: ' || "Draws" || chr(10) || '• Losses: ' || "Losses" || chr(10) || '• Goals For: ' || "GoalsFor"::BIGINT
  || chr(10) || '• Goals Against: ' || "GoalsAgainst"::BIGINT || chr(10) || chr(10) || '**Current Form:** ' || {_band('Needs Improvement')} || ' (' || {_RATE_TEXT} || ')' AS stats_card,
  '⚽ **' || "Team" || '''s Form:** ' || {_band('Inconsistent')} || ' - ' || "Wins" || ' wins in ' || ("Wins"+"Draws"+"Losses")
  || ' matches (' || {_RATE_TEXT} || '). Current points: ' || "Points" AS form_card FROM hits)"""

_DISPLAY = "CASE \"Team\" " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in TEAM_DISPLAY_NAMES.items()) + " ELSE \"Team\" END"

_HEADER = "'⚽ **Match Prediction: ' || found[1] || ' vs ' || found[2] || '**' || chr(10) || chr(10)"
_PREDICTION = f"""CASE WHEN len(found)<2 THEN {text(messages.ASK_TWO_TEAMS)}
WHEN s1."Points" IS NULL OR s2."Points" IS NULL THEN {_HEADER} || '**Prediction:** Close match expected' || chr(10) || chr(10)
  || '**Reasoning:** Both teams have competitive records. Use the AI Predictions page for detailed statistical analysis.'
ELSE {_HEADER} || '**Recent Performance:**' || chr(10)
  || '• ' || found[1] || ': ' || s1."Points" || ' points, ' || s1."Wins" || ' wins' || chr(10)
  || '• ' || found[2] || ': ' || s2."Points" || ' points, ' || s2."Wins" || ' wins' || chr(10) || chr(10) || '**Prediction:** '
  || CASE WHEN s1."Points">s2."Points" THEN found[1] WHEN s2."Points">s1."Points" THEN found[2] ELSE 'Draw' END || ' ('
  || CASE WHEN s1."Points"=s2."Points" THEN 45 ELSE least(65+abs(s1."Points"-s2."Points"), 80) END || '% confidence)' || chr(10) || chr(10)
  || '**Reasoning:** Based on current points and recent form analysis.' END"""


def _club_reply(club: str) -> str:
    with_row, without_row = messages.CLUB_CARDS[club]
    one = f'(SELECT max("{{0}}") FROM stats WHERE "Team"={text(club)})'
    return f"""WHEN contains(lower(text), {text(club.lower())}) THEN coalesce('⚽ **{club}:** Currently ' || {one.format('Points')} || ' points with ' ||
      {one.format('Wins')} || ' wins. ' || {text(with_row)}, {text(f'⚽ **{club}:** {without_row}')})"""


_CLUBS_SQL = "CASE " + " ".join(_club_reply(c) for c in messages.CLUB_CARDS) + f" ELSE {text(messages.ASK_CLUB)} END"
_TOP5 = """top5 AS (SELECT row_number() OVER (ORDER BY "Points" DESC, "Team") AS place, * FROM stats ORDER BY "Points" DESC, "Team" LIMIT 5),
texts AS (SELECT '⚽ **Current Top 5 Teams:**' || chr(10) || chr(10) || string_agg(place || '. ' || "Team" || ': ' || "Points" || ' points (' || "Wins" || 'W-' ||
  "Draws" || 'D-' || "Losses" || 'L)' || chr(10), '' ORDER BY place) || chr(10) || 'Would you like detailed stats for any specific team?' AS top_text,
  string_agg("Team", ', ' ORDER BY place) AS names FROM top5)"""


@query(f"{_ROUTED} SELECT conv_id, turn, role, intent FROM routed")
def message_intents(spark, sf_dir):
    return messages.with_intent(chat(spark, sf_dir)).select("conv_id", "turn", "role", "intent")


@query(f"{_ROUTED} SELECT role, intent, count(*) AS messages FROM routed GROUP BY 1, 2")
def intent_counts(spark, sf_dir):
    return messages.intent_counts(chat(spark, sf_dir))


@query(f"{_ROUTED} SELECT conv_id, turn, role, len(found)::INTEGER AS found_teams, found[1] AS team1, found[2] AS team2 FROM routed")
def message_teams(spark, sf_dir):
    return messages.with_teams(chat(spark, sf_dir)).drop("text")


@query(f"{_ROUTED}, {_HITS} SELECT conv_id, turn, role, \"Team\", stats_card, form_card FROM routed JOIN cards USING (rn)")
def message_team_stats(spark, sf_dir):
    return messages.message_team_stats(chat(spark, sf_dir), _stats(spark, sf_dir))


@query(f"""{_ROUTED}, {_HITS}, {_TOP5}, shown AS (SELECT {_DISPLAY} AS name, * FROM stats)
SELECT conv_id, turn, role, intent, CASE intent WHEN 'prediction' THEN {_PREDICTION}
  WHEN 'prediction_help' THEN {text(messages.ASK_PREDICTION)}
  WHEN 'team_stats' THEN coalesce(stats_card, {text(messages.ASK_TEAM)} || (SELECT names FROM texts))
  WHEN 'team_info' THEN {_CLUBS_SQL}
  WHEN 'table' THEN (SELECT top_text FROM texts) ELSE {text(messages.HELP)} END AS reply
FROM routed LEFT JOIN shown s1 ON s1.name=found[1] LEFT JOIN shown s2 ON s2.name=found[2] LEFT JOIN cards USING (rn)""")
def message_answers(spark, sf_dir):
    return messages.answers(chat(spark, sf_dir), _stats(spark, sf_dir))
