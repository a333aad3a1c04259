"""Registered queries over prediction requests: checks, rule scores, JSON, stream, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.labels import HALF_TIME_LABELS, RESULT_LABELS
from touchline.functions.validation import FIELD_LIMITS, merged_stat_errors, range_errors, stat_errors, with_numbers
from touchline.operators import envelopes, league, metrics, scoring
from touchline.plans.base_sql import MATCHES, REQUEST_MEASURES, REQUESTS, q, stats_cte, text
from touchline.plans.registry import Registry
from touchline.plans.table_queries import request_table
from touchline.runtime import Lookup, scratch_path, written_table
from touchline.schema import HALF_TIME_GOALS, MATCH_STATS, RESULT_CODES
from touchline.sources import star_tables, tables
from touchline.streaming import score_stream as streaming
from touchline.streaming.live_table import LiveTable, start_live_table

REGISTRY = Registry()
query = REGISTRY.query

STAMP = "2025-01-01T00:00:00"


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_tables.matches(spark, sf_dir)


def _stats(spark: SparkSession, sf_dir: str) -> Lookup:
    return Lookup(league.team_stats(_matches(spark, sf_dir)))


def _unknown_teams(matches: DataFrame) -> DataFrame:
    """The same matches between teams no table has, so that every band occurs."""
    return matches.withColumns({c: F.concat(F.lit("Unknown "), c) for c in ("HomeTeam", "AwayTeam")})


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_table(spark, sf_dir)


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes.accepted(_requests(spark, sf_dir))


# --- request checks -------------------------------------------------------------

def _number(c: str) -> str:
    return f"try_cast({q(c)} AS DOUBLE)"


def _messages(cases: list[str]) -> str:
    return f"[x FOR x IN [{', '.join(cases)}] IF x IS NOT NULL]"


_STAT_ERRORS = _messages([
    f"CASE WHEN {q(c)} IS NULL THEN 'Missing field: {c}' WHEN {_number(c)} IS NULL THEN '{c} must be a number' "
    f"WHEN {_number(c)}<0 THEN '{c} cannot be negative' END" for c in MATCH_STATS
])
_MERGED_ERRORS = _messages([
    f"CASE WHEN {q(c)} IS NULL THEN 'Missing field: {c}' WHEN {_number(c)} IS NULL OR {_number(c)}<0 "
    f"THEN '{c} must be a non-negative number' END" for c in MATCH_STATS
])
_RANGE_ERRORS = _messages([
    f"CASE WHEN {_number(c)}<0 OR {_number(c)}>{FIELD_LIMITS[c]} THEN '{c} out of range' END" for c in MATCH_STATS + HALF_TIME_GOALS
])
_HOME, _AWAY = ("CASE WHEN trim(\"%s\")<>'' THEN \"%s\" END" % (c, c) for c in ("HomeTeam", "AwayTeam"))
_TEAM_ERRORS = _messages([
    f"CASE WHEN ({_HOME}) IS NULL OR ({_AWAY}) IS NULL THEN 'Please select both teams' "
    f"WHEN \"HomeTeam\"=\"AwayTeam\" THEN 'Please select different teams' END"
])


@query(f"""WITH {REQUESTS}, e AS (SELECT match_id, {_STAT_ERRORS} AS errors, {_MERGED_ERRORS} AS merged FROM requests)
SELECT match_id, array_to_string(errors, '; ') AS errors, array_to_string(merged, '; ') AS merged_errors, len(errors)::INTEGER AS n_errors FROM e""")
def validate_matches(spark, sf_dir):
    checked = with_numbers(_requests(spark, sf_dir)).withColumns({"errors": stat_errors(), "merged": merged_stat_errors()})
    return checked.select(
        "match_id", F.array_join("errors", "; ").alias("errors"),
        F.array_join("merged", "; ").alias("merged_errors"), F.size("errors").alias("n_errors"),
    )


@query(f"""WITH {REQUESTS}, e AS (SELECT match_id, {_RANGE_ERRORS} AS errors FROM requests)
SELECT match_id, array_to_string(errors, '; ') AS errors FROM e WHERE len(errors) > 0""")
def range_violations(spark, sf_dir):
    bad = with_numbers(_requests(spark, sf_dir)).select("match_id", range_errors().alias("errors")).where(F.size("errors") > 0)
    return bad.select("match_id", F.array_join("errors", "; ").alias("errors"))


_CHECKED = REQUESTS + f""",
marked AS (SELECT *, {_TEAM_ERRORS} AS te, {_STAT_ERRORS} AS se, {_RANGE_ERRORS} AS re FROM requests),
checked AS (SELECT *, list_concat(list_concat(te, se), re) AS errors,
  CASE WHEN len(te)>0 THEN 'MISSING_TEAM' WHEN len(se)>0 THEN 'INVALID_STATS' WHEN len(re)>0 THEN 'OUT_OF_RANGE' END AS error_code FROM marked)"""


@query(f"""WITH {_CHECKED} SELECT match_id, array_to_string(errors, '; ') AS errors, error_code FROM checked WHERE error_code IS NOT NULL""")
def rejects(spark, sf_dir):
    bad = envelopes.rejects(_requests(spark, sf_dir))
    return bad.select("match_id", F.array_join("errors", "; ").alias("errors"), "error_code")


@query(f"""WITH {_CHECKED} SELECT match_id, false AS success, errors[1] AS error, error_code, len(errors)::INTEGER AS n_details,
'{STAMP}' AS timestamp FROM checked WHERE error_code IS NOT NULL""")
def error_json(spark, sf_dir):
    envelope = envelopes.error_envelopes(envelopes.rejects(_requests(spark, sf_dir)), "match_id", STAMP)
    parsed = envelope.select("match_id", F.from_json(
        "json", "success boolean, error string, timestamp string, error_code string, details array<string>").alias("r"))
    return parsed.select("match_id", "r.success", "r.error", "r.error_code", F.size("r.details").alias("n_details"), "r.timestamp")


_JSON_FIELDS = ("Date", "HomeTeam", "AwayTeam", "HTR") + REQUEST_MEASURES


@query(f"""WITH {REQUESTS} SELECT match_id, ({' + '.join(f"(CASE WHEN {q(c)}::VARCHAR IS NOT NULL AND {q(c)}::VARCHAR<>'' THEN 1 ELSE 0 END)" for c in _JSON_FIELDS)})::INTEGER AS n_fields,
"Date"::VARCHAR AS day, "HS" AS hs, nullif("AR", '') AS ar, "AwayTeam" AS away_team FROM requests""")
def json_pruned(spark, sf_dir):
    pruned = envelopes.pruned_json(_requests(spark, sf_dir), "match_id")
    names = {"day": "Date", "hs": "HS", "ar": "AR", "away_team": "AwayTeam"}
    return pruned.select(
        "match_id", F.size(F.json_object_keys("json")).alias("n_fields"),
        *[F.get_json_object("json", f"$.{field}").alias(name) for name, field in names.items()],
    )


# --- rule scorer ----------------------------------------------------------------

def _scored_sql(source: str, keep: tuple[str, ...] = ()) -> str:
    """CTEs rating the rows of ``source`` with the league table ``stats``."""
    a, b, c, d = (f"{w}::DOUBLE" for w in scoring.MATCH_WEIGHTS)
    bands = {name: dict(zip(("code", "H", "D", "A"), row)) for name, row in scoring.BANDS.items()}

    def pick(key: str) -> str:
        def value(name: str) -> str:
            v = bands[name][key]
            return f"'{v}'" if key == "code" else f"{v}::DOUBLE"
        return (f"CASE WHEN diff>15 THEN {value('clear home')} WHEN diff<-10 THEN {value('clear away')} "
                f"WHEN abs(diff)<=5 THEN {value('level')} WHEN diff>0 THEN {value('home')} ELSE {value('away')} END")

    def team(side: str, alias: str, row: dict) -> str:
        return ", ".join(f"CASE WHEN hs_.\"Team\" IS NOT NULL AND as_.\"Team\" IS NOT NULL THEN {alias}.{q(c)} ELSE {v} END AS {side}_{c}" for c, v in row.items())

    numbers = ", ".join(f"coalesce(f.{q(c)}, 0.0::DOUBLE) AS {q(c)}" for c in MATCH_STATS + HALF_TIME_GOALS)
    kept = "".join(f", f.{q(c)}" for c in keep)
    return f"""
looked AS (SELECT f.match_id{kept}, f."HomeTeam", f."AwayTeam", coalesce(f."HTR", 'D') AS "HTR", {numbers},
    {team('home', 'hs_', scoring.DEFAULT_HOME)}, {team('away', 'as_', scoring.DEFAULT_AWAY)},
    hs_."Team" IS NOT NULL AND as_."Team" IS NOT NULL AS both_known
  FROM {source} f LEFT JOIN stats hs_ ON hs_."Team"=f."HomeTeam" LEFT JOIN stats as_ ON as_."Team"=f."AwayTeam"),
rated AS (SELECT *, "HS"*{a} + "HST"*{b} + "HC"*{c} + "HTHG"*{d} AS hm, "AS"*{a} + "AST"*{b} + "AC"*{c} + "HTAG"*{d} AS am,
    CASE WHEN both_known THEN "home_Points" + ("home_GoalsFor"-"home_GoalsAgainst")*0.1::DOUBLE ELSE 60.0::DOUBLE END AS h0,
    CASE WHEN both_known THEN "away_Points" + ("away_GoalsFor"-"away_GoalsAgainst")*0.1::DOUBLE ELSE 55.0::DOUBLE END AS a0,
    CASE "HTR" WHEN 'H' THEN 10 WHEN 'A' THEN -10 ELSE 0 END AS swing FROM looked),
banded AS (SELECT *, (((h0 + hm) + 5) + swing) - (a0 + am) AS diff,
    greatest(round_even("HTHG" + hm/10, 0), 0)::BIGINT AS home_goals, greatest(round_even("HTAG" + am/10, 0), 0)::BIGINT AS away_goals FROM rated),
scored AS (SELECT *, {pick('code')} AS prediction, {pick('H')} AS "prob_H", {pick('D')} AS "prob_D", {pick('A')} AS "prob_A",
    home_goals || '-' || away_goals AS predicted_score FROM banded)"""


_CONFIDENCE = 'round_even(greatest("prob_H", "prob_D", "prob_A")*100, 1) AS confidence'
_SCORES = f'SELECT match_id, prediction, {_CONFIDENCE}, "prob_H", "prob_D", "prob_A", predicted_score FROM scored'
_RESULTS = ("FTR", "FTHG", "FTAG")
_SCORED_MATCHES = f"WITH {MATCHES}, {stats_cte()}, {_scored_sql('matches', _RESULTS)} "
_UNKNOWN = """unknown AS (SELECT * REPLACE ('Unknown ' || "HomeTeam" AS "HomeTeam", 'Unknown ' || "AwayTeam" AS "AwayTeam") FROM matches)"""
_SCORED_UNKNOWN = f"WITH {MATCHES}, {stats_cte()}, {_UNKNOWN}, {_scored_sql('unknown', _RESULTS)} "
_TYPED = ", ".join(f"{_number(c)} AS {q(c)}" for c in REQUEST_MEASURES)
_SCORED_REQUESTS = f"""WITH {_CHECKED}, matches AS (SELECT * FROM keyed), {stats_cte()},
accepted AS (SELECT match_id, "HomeTeam", "AwayTeam", "HTR", {_TYPED} FROM checked WHERE error_code IS NULL), {_scored_sql('accepted')} """


@query(_SCORED_MATCHES + _SCORES)
def score_fixtures(spark, sf_dir):
    return scoring.score_fixtures(_matches(spark, sf_dir), _stats(spark, sf_dir))


@query(_SCORED_UNKNOWN + _SCORES)
def score_unknown_teams(spark, sf_dir):
    return scoring.score_fixtures(_unknown_teams(_matches(spark, sf_dir)), _stats(spark, sf_dir))


@query(_SCORED_REQUESTS + _SCORES)
def score_requests(spark, sf_dir):
    return scoring.score_fixtures(_accepted(spark, sf_dir), _stats(spark, sf_dir))


@query(_SCORED_MATCHES + _SCORES)
def score_stream(spark, sf_dir):
    fixtures, scored, checkpoint = (scratch_path(spark, f"stream-{part}") for part in ("in", "out", "log"))
    _matches(spark, sf_dir).write.parquet(fixtures)
    schema = spark.read.parquet(fixtures).schema
    arriving = streaming.fixture_stream(spark, fixtures, schema)
    streaming.start_scoring(arriving, _stats(spark, sf_dir), scored, checkpoint).awaitTermination()
    return spark.read.parquet(scored)


#: Three batches of matches by the first letter of a digest; a sixteenth of them, by the second, are fixtures yet to be played.
_BATCHES = ("01234", "56789", "abcdef")
_BATCH_SQL = "CASE " + " ".join(f"WHEN substr(md5(match_id), 1, 1) IN ({', '.join(text(c) for c in letters)}) THEN {i}" for i, letters in enumerate(_BATCHES)) + " END"
_PLAYED = f"""WITH {MATCHES}, dealt AS (SELECT *, {_BATCH_SQL} AS batch, substr(md5(match_id), 2, 1) = '0' AS fixture FROM matches)"""


def _live_table(spark, sf_dir) -> LiveTable:
    arriving, root, checkpoint = (scratch_path(spark, f"live-{part}") for part in ("in", "table", "log"))
    digest = F.md5("match_id")
    rows = _matches(spark, sf_dir).withColumn("FTR", F.when(F.substring(digest, 2, 1) != "0", F.col("FTR")))
    rows = written_table(rows, "live-matches")
    for letters in _BATCHES:
        rows.where(F.substring(digest, 1, 1).isin(*letters)).write.mode("append").parquet(arriving)
        stream = streaming.fixture_stream(spark, arriving, rows.schema, files_per_batch=1_000_000)
        start_live_table(stream, root, checkpoint).awaitTermination()
    return LiveTable(spark, root)


@query(f"{_PLAYED}, played AS (SELECT * FROM dealt WHERE NOT fixture), {stats_cte('played')} SELECT * FROM stats")
def live_table(spark, sf_dir):
    return _live_table(spark, sf_dir).stats(len(_BATCHES) - 1)


_SCORED_BATCHES = " UNION ALL ".join(
    f"""SELECT *, {i} AS batch FROM (WITH played AS (SELECT * FROM dealt WHERE NOT fixture AND batch <= {i}), {stats_cte('played')},
  awaited AS (SELECT * FROM dealt WHERE fixture AND batch = {i}), {_scored_sql('awaited')} {_SCORES})""" for i in range(len(_BATCHES)))


@query(f"{_PLAYED} {_SCORED_BATCHES}")
def live_scores(spark, sf_dir):
    return _live_table(spark, sf_dir).scores()


def _label_sql(names: dict[str, str], value: str, otherwise: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN {text(v)}" for k, v in names.items()) + f" ELSE {otherwise} END"


def _form_sql(side: str) -> str:
    return f"\"{side}_Wins\" || 'W-' || \"{side}_Draws\" || 'D-' || \"{side}_Losses\" || 'L' AS {side}_form"


@query(_SCORED_REQUESTS + f"""SELECT match_id, true AS success, "HomeTeam" || ' vs ' || "AwayTeam" AS title,
{_label_sql(RESULT_LABELS, 'prediction', 'prediction')} AS outcome, {_CONFIDENCE}, predicted_score, "prob_H", "prob_D", "prob_A",
"home_Points"::BIGINT AS home_points, "away_Points"::BIGINT AS away_points, {_form_sql('home')}, {_form_sql('away')},
"HS"::BIGINT || ' - ' || "AS"::BIGINT AS total_shots, "HST"::BIGINT || ' - ' || "AST"::BIGINT AS on_target,
"HTHG"::BIGINT || '-' || "HTAG"::BIGINT AS halftime_score, {_label_sql(HALF_TIME_LABELS, '"HTR"', "'Level'")} AS halftime_label FROM scored""")
def prediction_json(spark, sf_dir):
    responses = envelopes.prediction_responses(_accepted(spark, sf_dir), _stats(spark, sf_dir))
    return envelopes.result_cards(responses)


@query(_SCORED_MATCHES + f"""SELECT match_id, true AS success, prediction, "prob_H", "prob_D", "prob_A", '{STAMP}' AS timestamp,
"HS" AS input_hs, 'rules' AS model FROM scored""")
def prediction_envelopes(spark, sf_dir):
    rated = scoring.rate_fixtures(_matches(spark, sf_dir), _stats(spark, sf_dir))
    envelope = envelopes.prediction_envelope(rated, "match_id", STAMP, MATCH_STATS, {"model": "rules"})
    parsed = envelope.select("match_id", F.from_json(
        "json", "success boolean, prediction string, probabilities map<string, double>, timestamp string, "
        "input_data struct<HS: double>, metadata struct<model: string>").alias("r"))
    return parsed.select(
        "match_id", "r.success", "r.prediction",
        *[F.try_element_at("r.probabilities", F.lit(c)).alias(f"prob_{c}") for c in "HDA"],
        "r.timestamp", F.col("r.input_data.HS").alias("input_hs"), F.col("r.metadata.model").alias("model"),
    )


@query(_SCORED_MATCHES + _SCORES)
def export_predictions(spark, sf_dir):
    scored = score_fixtures(spark, sf_dir)
    path = tables.export_predictions(scored, scratch_path(spark, "exports"))
    return spark.read.option("header", True).schema(scored.schema).csv(path)


# --- evaluation of the rules ------------------------------------------------------

def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rate_fixtures(_unknown_teams(_matches(spark, sf_dir)), _stats(spark, sf_dir))


@query(_SCORED_MATCHES + """SELECT (count(*) FILTER (WHERE "HTR"="FTR"))*100.0::DOUBLE/count(*) AS half_time_accuracy,
(count(*) FILTER (WHERE prediction="FTR"))*100.0::DOUBLE/count(*) AS full_time_accuracy, count(*) AS total_predictions,
(count(*) FILTER (WHERE prediction="FTR")) AS correct_predictions FROM scored""")
def accuracy_summary(spark, sf_dir):
    return scoring.accuracy_summary(_matches(spark, sf_dir), _stats(spark, sf_dir))


@query(_SCORED_UNKNOWN + """SELECT count(*) AS rows, sum(CASE WHEN "FTR"=prediction THEN 1.0::DOUBLE ELSE 0.0 END)/count(*) AS accuracy FROM scored""")
def accuracy(spark, sf_dir):
    return metrics.accuracy(_judged(spark, sf_dir))


@query(_SCORED_UNKNOWN + f"""SELECT "FTR" AS label, {', '.join(f"(count(*) FILTER (WHERE prediction='{c}')) AS {q(c)}" for c in RESULT_CODES)}
FROM scored GROUP BY 1""")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_judged(spark, sf_dir))


@query(_SCORED_UNKNOWN + """, per AS (SELECT c, (count(*) FILTER (WHERE "FTR"=c AND prediction=c))::DOUBLE AS hit,
  (count(*) FILTER (WHERE prediction=c))::DOUBLE AS said, (count(*) FILTER (WHERE "FTR"=c))::DOUBLE AS truth
  FROM scored, (SELECT unnest(['A','D','H']) AS c) GROUP BY c),
pr AS (SELECT *, coalesce(hit/nullif(said,0), 0) AS p, coalesce(hit/nullif(truth,0), 0) AS r FROM per),
f AS (SELECT *, coalesce(p*r*2/nullif(p+r,0), 0) AS f1 FROM pr),
report AS (SELECT c AS class, p, r, f1, truth FROM f
  UNION ALL SELECT 'accuracy', sum(hit)/sum(truth), sum(hit)/sum(truth), sum(hit)/sum(truth), sum(truth) FROM f
  UNION ALL SELECT 'macro avg', sum(p)/3, sum(r)/3, sum(f1)/3, sum(truth) FROM f
  UNION ALL SELECT 'weighted avg', sum(p*truth)/sum(truth), sum(r*truth)/sum(truth), sum(f1*truth)/sum(truth), sum(truth) FROM f)
SELECT class, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1, truth::BIGINT AS support FROM report""")
def classification_report(spark, sf_dir):
    return metrics.classification_report(_judged(spark, sf_dir))


@query(_SCORED_UNKNOWN + """, e AS (SELECT "FTHG"+"FTAG" AS y, (home_goals+away_goals)::DOUBLE AS g FROM scored)
SELECT count(*) AS rows, sum(abs(y-g))/count(*) AS mae, 1 - sum((y-g)*(y-g))/(sum(y*y) - sum(y)*sum(y)/count(*)) AS r2 FROM e""")
def regression_metrics(spark, sf_dir):
    rows = _judged(spark, sf_dir)
    return metrics.regression_metrics(rows, F.col("FTHG") + F.col("FTAG"), F.col("home_goals") + F.col("away_goals"))
