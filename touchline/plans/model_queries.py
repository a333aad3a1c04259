"""Registered queries over splits, feature scores and trained models.

Model queries train on all rows.  ml_match_result, ml_full_features and ml_compare
train models of the library's full size; the others have fewer and shallower trees, so that a check of every
query ends in minutes.  Forests have no SQL counterpart; splits and scores do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.match_columns import feature_vectors
from touchline.operators import clean, feature_stats, league, metrics, models, splits
from touchline.plans.base_sql import CLEAN, MATCHES, q, text
from touchline.plans.registry import Registry
from touchline.plans.table_queries import full_features_sql, raw_table, request_table
from touchline.runtime import scratch_path, written_table
from touchline.schema import FEATURE_DESCRIPTIONS, FULL_FEATURES, HALF_TIME_FEATURES, STATS_FEATURES
from touchline.sources import star_tables, tables

REGISTRY = Registry()
query = REGISTRY.query

FULL_SETTINGS = models.Settings()
CHECK_SETTINGS = models.Settings(
    trees=10, depth=6, compare_depth=6, boost_rounds=3, boost_depth=3, ensemble_trees=10, ensemble_depth=6,
    grid_trees=(5, 10), grid_depths=(4, 5, 6),
)


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_tables.matches(spark, sf_dir)


def _table(spark, sf_dir, features, stratified=False) -> DataFrame:
    return models.training_table(_matches(spark, sf_dir), features, CHECK_SETTINGS.folds, stratified)


# --- splits and feature scores -------------------------------------------------------

@query(f"""WITH {MATCHES} SELECT "FTR" AS label, count(*) - (count(*) FILTER (WHERE t)) AS train_rows, (count(*) FILTER (WHERE t)) AS test_rows
FROM (SELECT "FTR", substr(md5(match_id || '|42'), 1, 8) < '33333333' AS t FROM matches) GROUP BY 1""")
def split_counts(spark, sf_dir):
    return splits.split_counts(splits.with_split(_matches(spark, sf_dir)), "FTR")


@query(f"""WITH {MATCHES}, drawn AS (SELECT "FTR", ('0x' || substr(md5(match_id || '|42'), 1, 15))::BIGINT AS draw FROM matches),
placed AS (SELECT *, row_number() OVER (PARTITION BY "FTR" ORDER BY draw) AS place, count(*) OVER (PARTITION BY "FTR") AS n FROM drawn),
cuts AS (SELECT "FTR", max(draw) AS cut FROM placed WHERE place <= ceil(n*0.2::DOUBLE) GROUP BY 1)
SELECT "FTR" AS label, (count(*) FILTER (WHERE draw > cut)) AS train_rows, (count(*) FILTER (WHERE draw <= cut)) AS test_rows
FROM drawn JOIN cuts USING ("FTR") GROUP BY 1""")
def split_counts_stratified(spark, sf_dir):
    keys = written_table(_matches(spark, sf_dir).select("match_id", "FTR"), "split-keys")
    return splits.split_counts(splits.with_stratified_split(keys, "FTR"), "FTR")


@query(f"""WITH {MATCHES}, drawn AS (SELECT "FTR", ('0x' || substr(md5(match_id || '|42'), 1, 15))::BIGINT AS draw,
  ('0x' || substr(md5(match_id || '|43'), 1, 15))::BIGINT AS deal FROM matches),
train AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "FTR" ORDER BY draw) AS place, count(*) OVER (PARTITION BY "FTR") AS n FROM drawn)
  WHERE place > ceil(n*0.2::DOUBLE)),
dealt AS (SELECT "FTR", row_number() OVER (PARTITION BY "FTR" ORDER BY deal) AS place, count(*) OVER (PARTITION BY "FTR") AS n FROM train)
SELECT "FTR" AS label, {' + '.join(f'(place > (n*{i} + 4)//5)::INTEGER' for i in range(1, 5))} AS fold, count(*) AS rows FROM dealt GROUP BY ALL""")
def fold_counts(spark, sf_dir):
    keys = written_table(_matches(spark, sf_dir).select("match_id", "FTR"), "split-keys")
    split = written_table(splits.with_stratified_split(keys, "FTR"), "split")
    return splits.fold_counts(splits.with_stratified_fold(split, 5, "FTR", among=~F.col("is_test")), "FTR")


_SCORES = f"""WITH {CLEAN}, full_ AS ({full_features_sql('cleaned', '0', '0', 'match_id, "FTR"')}),
long AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {i} AS position, {q(f)} AS x, " + '"FTR"' + " AS c FROM full_" for i, f in enumerate(FULL_FEATURES))}),
per AS (SELECT feature, position, c, count(*)::DOUBLE AS n, sum(x) AS s, sum(x*x) AS qq FROM long GROUP BY ALL),
tot AS (SELECT feature, position, count(*) AS k, sum(n) AS n, sum(s) AS s, sum(qq) AS qq, sum(s*s/n) AS e FROM per GROUP BY ALL),
f AS (SELECT feature, position, round(((e - s*s/n)/(k-1)) / nullif((qq-e)/(n-k), 0), 4) AS score FROM tot),
scores AS (SELECT feature, score, score IS NOT NULL AND row_number() OVER (ORDER BY score DESC NULLS LAST, position) <= 20 AS selected FROM f)"""


def _training_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_vectors(clean.clean_matches(raw_table(spark, sf_dir)), "train", "FTR")


@query(f"{_SCORES} SELECT * FROM scores")
def feature_scores(spark, sf_dir):
    return feature_stats.feature_scores(_training_features(spark, sf_dir), FULL_FEATURES, "FTR")


@query(f"{_SCORES} SELECT * FROM scores")
def roundtrip_scores(spark, sf_dir):
    scores = feature_stats.feature_scores(_training_features(spark, sf_dir), FULL_FEATURES, "FTR")
    path = tables.write_table(scores, scratch_path(spark, "feature-scores"), "csv")
    return spark.read.schema(scores.schema).csv(path, header=True)


@query(f"""{_SCORES}, d AS (SELECT * FROM (VALUES {', '.join(f"('{c}', {text(t)})" for c, t in FEATURE_DESCRIPTIONS.items())}) v(code, description))
SELECT code, description, score, selected FROM d LEFT JOIN scores ON feature = CASE code WHEN 'HTR' THEN 'HTR_encoded' ELSE code END""")
def feature_dictionary(spark, sf_dir):
    return feature_stats.feature_dictionary(_training_features(spark, sf_dir), FULL_FEATURES, "FTR")


# --- models ------------------------------------------------------------------------------

@query()
def ml_points(spark, sf_dir):
    table = models.points_table(league.team_features(_matches(spark, sf_dir)))
    model = models.train_points_model(table, CHECK_SETTINGS)
    scored = model.transform(models.test_rows(table))
    return metrics.regression_metrics(scored, F.col("TotalPoints"), F.col("prediction"))


@query()
def ml_match_result(spark, sf_dir):
    table = _table(spark, sf_dir, STATS_FEATURES)
    model = models.train_result_model(table, STATS_FEATURES, FULL_SETTINGS, models.grown_forest(FULL_SETTINGS))
    return metrics.classification_report(models.predicted(model, models.test_rows(table)))


@query()
def ml_full_features(spark, sf_dir):
    table = _table(spark, sf_dir, HALF_TIME_FEATURES)
    model = models.train_result_model(table, HALF_TIME_FEATURES, FULL_SETTINGS, models.grown_forest(FULL_SETTINGS))
    return metrics.accuracy(models.predicted(model, models.test_rows(table)))


@query()
def ml_compare(spark, sf_dir):
    result = models.compare_models(_table(spark, sf_dir, STATS_FEATURES, stratified=True), STATS_FEATURES, FULL_SETTINGS)
    rows = [(name, *score, name == result.best) for name, score in result.scores.items()]
    return spark.createDataFrame(rows, "model string, accuracy double, cv_mean double, cv_std double, best boolean")


@query()
def ml_cv(spark, sf_dir):
    table = models.train_rows(_table(spark, sf_dir, HALF_TIME_FEATURES, stratified=True))
    pipeline = models.result_pipeline(HALF_TIME_FEATURES, models.forest(CHECK_SETTINGS))
    cross = models.cross_validated(pipeline, table, CHECK_SETTINGS)
    return spark.createDataFrame([("RandomForest", *models.fold_scores(cross)[0])], "model string, cv_mean double, cv_std double")


@query()
def ml_grid(spark, sf_dir):
    records = models.grid_search(_table(spark, sf_dir, FULL_FEATURES, stratified=True), FULL_FEATURES, CHECK_SETTINGS)
    return spark.createDataFrame(records, (
        "maxDepth int, featureSubsetStrategy string, minInstancesPerNode int, minSamplesSplit int, numTrees int, "
        "cv_mean double, cv_std double, best boolean"))


@query()
def ml_ensemble(spark, sf_dir):
    table = _table(spark, sf_dir, HALF_TIME_FEATURES, stratified=True)
    pair = models.train_ensemble(table, HALF_TIME_FEATURES, CHECK_SETTINGS)
    votes = models.soft_vote(pair, models.test_rows(table))
    names = {"forest": "prediction_0", "unsampled_forest": "prediction_1", "ensemble": "prediction"}
    right = [F.avg((F.col(c) == F.col("FTR")).cast("double")).alias(n) for n, c in names.items()]
    better = F.when(F.col("forest") > F.col("unsampled_forest"), "forest").otherwise("unsampled_forest")
    return votes.agg(F.count(F.lit(1)).alias("rows"), *right).withColumn("better_single", better)


def _full_model(spark: SparkSession, sf_dir: str):
    return models.train_full_model(_table(spark, sf_dir, FULL_FEATURES, stratified=True), CHECK_SETTINGS)


@query()
def feature_importance(spark, sf_dir):
    """Written as a table of importances and read back, as reports do."""
    found = models.feature_importance(spark, _full_model(spark, sf_dir))
    path = tables.write_table(found, scratch_path(spark, "importances"), "csv")
    return spark.read.schema(found.schema).csv(path, header=True).orderBy(F.desc("importance"), "feature").limit(15)


@query()
def ml_score(spark, sf_dir):
    requests = star_tables.typed_requests(request_table(spark, sf_dir))
    return models.score_matches(_full_model(spark, sf_dir), requests)


@query()
def ml_contributions(spark, sf_dir):
    requests = star_tables.typed_requests(request_table(spark, sf_dir))
    return models.score_with_contributions(_full_model(spark, sf_dir), requests)


@query()
def ml_save_load(spark, sf_dir):
    """Predictions of a saved and reloaded model, counted against those of the original."""
    table = _table(spark, sf_dir, HALF_TIME_FEATURES)
    model = models.train_result_model(table, HALF_TIME_FEATURES, CHECK_SETTINGS)
    loaded = models.load_model(models.save_model(model, scratch_path(spark, "model")))
    first = models.predicted(model, models.test_rows(table)).select("match_id", F.col("prediction").alias("before"))
    both = models.predicted(loaded, models.test_rows(table)).select("match_id", "prediction").join(first, "match_id")
    return both.groupBy((F.col("before") == F.col("prediction")).alias("same")).agg(F.count(F.lit(1)).alias("rows"))


@query()
def ml_metadata(spark, sf_dir):
    table = _table(spark, sf_dir, HALF_TIME_FEATURES)
    model = models.train_result_model(table, HALF_TIME_FEATURES, CHECK_SETTINGS)
    score = models.accuracy_of(model, models.test_rows(table))
    row = models.model_metadata(spark, "RandomForest", "full_features_classifier", model, "2025-01-01T00:00:00", score)
    path = tables.write_table(row, scratch_path(spark, "model-metadata"), "json")
    return spark.read.schema(row.schema).json(path)
