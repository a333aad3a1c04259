"""Registered queries that write files and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.match_columns import with_match_features
from touchline.functions.parsing import parse_date
from touchline.operators import clean, league
from touchline.plans.base_sql import CLEAN, MATCHES, RAW, columns, q, stats_cte
from touchline.plans.registry import Registry
from touchline.plans.table_queries import FEATURES_SQL, raw_table
from touchline.runtime import scratch_path
from touchline.schema import FULL_FEATURES, MATCH_COLUMNS, RESULT_CODES
from touchline.sources import csv_files, star_tables, tables

REGISTRY = Registry()
query = REGISTRY.query


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_matches(raw_table(spark, sf_dir))


def _write_seasons(raw: DataFrame, folder: str) -> None:
    """One file set per year: 1996 with its columns reversed, 1995 without fouls."""
    rows = raw.select(*MATCH_COLUMNS, F.year(parse_date(F.col("Date"))).alias("year"))
    no_fouls = [c for c in MATCH_COLUMNS if c not in ("HF", "AF")]
    rows.where("year = 1996").select(*reversed(MATCH_COLUMNS)).write.csv(f"{folder}/reversed", header=True)
    rows.where("year = 1995").select(*no_fouls).write.csv(f"{folder}/no_fouls", header=True)
    rest = rows.where("year IS NULL OR year NOT IN (1995, 1996)")
    rest.write.partitionBy("year").csv(f"{folder}/seasons", header=True)


_YEAR = "coalesce(try_strptime(\"Date\", '%Y-%m-%d'), try_strptime(\"Date\", '%d/%m/%Y'))"


@query(f"""WITH {CLEAN}, d AS (SELECT *, year({_YEAR.replace('"Date"', 'raw_day')}) AS y FROM (SELECT c.*, r."Date" AS raw_day FROM
  (SELECT row_number() OVER (ORDER BY match_id, k, "FTHG") AS i, * FROM cleaned) c JOIN
  (SELECT row_number() OVER (ORDER BY match_id, k, "FTHG"::INTEGER) AS i, * FROM raw WHERE "AwayTeam" IS NOT NULL) r USING (i)))
SELECT * EXCLUDE (match_id, k, i, raw_day, y) REPLACE (CASE WHEN y=1995 THEN 0 ELSE "HF" END AS "HF", CASE WHEN y=1995 THEN 0 ELSE "AF" END AS "AF") FROM d""")
def csv_scan_union(spark, sf_dir):
    folder = scratch_path(spark, "seasons")
    _write_seasons(raw_table(spark, sf_dir), folder)
    return clean.clean_matches(csv_files.scan_season_files(spark, folder).matches)


def _write_damaged(raw: DataFrame, folder: str) -> None:
    """Text files with a header each: sixteenths of the rows are too long or cut, a sixteenth is under a strange header."""
    spark, digest = raw.sparkSession, F.md5("match_id")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = [F.coalesce(c, F.lit("")) for c in MATCH_COLUMNS]
    line = (
        F.when(F.substring(digest, 1, 1) == "0", F.concat_ws(",", *values, F.lit("more")))
        .when(F.substring(digest, 1, 1) == "1", F.concat_ws(",", *values[:5]))
        .otherwise(F.concat_ws(",", *values)))
    kind = F.when(F.substring(digest, 2, 1) == "0", "strange").otherwise("season")
    rows = raw.select(kind.alias("kind"), F.pmod(F.crc32(F.col("match_id").cast("binary")), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("place"), line.alias("value"))
    headers = rows.select("kind", "part").distinct().select(
        "kind", "part", F.lit(0).alias("place"), F.when(F.col("kind") == "strange", "x,y").otherwise(",".join(MATCH_COLUMNS)).alias("value"))
    dealt = headers.unionByName(rows).repartition(parts, "kind", "part").sortWithinPartitions("kind", "part", "place")
    dealt.drop("place").write.partitionBy("kind", "part").text(folder)


_LINE = ", ".join(f"coalesce({q(c)}, '')" for c in MATCH_COLUMNS)
_CUT = ", ".join(f"coalesce({q(c)}, '')" for c in MATCH_COLUMNS[:5])


@query(f"""WITH {RAW}, d AS (SELECT *, substr(md5(match_id), 1, 1) AS h, substr(md5(match_id), 2, 1) = '0' AS strange FROM raw),
lines AS (SELECT 'season' AS kind, CASE h WHEN '0' THEN concat_ws(',', {_LINE}, 'more') ELSE concat_ws(',', {_CUT}) END AS record,
  CASE h WHEN '0' THEN '{len(MATCH_COLUMNS) + 1} fields instead of {len(MATCH_COLUMNS)}' ELSE '5 fields instead of {len(MATCH_COLUMNS)}' END AS error FROM d WHERE h IN ('0', '1') AND NOT strange)
SELECT kind, record, error, count(*) AS rows FROM lines GROUP BY ALL
UNION ALL SELECT DISTINCT 'strange', NULL, 'no known column in the header', NULL::BIGINT FROM d WHERE strange""")
def csv_rejects(spark, sf_dir):
    folder = scratch_path(spark, "damaged")
    _write_damaged(raw_table(spark, sf_dir), folder)
    scan = csv_files.scan_season_files(spark, folder, suffix=".txt", long_rows="row", short_rows="reject")
    kind = F.regexp_extract("path", "kind=([a-z]+)", 1).alias("kind")
    lines = F.count("record")
    return scan.rejected.groupBy(kind, "record", "error").agg(F.when(lines > 0, lines).alias("rows"))


@query(f"WITH {CLEAN} SELECT match_id, {columns(MATCH_COLUMNS)} FROM cleaned")
def roundtrip_combined(spark, sf_dir):
    path = tables.write_table(_cleaned(spark, sf_dir), scratch_path(spark, "combined"))
    return tables.read_table(spark, path)


@query(f"WITH {CLEAN} SELECT match_id, {columns(MATCH_COLUMNS)}, {FEATURES_SQL} FROM cleaned")
def roundtrip_features(spark, sf_dir):
    path = tables.write_features(with_match_features(_cleaned(spark, sf_dir)), scratch_path(spark, "features"))
    return tables.read_table(spark, path)


@query(f"WITH {MATCHES}, {stats_cte()} SELECT * FROM stats")
def roundtrip_team_stats(spark, sf_dir):
    stats = league.team_stats(star_tables.matches(spark, sf_dir))
    return tables.read_team_stats(spark, tables.write_table(stats, scratch_path(spark, "team-stats")))


@query(f"""WITH {CLEAN}, {stats_cte('cleaned')} SELECT 'match_result' AS model_type, {len(FULL_FEATURES)} AS n_features, '{','.join(RESULT_CODES)}' AS classes,
count(*) AS rows, {len(MATCH_COLUMNS) + 10}::BIGINT AS columns, (SELECT count(*) FROM stats) AS team_count FROM cleaned""")
def run_metadata(spark, sf_dir):
    features = with_match_features(_cleaned(spark, sf_dir))
    meta = tables.run_metadata(features, league.distinct_teams(features), "match_result", FULL_FEATURES, RESULT_CODES)
    path = tables.write_table(meta, scratch_path(spark, "metadata"), "json")
    back = spark.read.schema(meta.schema).json(path)
    return back.select("model_type", F.size("features").alias("n_features"), F.array_join("classes", ",").alias("classes"), "rows", "columns", "team_count")
