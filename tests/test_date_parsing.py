"""Dates are read by casts, with the results of the layouts they stand for."""

from pyspark.sql import functions as F

from touchline.functions.parsing import parse_date


def test_dates_equal_the_layouts_they_stand_for(spark):
    years, days = [0, 4, 99, 1582, 1900, 1995, 2000, 2023, 9999], spark.range(0, 34).select(F.format_string("%02d", "id").alias("d"))
    months = spark.range(0, 14).select(F.format_string("%02d", "id").alias("m"))
    every = spark.createDataFrame([(f"{y:04d}", f"{y % 100:02d}") for y in years], "y string, s string").crossJoin(months).crossJoin(days)
    texts = every.select(F.explode(F.array(
        F.concat_ws("-", "y", "m", "d"), F.concat_ws("/", "d", "m", "y"), F.concat_ws("/", "d", "m", "s"),
        F.concat(F.lit(" "), F.concat_ws("-", "y", "m", "d"), F.lit(" ")))).alias("t"))
    odd = ["", " ", "n/a", "1995-1-2", "1/2/1995", "1995-01-02T00", "1995-01-02\n", "02/01/1995\n", "02/01/95\n", "\t1995-01-02", "02-01-1995", None]
    texts = texts.unionByName(spark.createDataFrame([(t,) for t in odd], "t string"))
    shapes = ((r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"), (r"^\d{2}/\d{2}/\d{2}$", "dd/MM/yy"))
    wanted = F.coalesce(*[F.when(F.trim("t").rlike(s), F.try_to_timestamp(F.trim("t"), F.lit(f)).cast("date")) for s, f in shapes])
    found = texts.select("t", parse_date(F.col("t")).cast("string").alias("found"), wanted.cast("string").alias("wanted"))
    assert found.where(~F.col("found").eqNullSafe(F.col("wanted"))).limit(5).collect() == []
    assert found.where("found IS NOT NULL").count() > 10_000
    assert "gettimestamp" not in texts.select(parse_date(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
