"""Request fields are parsed once a row, whatever filters name their numbers."""

import re

from touchline.functions.validation import FIELD_LIMITS
from touchline.operators import envelopes

PATTERN = r"RLIKE\("


def requests(spark, **values):
    row = {"match_id": "m", "HomeTeam": "A", "AwayTeam": "B"} | {c: "1" for c in FIELD_LIMITS} | values
    return spark.createDataFrame([row], ", ".join(f"`{c}` string" for c in row))


def parses(df) -> int:
    return len(re.findall(PATTERN, df._jdf.queryExecution().optimizedPlan().toString()))


def stored(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "rows"))
    return spark.read.parquet(str(tmp_path / "rows"))


def test_refused_and_accepted_requests_parse_each_field_once(spark, tmp_path):
    spark.conf.set("spark.sql.maxPlanStringLength", 1_000_000)
    rows = stored(spark, tmp_path, requests(spark).unionByName(requests(spark, match_id="bad", HS="x", AS="61", AwayTeam="A")))
    refused, fine = envelopes.rejects(rows), envelopes.accepted(rows)
    assert parses(refused) <= len(FIELD_LIMITS) and parses(fine) <= len(FIELD_LIMITS)
    assert [tuple(r) for r in refused.collect()] == [
        ("bad", ["Please select different teams", "HS must be a number", "AS out of range"], "MISSING_TEAM")]
    assert [r["HS"] for r in fine.collect()] == [1.0]
    assert fine.columns == rows.columns
