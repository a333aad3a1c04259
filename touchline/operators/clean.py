"""Typed, defaulted matches from raw text rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.parsing import na_to_null, number_or_zero, parse_date, to_number
from touchline.schema import MATCH_COLUMNS, MEASURES

ESSENTIAL = ("HomeTeam", "AwayTeam", "FTR")


def with_all_columns(raw: DataFrame) -> DataFrame:
    """Adds the match columns a source lacks, as nulls."""
    missing = {c: F.lit(None).cast("string") for c in MATCH_COLUMNS if c not in raw.columns}
    return raw.withColumns(missing) if missing else raw


def clean_matches(raw: DataFrame) -> DataFrame:
    """Missing texts become null, dates and numbers are parsed, gaps take defaults.

    A missing result is a draw, so only a missing team drops a row.  Columns
    beyond the match columns pass through untouched.  No shuffle.
    """
    raw = with_all_columns(raw)
    extra = [c for c in raw.columns if c not in MATCH_COLUMNS]
    # No missing-value token parses as a number other than NaN, so numbers need no token test.
    typed = {c: number_or_zero(F.col(c)) for c in MEASURES}
    typed["Date"] = parse_date(F.col("Date"))
    known = {c: na_to_null(F.col(c)) for c in ("HomeTeam", "AwayTeam", "HTR", "FTR")}
    typed |= {c: F.coalesce(known[c], F.lit("D")) for c in ("HTR", "FTR")}
    typed |= {c: known[c] for c in ("HomeTeam", "AwayTeam")}
    rows = raw.select(*extra, *[typed[c].alias(c) for c in MATCH_COLUMNS])
    return rows.dropna(subset=list(ESSENTIAL))


def cleaning_report(raw: DataFrame) -> DataFrame:
    """How many rows cleaning drops, and how many it gives a default result, date or number."""
    raw = with_all_columns(raw)
    known = {c: na_to_null(F.col(c)) for c in ("HomeTeam", "AwayTeam", "FTR")}
    unread = F.lit(False)
    for c in MEASURES:
        unread = unread | F.nanvl(to_number(F.col(c)), F.lit(None).cast("double")).isNull()
    return raw.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(known["HomeTeam"].isNull() | known["AwayTeam"].isNull()).alias("dropped_rows"),
        F.count_if(known["FTR"].isNull()).alias("defaulted_results"),
        F.count_if(parse_date(F.col("Date")).isNull()).alias("undated_rows"),
        F.count_if(unread).alias("zeroed_rows"),
    )
