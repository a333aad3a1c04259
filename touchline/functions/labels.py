"""Display texts: result labels, team names, percents and score lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Result codes as shown to readers.
RESULT_LABELS = {"H": "Home Win", "D": "Draw", "A": "Away Win"}
HALF_TIME_LABELS = {"H": "Home Leading", "D": "Level", "A": "Away Leading"}

# Short team names and their display form.
TEAM_DISPLAY_NAMES = {
    "Man City": "Manchester City",
    "Man United": "Manchester United",
    "Nottm Forest": "Nottingham Forest",
    "Sheffield United": "Sheffield Utd",
}


def mapped(code: Column, names: dict[str, str], otherwise: Column | None = None) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, code), code if otherwise is None else otherwise)


def result_label(code: Column) -> Column:
    return mapped(code, RESULT_LABELS)


def half_time_label(code: Column) -> Column:
    """Anything but a lead for one side reads as level."""
    return mapped(code, HALF_TIME_LABELS, F.lit(HALF_TIME_LABELS["D"]))


def team_display(team: Column) -> Column:
    return mapped(team, TEAM_DISPLAY_NAMES)


def one_decimal(value: Column) -> Column:
    """Half-even rounding to one decimal place."""
    return F.rint(value * 10) / 10


def percent_text(value: Column) -> Column:
    return F.format_string("%.1f%%", one_decimal(value))


def thousands_text(value: Column, decimals: int = 0) -> Column:
    return F.format_number(value, decimals)


def score_text(home: Column, away: Column) -> Column:
    return F.concat_ws("-", home.cast("bigint"), away.cast("bigint"))


def form_record_text(wins: Column, draws: Column, losses: Column) -> Column:
    return F.format_string("%dW-%dD-%dL", wins, draws, losses)
