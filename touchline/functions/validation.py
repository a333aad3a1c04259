"""Request checks as array-of-message expressions, in field order.

``with_numbers`` parses every field once; the checks only look at the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.parsing import blank_to_null, to_number
from touchline.schema import HALF_TIME_GOALS, MATCH_STATS

# The largest number each request field accepts; the least is 0.
FIELD_LIMITS = {
    "HS": 50, "AS": 50, "HST": 20, "AST": 20, "HC": 20, "AC": 20,
    "HF": 30, "AF": 30, "HY": 10, "AY": 10, "HR": 5, "AR": 5,
    "HTHG": 10, "HTAG": 10,
}


def _number(name: str) -> Column:
    return F.col(f"__{name}")


def with_numbers(requests: DataFrame) -> DataFrame:
    """Adds the parsed number of every checked field; ``without_numbers`` removes them.

    ``inline`` keeps filters above it: below a projection they would parse a field
    again each time they name its number, three to five times a row.
    """
    numbers = F.struct(*[to_number(F.col(c).cast("string")).alias(f"__{c}") for c in FIELD_LIMITS])
    return requests.select("*", F.inline(F.array(numbers)))


def without_numbers(requests: DataFrame) -> DataFrame:
    return requests.drop(*[f"__{c}" for c in FIELD_LIMITS])


def stat_errors() -> Column:
    """One message per statistic that is missing, not a number, or negative."""
    checks = []
    for name in MATCH_STATS:
        number = _number(name)
        checks.append(
            F.when(F.col(name).isNull(), f"Missing field: {name}")
            .when(number.isNull(), f"{name} must be a number")
            .when(number < 0, f"{name} cannot be negative")
        )
    return F.array_compact(F.array(*checks))


def merged_stat_errors() -> Column:
    """The same checks with one message for everything that is not a number from 0 up."""
    checks = []
    for name in MATCH_STATS:
        number = _number(name)
        checks.append(
            F.when(F.col(name).isNull(), f"Missing field: {name}")
            .when(number.isNull() | F.isnan(number) | (number < 0), f"{name} must be a non-negative number")
        )
    return F.array_compact(F.array(*checks))


def range_errors() -> Column:
    """One message per number outside the range its field accepts."""
    checks = []
    for name in MATCH_STATS + HALF_TIME_GOALS:
        number = _number(name)
        checks.append(F.when((number < 0) | (number > FIELD_LIMITS[name]), f"{name} out of range"))
    return F.array_compact(F.array(*checks))


def team_errors(home: str = "HomeTeam", away: str = "AwayTeam") -> Column:
    """Both teams must be named and differ."""
    home_name, away_name = blank_to_null(F.col(home)), blank_to_null(F.col(away))
    return F.array_compact(F.array(
        F.when(home_name.isNull() | away_name.isNull(), "Please select both teams")
        .when(home_name == away_name, "Please select different teams")
    ))


def no_errors(home: str = "HomeTeam", away: str = "AwayTeam") -> Column:
    """True where none of the checks has a message; blank teams must already be null."""
    fine = F.col(home).isNotNull() & F.col(away).isNotNull() & (F.col(home) != F.col(away))
    for name in FIELD_LIMITS:
        number = _number(name)
        inside = (number >= 0) & (number <= FIELD_LIMITS[name])
        # A half-time field may be missing; a statistic may not.
        fine = fine & (inside if name in MATCH_STATS else F.coalesce(inside, F.lit(True)))
    return fine
