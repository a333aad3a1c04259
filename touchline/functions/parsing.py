"""Text -> typed column expressions that never raise under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts a CSV reader of data frames takes as "missing".
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# The JVM's number parser also takes "12d", "12f" and hexadecimal; text columns do not mean that.
_JAVA_ONLY_NUMBER = r"(?i)0x|[0-9.][df]\s*$"


def na_to_null(text: Column) -> Column:
    return F.when(~F.trim(text).isin(*NA_TOKENS), text)


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def parse_date(text: Column) -> Column:
    """Date of ``yyyy-MM-dd``, ``dd/MM/yyyy`` or ``dd/MM/yy`` (2000 to 2099), null for other texts and days that do not exist."""
    trimmed = F.trim(text)

    def iso(century: str, year_digits: int) -> Column:
        year, month, day = F.substring(trimmed, 7, year_digits), F.substring(trimmed, 4, 2), F.substring(trimmed, 1, 2)
        return F.concat(F.lit(century), year, F.lit("-"), month, F.lit("-"), day)

    # Whole-text shapes first, then casts: a layout that fails costs an exception a row.
    return (
        F.when(trimmed.rlike(r"^\d{4}-\d{2}-\d{2}\z"), trimmed.try_cast("date"))
        .when(trimmed.rlike(r"^\d{2}/\d{2}/\d{4}\z"), iso("", 4).try_cast("date"))
        .when(trimmed.rlike(r"^\d{2}/\d{2}/\d{2}\z"), iso("20", 2).try_cast("date"))
    )


def to_number(text: Column) -> Column:
    """Double value of a text, null where it is not a number."""
    return F.when(~text.rlike(_JAVA_ONLY_NUMBER), text.try_cast("double"))


def number_or_zero(text: Column) -> Column:
    return F.coalesce(F.nanvl(to_number(text), F.lit(None).cast("double")), F.lit(0.0))
