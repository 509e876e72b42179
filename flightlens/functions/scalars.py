"""Casts, rounding, dates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F


# A plain decimal number, with an exponent or without; no NaN, no infinity, no type suffix.
NUMBER = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"
LAST_SECOND = 253_402_300_799  # of the year 9999


def to_number(text: Column) -> Column:
    """Text to double; null where the text is not a plain number."""
    return F.when(text.cast("string").rlike(NUMBER), text.cast("string").try_cast("double"))


def to_utc_timestamp(text: Column) -> Column:
    """ISO text or epoch seconds (up to the year 9999) as text to a timestamp; null for anything else."""
    seconds = to_number(text)
    return F.coalesce(F.try_to_timestamp(text), F.timestamp_seconds(F.when(F.abs(seconds) <= LAST_SECOND, seconds)))


def parse_timestamps(df: DataFrame, columns: list[str]) -> DataFrame:
    """Make ``columns`` timestamps, whatever they were read as."""
    kinds = dict(df.dtypes)
    return df.withColumns(
        {
            c: to_utc_timestamp(F.col(c)) if kinds[c] == "string" else F.col(c).cast("timestamp")
            for c in columns
        }
    )


def round_half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def log_positive(value: Column) -> Column:
    """Natural log; null for zero and below."""
    return F.when(value > 0, F.log(value))


def decimal_year(start: float, position: Column, frequency: int = 365) -> Column:
    """Decimal year of the 1-based ``position`` in a series that begins at ``start``."""
    return F.lit(float(start)) + (position - 1) / F.lit(float(frequency))


def decimal_year_of(day: date) -> float:
    """Decimal year of a day, by the real length of its year; a little inside the day, against rounding."""
    length = (date(day.year + 1, 1, 1) - date(day.year, 1, 1)).days
    return day.year + ((day - date(day.year, 1, 1)).days + 1e-3) / length if day.timetuple().tm_yday > 1 else float(day.year)


def decimal_year_to_date(value: Column) -> Column:
    """Date of a decimal year, by the real length of that year, rounded to the second first."""
    year = F.floor(value).cast("int")
    first = F.make_date(year, F.lit(1), F.lit(1))
    length = F.datediff(F.make_date(year + 1, F.lit(1), F.lit(1)), first)
    seconds = F.round((value - F.floor(value)) * length * 86400)
    return F.date_add(first, F.floor(seconds / 86400).cast("int"))


def matches_any_prefix(text: Column, prefixes: list[str]) -> Column:
    return text.rlike("^(" + "|".join(prefixes) + ")")
