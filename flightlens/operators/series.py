"""Daily series: ``series_key, t, date, value``, one row per key and day.

A series holds at most one row per calendar day, whatever the size of the facts behind it, so the
windows below, one partition per series, stay small; all keys run side by side.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from flightlens.functions.nulls import strict_sum
from flightlens.functions.scalars import decimal_year, decimal_year_to_date, log_positive
from flightlens.operators.clean import date_range


def _by_position():
    return Window.partitionBy("series_key").orderBy("t")


def daily_series(df: DataFrame, day: str, value: str | None = None, key: str | None = None) -> DataFrame:
    """Count rows, or sum ``value``, per key and day, then number the days."""
    measure = F.count(F.lit(1)) if value is None else strict_sum(F.col(value))
    series_key = F.lit("all") if key is None else F.col(key).cast("string")
    daily = df.groupBy(series_key.alias("series_key"), F.col(day).cast("date").alias("date")).agg(
        measure.cast("double").alias("value")
    )
    return number_days(daily)


def number_days(daily: DataFrame) -> DataFrame:
    """Position ``t`` from 1 in day order. Missing days are not filled: later days move up."""
    position = F.row_number().over(Window.partitionBy("series_key").orderBy(F.asc_nulls_last("date")))
    return daily.select("series_key", position.alias("t"), "date", "value")


def period(series: DataFrame, start: date | None, end: date | None, combine: str = "and") -> DataFrame:
    """Days of a series in a date range, numbered anew."""
    return number_days(date_range(series, "date", start, end, combine))


def truncate(series: DataFrame, start: float, end: float, frequency: int = 365) -> DataFrame:
    """Positions up to the decimal year ``end`` of a series that begins at ``start``."""
    return series.filter(F.col("t") <= int(round((end - start) * frequency)) + 1)


def difference(series: DataFrame, lags: list[int], log: bool = False) -> DataFrame:
    """Difference once per entry of ``lags``; each pass drops the rows that have no earlier value."""
    if log:
        series = series.withColumn("value", log_positive(F.col("value")))
    for lag in lags:
        before = F.lag(F.struct("value"), lag).over(_by_position())
        series = (
            series.withColumn("_before", before)
            .filter(F.col("_before").isNotNull())
            .withColumn("value", F.col("value") - F.col("_before.value"))
            .drop("_before")
        )
    return series


def concat(first: DataFrame, second: DataFrame) -> DataFrame:
    """Second series continues the positions of the first; series known to only one side stay."""
    last = first.groupBy("series_key").agg(F.max("t").alias("_last"))
    moved = (
        second.join(last, "series_key", "left")
        .withColumn("t", F.col("t") + F.coalesce("_last", F.lit(0)))
        .select("series_key", "t", "value")
    )
    return first.select("series_key", "t", "value").unionByName(moved)


def with_decimal_dates(series: DataFrame, start: float, frequency: int = 365) -> DataFrame:
    """Date of each position, by way of its decimal year."""
    return series.withColumn("date", decimal_year_to_date(decimal_year(start, F.col("t"), frequency)))


def compare(
    train: DataFrame, forecast: DataFrame, actual: DataFrame, start: float, value: str = "value",
    divisor: float = 1.0,
) -> DataFrame:
    """Long table ``series_key, date, data_source, <value>`` of forecast and real continuation.

    One row pair per forecast day; a day without a real value keeps a null.
    """
    planned = with_decimal_dates(concat(train, forecast), start)
    real = with_decimal_dates(concat(train, actual), start)
    wide = planned.select("series_key", "date", F.col("value").alias("forecast")).join(
        real.select("series_key", "date", F.col("value").alias("real")), ["series_key", "date"], "left"
    )
    long = wide.unpivot(["series_key", "date"], ["real", "forecast"], "data_source", value)
    return long.withColumn(value, F.col(value) / F.lit(float(divisor)))


def as_arrays(series: DataFrame) -> DataFrame:
    """One row per series: ``series_key, y`` with the values in order of position."""
    ordered = F.sort_array(F.collect_list(F.struct("t", "value")))
    return series.groupBy("series_key").agg(ordered.alias("_p")).select("series_key", F.col("_p.value").alias("y"))


def lagged(values: Column, lag: int) -> Column:
    """Difference of an array with itself ``lag`` places earlier; empty if it is too short."""
    size = F.greatest(F.size(values) - lag, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(lag + 1), size), F.slice(values, F.lit(1), size), lambda a, b: a - b)
