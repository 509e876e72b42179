"""Daily movements and CO2: train, forecast, compare with what happened."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from flightlens.operators import clean, sarima, series, smooth
from flightlens.session import stored

# Orders of the two published models and their season in days.
MOVEMENTS = sarima.Sarima((3, 1, 3), (1, 0, 0), 31)
CO2 = sarima.Sarima((2, 1, 1), (0, 1, 0), 31)
HORIZON = 365


def cleaned_series(daily: DataFrame, block: int | None = 7) -> DataFrame:
    """A daily series with its outliers replaced.

    ``block`` is the block length for choosing the power transform; None leaves the scale alone. The series is
    read twice, so it should be a stored table.
    """
    lambdas = None if block is None else smooth.boxcox_lambda(daily, block)
    cleaned = smooth.clean_series(daily, lambdas)
    return cleaned.select("series_key", "t", "date", F.col("cleaned").alias("value"))


def forecast_vs_actual(
    train: DataFrame, actual: DataFrame, model: sarima.Sarima, start_year: float, horizon: int = HORIZON,
    value: str = "value", divisor: float = 1.0, shown_from: date | None = None, shown_to: date | None = None,
) -> DataFrame:
    """Long table of real and forecast values, from the first training day to the end of the forecast."""
    train, actual = stored(train, "train"), stored(actual, "actual")
    future = sarima.forecast(sarima.fit(train, model), model, horizon)
    table = series.compare(train, future, actual, start_year, value, divisor)
    if shown_from is None and shown_to is None:
        return table
    return clean.date_range(table, "date", shown_from, shown_to)
