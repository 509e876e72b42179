"""Tables behind the reports, from the emissions table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from flightlens.functions.classify import manufacturer
from flightlens.functions.nulls import strict_sum
from flightlens.functions.scalars import matches_any_prefix, round_half_even
from flightlens.operators import aggregate, clean, enrich, reshape
from flightlens.operators.smooth import local_trend
from flightlens.operators.trend import smooth_trend


def report_cells(emissions: DataFrame) -> DataFrame:
    """One row per day, type and role, from which every report follows: ``CO2`` (null if one is unknown), and of the
    flights with known CO2 their number ``known`` and sum ``known_CO2``."""
    known = F.when(~F.isnan("CO2"), F.col("CO2"))
    return emissions.groupBy("flight_day", "aircraft_type", "aircraft_role").agg(
        strict_sum(F.col("CO2")).alias("CO2"), F.count(known).alias("known"), F.sum(known).alias("known_CO2")
    )


def known_co2(cells: DataFrame) -> DataFrame:
    """Cells with known CO2, as an emissions table of one row per cell."""
    return cells.filter("known > 0").select("flight_day", "aircraft_type", "aircraft_role", "known", F.col("known_CO2").alias("CO2"))


def daily_co2(emissions: DataFrame) -> DataFrame:
    return aggregate.sum_by(emissions, ["flight_day"], "CO2", "daily_CO2")


def co2_day_role(emissions: DataFrame) -> DataFrame:
    return aggregate.sum_by(emissions, ["flight_day", "aircraft_role"], "CO2", "CO2_daily")


def daily_co2_by_role_clean(*emissions: DataFrame) -> DataFrame:
    """Daily CO2 per role over all given tables, without outliers and values that are not positive."""
    both = reshape.bind_rows(*emissions).select("flight_day", "aircraft_type", "aircraft_role", "CO2")
    daily = co2_day_role(clean.drop_na(both))
    return aggregate.remove_outliers(daily, ["aircraft_role"], "CO2_daily").filter(F.col("CO2_daily") > 0)


def role_trend(daily: DataFrame, bandwidth: int = 90, step: int = 7) -> DataFrame:
    """Smoothed daily CO2 per role, at every ``step`` days since 1970."""
    dated = daily.withColumn("x", F.unix_date(F.col("flight_day").cast("date")))
    trend = local_trend(dated, ["aircraft_role"], "x", "CO2_daily", bandwidth, step)
    return trend.select("aircraft_role", F.date_from_unix_date(F.col("x").cast("int")).alias("flight_day"), "trend")


def role_smooth(daily: DataFrame) -> DataFrame:
    """Trend of daily CO2 per role at 80 places with its standard error: ``aircraft_role, x`` (days since 1970), ``trend, error, sigma, freedom``."""
    dated = daily.withColumn("x", F.unix_date(F.col("flight_day").cast("date")))
    return smooth_trend(dated, ["aircraft_role"], "x", "CO2_daily")


def co2_by_type(emissions: DataFrame, start: date, end: date, divisor: float = 1e6) -> DataFrame:
    """CO2 per type in a period, in units of ``divisor`` kg rounded half to even, largest first."""
    period = clean.date_range(emissions, "flight_day", start, end)
    sums = aggregate.sum_by(period, ["aircraft_type"], "CO2", "total").orderBy(*aggregate.descending("total"))
    return sums.select("aircraft_type", round_half_even(F.col("total") / divisor).alias("total_CO2"))


def daily_flights_and_co2(emissions: DataFrame) -> DataFrame:
    known = clean.drop_na(emissions.select("flight_day", "CO2"))
    return aggregate.count_and_sum_by(known, ["flight_day"], "CO2", "flights", "CO2_daily")


def daily_flights_and_co2_of(cells: DataFrame) -> DataFrame:
    """``daily_flights_and_co2`` from report cells."""
    days = known_co2(cells).filter("flight_day is not null").groupBy("flight_day")
    return days.agg(F.sum("known").alias("flights"), F.sum("CO2").cast("double").alias("CO2_daily"))


def total_co2(emissions: DataFrame, start: date, end: date) -> DataFrame:
    return aggregate.total(clean.date_range(emissions, "flight_day", start, end), "CO2", "CO2")


def grid_with_manufacturer(grid: DataFrame, fleet: DataFrame) -> DataFrame:
    """Fuel grid points with the manufacturer of the type: ``type, manu, distance, fuelburn``."""
    joined = reshape.grid_points(grid).join(enrich.type_manufacturers(fleet), "type", "left")
    return joined.select("type", manufacturer(F.col("type"), F.col("manu")).alias("manu"), "distance", "fuelburn")


def selected_rates(rates: DataFrame, prefixes: list[str] = ("A3", "B7")) -> DataFrame:
    """Rates of types beginning with one of the prefixes, sorted by type."""
    return rates.filter(matches_any_prefix(F.col("type"), prefixes)).orderBy(*aggregate.ascending("type"))
