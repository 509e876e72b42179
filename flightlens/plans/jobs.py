"""The whole way from source files to tables, as a user runs it."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from flightlens.functions.scalars import decimal_year_of, parse_timestamps
from flightlens.operators import aggregate, clean, enrich, reshape, series
from flightlens.plans import emissions as em
from flightlens.plans import forecasts, prototype, reports
from flightlens.session import stored, stored_lookup
from flightlens.sources import readers, writers


@dataclass(frozen=True)
class Sources:
    """Where the source tables lie. ``flights`` is a folder of flight lists, the others are files."""

    flights: str
    airports: str
    aircraft: str
    fleet: str
    fuel_grid: str
    fuel_rates: str
    fleet_preamble: int = 10


def load_flights(
    spark: SparkSession, sources: Sources, start: date, end: date, pattern: str = "flightlist_.*",
    layout_2020: bool = False,
) -> DataFrame:
    """Flights of a period. The period is explicit because files of several years may share a folder."""
    read = readers.read_flights_2020 if layout_2020 else readers.read_flight_files
    flights = parse_timestamps(read(spark, sources.flights, pattern), ["day", "firstseen", "lastseen"])
    return clean.date_range(flights, "day", start, end)


def build_emissions(
    spark: SparkSession, sources: Sources, flights: DataFrame, out: str, form: str, mode: str = "errorifexists"
) -> DataFrame:
    """Write the emissions table of ``flights`` and return it as read back."""
    aircraft = enrich.aircraft_lookup(
        readers.read_aircraft(spark, sources.aircraft),
        readers.read_fleet(spark, sources.fleet, sources.fleet_preamble),
    )
    grid = stored(readers.read_fuel_grid(spark, sources.fuel_grid), "grid")
    lookup = em.fuel_lookup(grid, readers.read_fuel_rates(spark, sources.fuel_rates))
    rows = em.emissions(
        flights, readers.read_airports(spark, sources.airports), stored_lookup(aircraft, "aircraft"),
        stored_lookup(lookup, "fuel"), form,
    )
    writers.write_emissions(rows, out, mode)
    return readers.read_emissions(spark, out)


def export_fuel_tables(spark: SparkSession, sources: Sources, out: str, mode: str = "errorifexists") -> None:
    """CSV of the fuel grid with manufacturers and of the rates of the large families."""
    grid = readers.read_fuel_grid(spark, sources.fuel_grid)
    fleet = readers.read_fleet(spark, sources.fleet, sources.fleet_preamble)
    writers.write_csv(reports.grid_with_manufacturer(grid, fleet), f"{out}/fuel_grid", mode)
    rates = em.rate_table(readers.read_fuel_rates(spark, sources.fuel_rates), grid)
    writers.write_csv(reports.selected_rates(rates), f"{out}/fuel_rates", mode)


def report_tables(history: DataFrame, latest: DataFrame, start: date, end: date) -> dict[str, DataFrame]:
    """Tables behind the emission reports; ``start`` and ``end`` bound the yearly ones.

    Both emissions tables are read once, into sums per day, type and role; all reports follow from these.
    """
    old, new = (stored(reports.report_cells(table), "report-cells") for table in (history, latest))
    by_role = stored(reports.daily_co2_by_role_clean(reports.known_co2(old), reports.known_co2(new)), "by-role")
    return {
        "daily_co2_by_role": by_role,
        "role_trend": reports.role_trend(by_role),
        "co2_by_type": reports.co2_by_type(reshape.bind_rows(old, new), start, end),
        "daily_flights_and_co2": reports.daily_flights_and_co2_of(old),
        "total_co2": reports.total_co2(old, start, end),
    }


def prototype_tables(
    spark: SparkSession, sources: Sources, flights: str | list[str], callsigns: str, form: str
) -> dict[str, DataFrame]:
    """Tables of the earlier variant, from typed flight lists and a file of callsigns that were looked up before.

    The located flights are stored, as filling in types and finding unresolved callsigns both read them.
    """
    airports = readers.read_airports(spark, sources.airports)
    located = stored(prototype.located_flights(readers.read_flights_typed(spark, flights), airports), "located")
    missing = stored(prototype.unresolved_flights(located), "unresolved")
    new = prototype.not_looked_up(missing, readers.read_callsigns(spark, callsigns))
    model = stored_lookup(em.fuel_model(readers.read_fuel_grid(spark, sources.fuel_grid)), "model")
    fleet = readers.read_fleet(spark, sources.fleet, sources.fleet_preamble)
    rows = prototype.prototype_emissions(prototype.impute_types(located), fleet, model, form)
    return {
        "unresolved": missing,
        "links": prototype.lookup_links(new),
        "emissions": rows,
        "co2_day_role": prototype.co2_per_day_and_role(rows),
    }


def forecast_tables(
    history: DataFrame, latest: DataFrame, start: date, end: date, shown_from: date | None = None,
    shown_to: date | None = None, co2_as_written: bool = False,
) -> dict[str, DataFrame]:
    """Movements and CO2 (in tonnes): forecast from ``start``..``end`` against the latest table.

    ``co2_as_written`` trains the CO2 model as published: bounds joined by "or", which keeps every day of the history, and
    the series cut at the decimal year after ``end``. Both tables are read once, into counts and sums per day.
    """
    past = history if co2_as_written else clean.date_range(history, "flight_day", start, end)
    totals = [
        stored(aggregate.count_and_sum_by(table, ["flight_day"], "CO2", "ATM", "CO2"), "day-totals")
        for table in (past, latest)
    ]
    tables = {}
    for name, model, divisor in (("ATM", forecasts.MOVEMENTS, 1.0), ("CO2", forecasts.CO2, 1000.0)):
        days, recent = (series.daily_series(table, "flight_day", name) for table in totals)
        if name == "CO2" and co2_as_written:
            daily = series.truncate(series.period(days, start, end, combine="or"), start.year, end.year + 1)
        else:
            daily = series.period(days, start, end)
        train, actual = (forecasts.cleaned_series(stored(one, f"daily-{name}")) for one in (daily, recent))
        first = train.agg(F.min("date")).first()[0] or start  # the period may begin inside a year, or lack its first days
        tables[name] = forecasts.forecast_vs_actual(
            train, actual, model, decimal_year_of(first), value=name, divisor=divisor, shown_from=shown_from,
            shown_to=shown_to,
        )
    return tables
