"""From flight lists to CO2 per flight."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flightlens.functions.classify import ROLE_LABELS, role_label
from flightlens.functions.fuel import co2, polynomial_fuel, rate_fuel
from flightlens.functions.geo import distance_nm
from flightlens.functions.scalars import parse_timestamps
from flightlens.operators import clean, enrich, reshape
from flightlens.operators.polyfit import fit_polynomial

DEPARTURE, ARRIVAL = "estdepartureairport", "estarrivalairport"

FLIGHT_COLUMNS = [
    "flight_day", "flight_firstseen", "flight_lastseen", "aircraft_ICAO24", "aircraft_registration",
    "aircraft_type", "aircraft_role", "flight_departure", "flight_arrival", "flight_distance",
]


def _located(flights: DataFrame, airports: DataFrame, region: str) -> DataFrame:
    """Flights between two different airports of which one lies in the region, with coordinates.

    One lookup per end serves both the region filter and the distance. Airport codes are unique.
    """
    known = clean.different_airports(clean.drop_na(flights, [DEPARTURE, ARRIVAL]), DEPARTURE, ARRIVAL)
    ends = enrich.attach_airports(
        known, airports, DEPARTURE, ARRIVAL, ["continent", "longitude_deg", "latitude_deg"]
    )
    return clean.touches_region(ends, "departure_continent", "arrival_continent", region)


def _with_distance(located: DataFrame) -> DataFrame:
    return located.withColumn(
        "distance",
        distance_nm(
            F.col("departure_longitude_deg"), F.col("departure_latitude_deg"),
            F.col("arrival_longitude_deg"), F.col("arrival_latitude_deg"),
        ),
    )


def eu_flights(flights: DataFrame, airports: DataFrame, region: str = "EU") -> DataFrame:
    """Flights from or to the region, with the columns they came with."""
    return _located(flights, airports, region).select(*flights.columns)


def enriched_flights(
    flights: DataFrame, airports: DataFrame, aircraft: DataFrame, region: str = "EU"
) -> DataFrame:
    """Region flights with registration, parsed times and great-circle distance."""
    found = _with_distance(_located(flights, airports, region))
    found = parse_timestamps(enrich.attach_registration(found, aircraft), ["day", "firstseen", "lastseen"])
    return found.select(
        "day", "icao24", "registration", "callsign", F.col(DEPARTURE).alias("departure"),
        F.col(ARRIVAL).alias("arrival"), "firstseen", "lastseen", "distance",
    )


def _typed_rows(
    flights: DataFrame, airports: DataFrame, aircraft: DataFrame, region: str
) -> DataFrame:
    found = enrich.attach_aircraft(_with_distance(_located(flights, airports, region)), aircraft)
    found = parse_timestamps(found, ["day", "firstseen", "lastseen"])
    renamed = {
        "day": "flight_day", "firstseen": "flight_firstseen", "lastseen": "flight_lastseen",
        "icao24": "aircraft_ICAO24", "registration": "aircraft_registration",
        DEPARTURE: "flight_departure", ARRIVAL: "flight_arrival", "distance": "flight_distance",
    }
    return found.withColumnsRenamed(renamed).select(*FLIGHT_COLUMNS)


def typed_flights(
    flights: DataFrame, airports: DataFrame, aircraft: DataFrame, region: str = "EU"
) -> DataFrame:
    """Distinct region flights with official type and role; flights differing only by callsign merge.

    ``aircraft`` is the table of ``enrich.aircraft_lookup``, best stored by ``session.stored_lookup``.
    """
    return _typed_rows(flights, airports, aircraft, region).distinct()


def rate_table(rates: DataFrame, grid: DataFrame) -> DataFrame:
    """One fuel rate per type that the grid does not list: ``type, fuelburn``.

    The range columns play no part in the result, so they are not made long first.
    """
    named = rates.select(F.col("Type_Code").alias("type"), F.col("Fuel burn kg/nm").alias("fuelburn"))
    absent = enrich.unknown_to(named.distinct(), grid, "type", "Type")
    return clean.keep_group_max(absent, ["type"], "fuelburn")


def fuel_model(grid: DataFrame) -> DataFrame:
    """Cubic per type of the wide fuel grid: ``type, c0..c3, n``."""
    return fit_polynomial(reshape.grid_points(grid), "type", "distance", "fuelburn")


def fuel_lookup(grid: DataFrame, rates: DataFrame) -> DataFrame:
    """One row per type: cubic coefficients or a rate.

    The two sets of types are disjoint, so one lookup replaces splitting the flights by method, joining
    each part and uniting them again.
    """
    cubic = fuel_model(grid).select(F.col("type").alias("aircraft_type"), "c0", "c1", "c2", "c3")
    rate = rate_table(rates, grid).select(F.col("type").alias("aircraft_type"), F.col("fuelburn").alias("rate"))
    return reshape.bind_rows(cubic, rate)


def with_emissions(
    flights: DataFrame, lookup: DataFrame, form: str, roles: dict[str, str] = ROLE_LABELS
) -> DataFrame:
    """Fuel and CO2 of typed flights, report roles, and only complete rows."""
    distance = F.col("flight_distance")
    cubic = polynomial_fuel(F.col("c0"), F.col("c1"), F.col("c2"), F.col("c3"), distance, form)
    burnt = flights.join(lookup, "aircraft_type", "inner").withColumn(
        "aircraft_fuelburn", F.coalesce(rate_fuel(distance, F.col("rate")), cubic)
    )
    result = burnt.withColumn("CO2", co2(F.col("aircraft_fuelburn"))).withColumn(
        "aircraft_role", role_label(F.col("aircraft_role"), roles)
    )
    return clean.drop_na(result.select(*FLIGHT_COLUMNS, "aircraft_fuelburn", "CO2"))


def emissions(
    flights: DataFrame, airports: DataFrame, aircraft: DataFrame, lookup: DataFrame, form: str,
    region: str = "EU", roles: dict[str, str] = ROLE_LABELS,
) -> DataFrame:
    """CO2 per flight, from raw flight lists.

    ``aircraft`` and ``lookup`` are the tables of ``enrich.aircraft_lookup`` and ``fuel_lookup``; both are
    small beside the flights, and stored by ``session.stored_lookup`` they need no shuffle of the flights.

    Rows that the final cleaning would lose (unknown place, role or fuel type) leave before the distinct,
    which is the one large shuffle; the answer is the same.
    """
    rows = clean.drop_na(_typed_rows(flights, airports, aircraft, region))
    rows = rows.filter(role_label(F.col("aircraft_role"), roles).isNotNull())
    distinct = enrich.only_types(rows, lookup).distinct()
    return with_emissions(distinct, lookup, form, roles)


def unmapped_roles(fleet: DataFrame, roles: dict[str, str] = ROLE_LABELS) -> DataFrame:
    """Fleet roles without a report role, and how often they occur."""
    role = F.col("Role")
    return fleet.filter(role_label(role, roles).isNull()).groupBy(role.alias("role")).agg(
        F.count(F.lit(1)).alias("n")
    )
