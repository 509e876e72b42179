"""Dimension joins.

Facts are always the left side. A dimension is broadcast after its rows have been counted
(``session.checked_broadcast``); beyond the limit the join shuffles, and adaptive execution splits the
partition of a hot key over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flightlens import schemas
from flightlens.session import BROADCAST_ROWS, checked_broadcast


def attach_airports(
    flights: DataFrame, airports: DataFrame, departure: str, arrival: str, attributes: list[str]
) -> DataFrame:
    """Look both ends up and add ``departure_<attribute>`` and ``arrival_<attribute>``."""
    airports = checked_broadcast(airports.select("ICAO", *attributes))
    for role, code in (("departure", departure), ("arrival", arrival)):
        side = airports.select(
            F.col("ICAO").alias("_code"), *[F.col(a).alias(f"{role}_{a}") for a in attributes]
        )
        flights = flights.join(side, F.col(code) == F.col("_code"), "left").drop("_code")
    return flights


def attach_registration(flights: DataFrame, aircraft: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of the registration by aircraft address; an unknown address matches an unknown address."""
    side = checked_broadcast(aircraft.select(F.col("icao24").alias("_icao24"), "registration"), rows)
    return flights.join(side, F.col("icao24").eqNullSafe(F.col("_icao24")), "left").drop("_icao24")


def fleet_types(fleet: DataFrame) -> DataFrame:
    """Registration, type and role of the fleet sheet, where registration and type are known."""
    return fleet.select(
        F.col(schemas.FLEET_REGISTRATION).alias("registration"),
        F.col(schemas.FLEET_TYPE).alias("aircraft_type"),
        F.col(schemas.FLEET_ROLE).alias("aircraft_role"),
    ).dropna(subset=["registration", "aircraft_type"])


def type_manufacturers(fleet: DataFrame) -> DataFrame:
    """Distinct pairs of aircraft type and manufacturer."""
    return (
        fleet.select(F.col(schemas.FLEET_TYPE).alias("type"), F.col(schemas.FLEET_MANUFACTURER).alias("manu"))
        .dropna()
        .distinct()
    )


def attach_fleet(flights: DataFrame, fleet: DataFrame) -> DataFrame:
    """Inner join of type and role by registration; flights without a registered aircraft leave."""
    return flights.filter(F.col("registration").isNotNull()).join(fleet_types(fleet), "registration", "inner")


def aircraft_lookup(aircraft: DataFrame, fleet: DataFrame) -> DataFrame:
    """Address to registration, type and role: both dimensions joined once, away from the flights."""
    return attach_fleet(aircraft.select("icao24", "registration"), fleet)


def attach_aircraft(flights: DataFrame, lookup: DataFrame) -> DataFrame:
    """``attach_registration`` followed by ``attach_fleet`` as a single join of the flights."""
    side = lookup.withColumnRenamed("icao24", "_icao24")
    return flights.join(side, F.col("icao24").eqNullSafe(F.col("_icao24")), "inner").drop("_icao24")


def only_types(df: DataFrame, types: DataFrame, column: str = "aircraft_type") -> DataFrame:
    """Rows whose type is listed."""
    return df.join(types.select(column), column, "left_semi")


def unknown_to(df: DataFrame, other: DataFrame, column: str, other_column: str | None = None) -> DataFrame:
    """Rows whose key is not in the other table; an unknown key counts as equal to an unknown key."""
    side = other.select(F.col(other_column or column).alias("_known"))
    return df.join(side, F.col(column).eqNullSafe(F.col("_known")), "left_anti")
