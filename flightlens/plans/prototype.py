"""Earlier variant of the flight cleaning: aircraft type filled in from other flights of a callsign."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flightlens.functions.fuel import co2, polynomial_fuel
from flightlens.functions.geo import distance_nm
from flightlens.functions.nulls import fill_from, paste
from flightlens.operators import clean, enrich
from flightlens.session import BROADCAST_ROWS, checked_broadcast, stored

AIRPORT_ATTRIBUTES = ["name", "latitude_deg", "longitude_deg", "elevation_ft", "continent"]

# Fixed value: where flights are looked up by callsign.
LOOKUP_URL = "https://planefinder.net/data/flight/"


def located_flights(flights: DataFrame, airports: DataFrame, region: str = "EU") -> DataFrame:
    """Region flights with all attributes of both airports."""
    ends = enrich.attach_airports(flights, airports, "origin", "destination", AIRPORT_ATTRIBUTES)
    return clean.different_airports(
        clean.touches_region(ends, "departure_continent", "arrival_continent", region), "origin", "destination"
    )


def callsign_types(flights: DataFrame) -> DataFrame:
    """First complete flight of each callsign: ``callsign, registration, typecode``."""
    complete = flights.select("callsign", "registration", "typecode", "origin", "destination", "firstseen", "icao24")
    complete = clean.drop_na(complete, ["callsign", "registration", "typecode", "origin", "destination"])
    first = clean.first_per_key(complete, "callsign", ["firstseen", "icao24"])
    return first.select("callsign", "registration", "typecode")


def impute_types(flights: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Fill unknown type and registration from the callsign's first complete flight.

    The known callsigns are a stored table: broadcast up to ``rows`` rows, else joined by a shuffle of both sides, which adaptive
    execution splits at a hot callsign, the unknown one included.
    """
    known = stored(callsign_types(flights), "callsigns")
    known = known.withColumnsRenamed({"registration": "_registration", "typecode": "_typecode"})
    return (
        flights.join(checked_broadcast(known, rows), "callsign", "left")
        .withColumn("typecode", fill_from(F.col("typecode"), F.col("_typecode")))
        .withColumn("registration", fill_from(F.col("registration"), F.col("_registration")))
        .select(*flights.columns)
    )


def unresolved(imputed: DataFrame) -> DataFrame:
    """First flight of each callsign that still has no type."""
    return clean.first_per_key(imputed.filter(F.col("typecode").isNull()), "callsign", ["firstseen", "icao24"])


def unresolved_flights(flights: DataFrame) -> DataFrame:
    """``unresolved(impute_types(flights))``, reduced to one flight per callsign before anything is joined."""
    known = callsign_types(flights).select("callsign")
    first = clean.first_per_key(flights.filter(F.col("typecode").isNull()), "callsign", ["firstseen", "icao24"])
    return first.join(known, "callsign", "left_anti")


def not_looked_up(missing: DataFrame, looked_up: DataFrame) -> DataFrame:
    """Unresolved callsigns that an earlier lookup does not hold."""
    return enrich.unknown_to(missing, looked_up, "callsign")


def lookup_links(missing: DataFrame, url: str = LOOKUP_URL) -> DataFrame:
    return missing.select("callsign", "typecode", paste(F.lit(url), F.col("callsign")).alias("link"))


def prototype_emissions(imputed: DataFrame, fleet: DataFrame, model: DataFrame, form: str) -> DataFrame:
    """CO2 per flight by the fuel model, with the fleet sheet's own roles."""
    distance = distance_nm(
        F.col("departure_longitude_deg"), F.col("departure_latitude_deg"),
        F.col("arrival_longitude_deg"), F.col("arrival_latitude_deg"),
    )
    typed = enrich.attach_fleet(imputed, fleet).withColumn("distance", distance)
    side = model.select(F.col("type").alias("aircraft_type"), "c0", "c1", "c2", "c3")
    fuel = polynomial_fuel(F.col("c0"), F.col("c1"), F.col("c2"), F.col("c3"), F.col("distance"), form)
    return (
        typed.join(side, "aircraft_type", "inner")
        .withColumn("fuelburn", fuel)
        .withColumn("CO2", co2(F.col("fuelburn")))
        .select(
            "day", "registration", "aircraft_type", "aircraft_role", F.col("origin").alias("departure"),
            F.col("destination").alias("arrival"), "distance", "fuelburn", "CO2",
        )
    )


def co2_per_day_and_role(emissions: DataFrame) -> DataFrame:
    """Daily CO2 per role, over complete rows."""
    return clean.drop_na(emissions).groupBy("day", "aircraft_role").agg(F.sum("CO2").alias("CO2"))
