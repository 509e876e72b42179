"""Fixed schemas of all sources. Nothing is inferred: hex addresses such as ``471e23`` look like numbers."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, TS, DT = T.StringType(), T.DoubleType(), T.TimestampType(), T.DateType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


FLIGHTS = _struct(icao24=S, callsign=S, estdepartureairport=S, estarrivalairport=S, day=S, firstseen=S, lastseen=S)
FLIGHTS_2020 = _struct(icao24=S, callsign=S, origin=S, destination=S, day=S, firstseen=S, lastseen=S)
FLIGHTS_TYPED = _struct(
    callsign=S, icao24=S, registration=S, typecode=S, origin=S, destination=S, firstseen=TS, lastseen=TS, day=DT
)
AIRPORTS = _struct(ICAO=S, name=S, latitude_deg=D, longitude_deg=D, elevation_ft=D, continent=S)
AIRCRAFT = _struct(icao24=S, registration=S)
FUEL_RATE = T.StructType(
    [
        T.StructField("Type_Code", S),
        T.StructField("Fuel burn kg/nm", D),
        T.StructField("Minimum range nm", D),
        T.StructField("maximum range nm", D),
    ]
)
CALLSIGNS = _struct(callsign=S, Unknown=S)
EMISSIONS = _struct(
    flight_day=TS, flight_firstseen=TS, flight_lastseen=TS, aircraft_ICAO24=S, aircraft_registration=S,
    aircraft_type=S, aircraft_role=S, flight_departure=S, flight_arrival=S, flight_distance=D,
    aircraft_fuelburn=D, CO2=D,
)
SERIES = _struct(series_key=S, t=T.IntegerType(), date=DT, value=D)

FLEET_REGISTRATION = "Tail/Registration Number"
FLEET_TYPE = "Aircraft Variant ICAO Code"
FLEET_MANUFACTURER = "Aircraft Manufacturer"
FLEET_ROLE = "Role"
