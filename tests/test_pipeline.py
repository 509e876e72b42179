"""The small flight fixture, from raw tables to reports."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from flightlens import schemas
from flightlens.operators import enrich
from flightlens.plans import emissions as em
from flightlens.plans import forecasts, prototype, reports

DAY = "2019-03-01 00:00:00+00:00"


@pytest.fixture(scope="module")
def tables(spark):
    airports = spark.createDataFrame(
        [("AAAA", "A", 52.31, 4.764, 1.0, "EU"), ("BBBB", "B", 51.47, -0.4543, 2.0, "EU"),
         ("CCCC", "C", 40.64, -73.78, 3.0, None), ("DDDD", "D", 1.36, 103.99, 4.0, "AS")],
        schemas.AIRPORTS,
    )
    ends = [("a1", "AAAA", "BBBB"), ("a1", "AAAA", "CCCC"), ("a2", "CCCC", "DDDD"), ("a2", "AAAA", "AAAA"),
            ("a2", None, "BBBB"), ("a3", "AAAA", "ZZZZ"), ("a1", "AAAA", "BBBB"), ("a4", "BBBB", "AAAA"),
            ("a2", "BBBB", "AAAA")]
    flights = spark.createDataFrame(
        [(a, f"C{i + 1}", dep, arr, DAY, DAY, "1551402000") for i, (a, dep, arr) in enumerate(ends)], schemas.FLIGHTS
    )
    aircraft = spark.createDataFrame([("a1", "R1"), ("a2", "R2"), ("a3", "R3")], schemas.AIRCRAFT)
    fleet = spark.createDataFrame(
        [("R1", "T1", "Passenger", "M1"), ("R2", "T2", "Freighter", "M2"), ("R3", "T1", "Space tug", "M1")],
        f"`{schemas.FLEET_REGISTRATION}` string, `{schemas.FLEET_TYPE}` string, Role string, `{schemas.FLEET_MANUFACTURER}` string",
    )
    distances = [100.0, 500.0, 1000.0, 2000.0, 4000.0]
    cells = [100 + 2 * d + 0.01 * d**2 + 0.00001 * d**3 for d in distances]
    grid = spark.createDataFrame(
        [("T1", *cells), ("T3", *[None] * 5)], "Type string, " + ", ".join(f"`{d:.0f}` double" for d in distances)
    )
    rates = spark.createDataFrame(
        [("T2", 8.0, 1.0, 2.0), ("T2", 10.0, 1.0, 2.0), ("T2", 10.0, 5.0, 9.0), ("T1", 99.0, 1.0, 2.0), ("T3", 5.0, 1.0, 2.0)],
        schemas.FUEL_RATE,
    )
    return dict(flights=flights, airports=airports, aircraft=aircraft, fleet=fleet, grid=grid, rates=rates)


def test_eu_flights(tables, rows):
    found = em.eu_flights(tables["flights"], tables["airports"])
    assert found.columns == schemas.FLIGHTS.names
    assert rows(found, "callsign") == [("C1",), ("C2",), ("C6",), ("C7",), ("C8",), ("C9",)]


def test_enriched_flights(tables):
    found = {r.callsign: r for r in em.enriched_flights(tables["flights"], tables["airports"], tables["aircraft"]).collect()}
    assert found["C1"].distance == pytest.approx(200.00883124359655)
    assert found["C6"].distance is None and found["C8"].registration is None
    assert found["C1"].registration == "R1" and found["C1"].lastseen.isoformat().startswith("2019-03-01T")


def lookups(tables):
    return enrich.aircraft_lookup(tables["aircraft"], tables["fleet"]), em.fuel_lookup(tables["grid"], tables["rates"])


def test_typed_flights_merge_callsigns(tables, rows):
    found = em.typed_flights(tables["flights"], tables["airports"], lookups(tables)[0])
    assert found.columns == em.FLIGHT_COLUMNS
    ends = rows(found, "aircraft_ICAO24", "flight_departure", "flight_arrival")
    assert ends == [("a1", "AAAA", "BBBB"), ("a1", "AAAA", "CCCC"), ("a2", "BBBB", "AAAA"), ("a3", "AAAA", "ZZZZ")]


def test_rate_table_and_lookup(tables, rows):
    assert rows(em.rate_table(tables["rates"], tables["grid"])) == [("T2", 10.0)]
    lookup = {r.aircraft_type: r for r in lookups(tables)[1].collect()}
    assert set(lookup) == {"T1", "T2"}
    assert [lookup["T1"][f"c{k}"] for k in range(4)] == pytest.approx([100, 2, 0.01, 0.00001], rel=1e-6)
    assert lookup["T1"].rate is None and lookup["T2"].rate == 10.0 and lookup["T2"].c0 is None


@pytest.mark.parametrize("form", ["as_written", "cubic"])
def test_emissions(tables, form):
    aircraft, lookup = lookups(tables)
    found = em.emissions(tables["flights"], tables["airports"], aircraft, lookup, form)
    assert found.columns == schemas.EMISSIONS.names
    by_end = {(r.aircraft_ICAO24, r.flight_arrival): r for r in found.collect()}
    assert set(by_end) == {("a1", "BBBB"), ("a1", "CCCC"), ("a2", "AAAA")}
    freight, short, long = by_end["a2", "AAAA"], by_end["a1", "BBBB"], by_end["a1", "CCCC"]
    assert freight.aircraft_role == "Cargo" and short.aircraft_role == "Passenger"
    assert freight.aircraft_fuelburn == pytest.approx(2000.0883124359655) and freight.CO2 == pytest.approx(6320.28, abs=0.01)
    for r in (short, long):
        x = r.flight_distance
        fuel = 100 + 2 * x + 0.01 * x + 0.00001 if form == "as_written" else 100 + 2 * x + 0.01 * x**2 + 0.00001 * x**3
        assert r.aircraft_fuelburn == pytest.approx(fuel, rel=1e-6) and r.CO2 == pytest.approx(fuel * 3.16, rel=1e-6)


def test_unmapped_roles(tables, rows):
    assert rows(em.unmapped_roles(tables["fleet"])) == [("Space tug", 1)]


def test_reports(tables, rows):
    aircraft, lookup = lookups(tables)
    found = em.emissions(tables["flights"], tables["airports"], aircraft, lookup, "as_written").cache()
    by_day = reports.daily_flights_and_co2(found).first()
    assert by_day.flights == 3 and by_day.CO2_daily == pytest.approx(reports.daily_co2(found).first().daily_CO2)
    assert {r.aircraft_role for r in reports.co2_day_role(found).collect()} == {"Cargo", "Passenger"}
    year = (date(2019, 1, 1), date(2019, 12, 31))
    assert reports.total_co2(found, *year).first().CO2 == pytest.approx(by_day.CO2_daily)
    assert reports.total_co2(found, date(2018, 1, 1), date(2018, 12, 31)).first().CO2 == 0
    first = reports.co2_by_type(found, *year, divisor=1000.0).collect()
    assert [r.aircraft_type for r in first] == ["T1", "T2"] and first[1].total_CO2 == 6
    clean = reports.daily_co2_by_role_clean(found, found.limit(0))
    assert {r.aircraft_role for r in clean.collect()} == {"Cargo", "Passenger"}


def test_grid_with_manufacturer(tables, rows):
    found = reports.grid_with_manufacturer(tables["grid"], tables["fleet"])
    assert {r.manu for r in found.collect()} == {"M1"} and found.count() == 5
    rates = em.rate_table(tables["rates"], tables["grid"]).unionByName(tables["rates"].sparkSession.createDataFrame([("A320", 1.0), ("B738", 2.0)], "type string, fuelburn double"))
    assert [r.type for r in reports.selected_rates(rates).collect()] == ["A320", "B738"]


@pytest.fixture(scope="module")
def monthly(spark):
    data = [  # callsign, registration, typecode, origin, destination, seconds
        ("K1", "R1", "T1", "AAAA", "BBBB", 5), ("K1", None, None, "AAAA", "BBBB", 1), ("K1", "R2", "T2", "AAAA", "BBBB", 9),
        ("K2", None, None, "BBBB", "AAAA", 2), ("K2", None, None, "BBBB", "CCCC", 1), ("K3", "R3", "T1", "CCCC", "DDDD", 1),
        ("K4", "R3", None, "AAAA", "AAAA", 1), ("K5", "R2", None, "AAAA", "CCCC", 1), (None, None, None, "AAAA", "BBBB", 3),
    ]
    df = spark.createDataFrame(data, "callsign string, registration string, typecode string, origin string, destination string, s long")
    return df.withColumn("firstseen", F.timestamp_seconds("s")).withColumn("icao24", F.lit("a")).withColumn("day", F.lit(date(2020, 1, 1))).drop("s")


def test_prototype(monthly, tables, rows):
    located = prototype.located_flights(monthly, tables["airports"])
    assert {"departure_name", "departure_elevation_ft", "arrival_continent"} <= set(located.columns)
    assert located.count() == 7
    assert rows(prototype.callsign_types(located)) == [("K1", "R1", "T1")]
    imputed = prototype.impute_types(located)
    assert imputed.columns == located.columns
    assert rows(imputed.filter("callsign = 'K1'"), "registration", "typecode") == [("R1", "T1"), ("R1", "T1"), ("R2", "T2")]
    missing = prototype.unresolved(imputed)
    assert rows(missing, "callsign", "destination") == [(None, "BBBB"), ("K2", "CCCC"), ("K5", "CCCC")]
    known = tables["flights"].sparkSession.createDataFrame([("K2", "x")], schemas.CALLSIGNS)
    assert rows(prototype.not_looked_up(missing, known), "callsign") == [(None,), ("K5",)]
    assert rows(prototype.lookup_links(missing, "u/"), "link") == [("u/K2",), ("u/K5",), ("u/NA",)]
    model = em.fuel_model(tables["grid"])
    flown = prototype.prototype_emissions(imputed, tables["fleet"], model, "as_written")
    daily = prototype.co2_per_day_and_role(flown).collect()
    assert [(r.day, r.aircraft_role) for r in daily] == [(date(2020, 1, 1), "Passenger")]
    x = 200.00883124359655
    assert daily[0].CO2 == pytest.approx(2 * 3.16 * (100 + 2 * x + 0.01 * x + 0.00001), rel=1e-6)


def test_forecast_table(spark):
    import numpy as np

    from flightlens.operators import series

    rng = np.random.default_rng(1)
    days = spark.range(731 + 120).selectExpr("date_add(DATE'2018-01-01', cast(id as int)) as day", "id")
    weights = F.array(*[F.lit(float(v)) for v in 100 + rng.normal(0, 3, 851)])
    facts = days.withColumn("CO2", F.get(weights, F.col("id").cast("int")) + F.col("id") % 7 * 10)
    daily = series.daily_series(facts, "day", "CO2")
    train = forecasts.cleaned_series(series.period(daily, date(2018, 1, 1), date(2019, 12, 31)))
    actual = forecasts.cleaned_series(series.period(daily, date(2020, 1, 1), None))
    table = forecasts.forecast_vs_actual(
        train, actual, forecasts.CO2, 2018, value="CO2", divisor=1000.0, shown_from=date(2019, 10, 1), shown_to=date(2020, 4, 20)
    ).cache()
    found = {(r.date, r.data_source): r.CO2 for r in table.collect()}
    assert min(d for d, _ in found) == date(2019, 10, 1) and max(d for d, _ in found) == date(2020, 4, 20)
    assert found[date(2019, 12, 1), "real"] == found[date(2019, 12, 1), "forecast"]
    errors = [abs(found[d, "real"] - v) for (d, s), v in found.items() if s == "forecast" and d.year == 2020 and found.get((d, "real"))]
    assert len(errors) > 100 and sum(errors) / len(errors) < 0.08
