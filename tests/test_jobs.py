"""From CSV files on disk to written tables and reports."""

from datetime import date, timedelta

import numpy as np
import pytest

from flightlens.plans import jobs
from flightlens.sources import readers


@pytest.fixture(scope="module")
def sources(tmp_path_factory):
    folder = tmp_path_factory.mktemp("data")

    def put(name, text):
        (folder / name).parent.mkdir(exist_ok=True)
        (folder / name).write_text(text)
        return str(folder / name)

    rng = np.random.default_rng(0)
    planes, ends = ["a1", "a2", "a9"], [("AAAA", "BBBB"), ("BBBB", "AAAA"), ("AAAA", "CCCC"), ("CCCC", "DDDD")]
    old, new, n = [], [], 0
    for i in range(900):
        day = date(2018, 1, 1) + timedelta(days=i)
        for _ in range(6 + i % 7 + int(rng.integers(0, 3))):
            n += 1
            dep, arr = ends[n % 4]
            row = (planes[n % 3], f"C{n}", dep, arr, f"{day} 00:00:00+00:00", f"{day} 0{n % 9}:00:00+00:00", f"{day} 1{n % 9}:{n % 60:02d}:{n % 7:02d}+00:00")
            (old if day.year < 2020 else new).append(row)
    text = "\n".join(",".join(r) for r in old)
    put("flights/flightlist_a.csv", f"icao24,callsign,estdepartureairport,estarrivalairport,day,firstseen,lastseen\n{text}\n")
    text = "\n".join(",".join((r[1], r[0], *r[2:])) for r in new)
    put("flights/flightlist_2020_b.csv", f"callsign,icao24,origin,destination,day,firstseen,lastseen\n{text}\n")
    preamble = "x\n" * 10
    return jobs.Sources(
        flights=str(folder / "flights"),
        airports=put("airports.csv", "ICAO,name,latitude_deg,longitude_deg,elevation_ft,continent\nAAAA,A,52.31,4.764,0,EU\nBBBB,B,51.47,-0.4543,0,EU\nCCCC,C,40.64,-73.78,0,NA\nDDDD,D,1.36,103.99,0,AS\n"),
        aircraft=put("aircraft.csv", "icao24,registration\na1,R1\na2,R2\na9,\n"),
        fleet=put("fleet.csv", preamble + "Tail/Registration Number,Role,Aircraft Variant ICAO Code,Aircraft Manufacturer\nR1,Passenger,A320,Airbus\nR2,Freighter,B77L,Boeing\n"),
        fuel_grid=put("grid.csv", "Type,125,500,1000,2000,4000\nA320,900,2300,4100,8000,16500\n"),
        fuel_rates=put("rates.csv", "Type_Code,Fuel burn kg/nm,Minimum range nm,maximum range nm\nB77L,14.5,1,9000\nA320,9,1,2\nE190,5,1,2\n"),
    )


@pytest.fixture(scope="module")
def built(spark, sources, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    old = jobs.load_flights(spark, sources, date(2018, 1, 1), date(2019, 12, 31), "flightlist_a.*")
    new = jobs.load_flights(spark, sources, date(2020, 1, 1), date(2020, 12, 31), "flightlist_2020.*", layout_2020=True)
    history = jobs.build_emissions(spark, sources, old, f"{out}/history", "as_written")
    latest = jobs.build_emissions(spark, sources, new, f"{out}/latest", "as_written")
    return history, latest


def test_emissions_written(built):
    history, latest = built
    assert {r.aircraft_role for r in history.select("aircraft_role").distinct().collect()} == {"Passenger", "Cargo"}
    years = sorted(r.flight_year for r in history.select("flight_year").distinct().collect())
    assert years == [2018, 2019] and latest.count() > 100
    assert history.dropna().count() == history.count() > 1000


def test_exports(spark, sources, tmp_path):
    jobs.export_fuel_tables(spark, sources, str(tmp_path))
    grid = spark.read.option("header", True).csv(str(tmp_path / "fuel_grid"))
    assert grid.columns == ["type", "manu", "distance", "fuelburn"] and grid.count() == 5
    rates = spark.read.option("header", True).csv(str(tmp_path / "fuel_rates"))
    assert [tuple(r) for r in rates.collect()] == [("B77L", "14.5")]


def test_reports(built):
    tables = jobs.report_tables(*built, date(2019, 1, 1), date(2019, 12, 31))
    assert {name: df.count() > 0 for name, df in tables.items()} == dict.fromkeys(tables, True)
    total = tables["total_co2"].first().CO2
    assert total == pytest.approx(sum(r.CO2 for r in built[0].filter("flight_year = 2019").select("CO2").collect()))
    assert tables["daily_flights_and_co2"].count() == 730


def test_forecasts(built):
    tables = jobs.forecast_tables(*built, date(2018, 1, 1), date(2019, 12, 31), date(2019, 10, 1), date(2020, 4, 20))
    for name in ("ATM", "CO2"):
        found = tables[name].collect()
        assert {r.data_source for r in found} == {"real", "forecast"}
        assert len(found) == 2 * ((date(2020, 4, 20) - date(2019, 10, 1)).days + 1)
        assert all(r[name] > 0 for r in found)


def test_co2_as_written_counts_days_of_all_years(built):
    history, latest = built
    bounds = (date(2019, 1, 1), date(2019, 12, 31))
    tables = jobs.forecast_tables(history, latest, *bounds, co2_as_written=True)
    assert tables["ATM"].agg({"date": "min"}).first()[0] == date(2019, 1, 1)
    # bounds joined by "or" keep 2018 too; the cut leaves one year and a day, which begins in 2018
    found = tables["CO2"].filter("data_source = 'forecast'")
    assert found.agg({"date": "min"}).first()[0] == date(2018, 1, 1) and found.count() == 366 + 365


def test_earlier_variant(spark, sources, tmp_path):
    def row(callsign, plane, tail, kind, dep, arr, day):
        return f"{callsign},{plane},{tail},{kind},{dep},{arr},{day} 08:00:00+00:00,{day} 10:00:00+00:00,{day} 00:00:00+00:00"

    (tmp_path / "typed.csv").write_text(
        "\n".join(
            [
                "callsign,icao24,registration,typecode,origin,destination,firstseen,lastseen,day",
                row("C1", "a1", "R1", "A320", "AAAA", "BBBB", "2019-01-01"),
                row("C1", "a1", "", "", "BBBB", "CCCC", "2019-01-02"),
                row("C2", "a2", "", "", "AAAA", "CCCC", "2019-01-02"),
                row("C3", "a9", "", "", "BBBB", "AAAA", "2019-01-03"),
                row("C4", "a9", "", "", "CCCC", "DDDD", "2019-01-03"),
            ]
        )
        + "\n"
    )
    (tmp_path / "callsigns.csv").write_text("callsign,Unknown\nC3,x\n")
    tables = jobs.prototype_tables(spark, sources, str(tmp_path / "typed.csv"), str(tmp_path / "callsigns.csv"), "as_written")
    assert {r.callsign for r in tables["unresolved"].collect()} == {"C2", "C3"}
    assert [r.callsign for r in tables["links"].collect()] == ["C2"]
    assert sorted((str(r.day), r.registration) for r in tables["emissions"].collect()) == [("2019-01-01", "R1"), ("2019-01-02", "R1")]
    assert {(str(r.day), r.aircraft_role) for r in tables["co2_day_role"].collect()} == {("2019-01-01", "Passenger"), ("2019-01-02", "Passenger")}


def test_years_in_one_folder_are_kept_apart(spark, sources):
    both = jobs.load_flights(spark, sources, date(2020, 1, 1), date(2020, 12, 31))
    assert both.filter("estdepartureairport is not null").count() == 0
    assert readers.read_flights_2020(spark, sources.flights, "flightlist_2020.*").count() == both.count()
