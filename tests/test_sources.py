from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from flightlens import schemas
from flightlens.sources import readers, writers


def put(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_null_tokens(spark, tmp_path, rows):
    path = put(tmp_path, "a.csv", 'icao24,registration\nNA,R1\n,R2\n"",R3\n471e23,R4\n')
    found = readers.read_aircraft(spark, path)
    assert rows(found.select("registration", "icao24")) == [("R1", None), ("R2", None), ("R3", None), ("R4", "471e23")]


def test_continent_na_is_unknown(spark, tmp_path, rows):
    path = put(tmp_path, "p.csv", "id,ICAO,name,latitude_deg,longitude_deg,elevation_ft,continent\n1,KJFK,\"Kennedy, JFK\",40.6,-73.7,13,NA\n")
    assert rows(readers.read_airports(spark, path)) == [("KJFK", "Kennedy, JFK", 40.6, -73.7, 13.0, None)]


def test_flight_files_bind_by_name(spark, tmp_path, rows):
    head = "callsign,icao24,estdepartureairport,estarrivalairport,day,firstseen,lastseen"
    put(tmp_path, "flightlist_1.csv", f"{head}\nC1,a1,AAAA,BBBB,2019-03-01,1,2\n")
    put(tmp_path, "flightlist_2.csv", "icao24,callsign,estarrivalairport,estdepartureairport,day,extra\na2,C2,DDDD,CCCC,2019-03-02,x\n")
    put(tmp_path, "flightlist_3.csv", f"{head}\nC3,a3,AAAA,BBBB,2019-03-03,1,2\n")
    put(tmp_path, "flightlist_4.csv", "")
    put(tmp_path, "other.csv", f"{head}\nC9,a9,A,B,d,1,2\n")
    (tmp_path / "2020").mkdir()
    put(tmp_path / "2020", "flightlist_9.csv", f"{head}\nC9,a9,A,B,d,1,2\n")
    found = readers.read_flight_files(spark, str(tmp_path))
    assert found.schema.names == schemas.FLIGHTS.names
    assert rows(found) == [
        ("a1", "C1", "AAAA", "BBBB", "2019-03-01", "1", "2"),
        ("a2", "C2", "CCCC", "DDDD", "2019-03-02", None, None),
        ("a3", "C3", "AAAA", "BBBB", "2019-03-03", "1", "2"),
    ]


def test_no_matching_file(spark, tmp_path):
    put(tmp_path, "x.csv", "a\n1\n")
    assert readers.read_flight_files(spark, str(tmp_path)).count() == 0


def test_flights_2020_rename(spark, tmp_path, rows):
    put(tmp_path, "flightlist_2020.csv", "callsign,icao24,origin,destination,day,firstseen,lastseen\nC1,a1,AAAA,BBBB,d,f,l\n")
    found = readers.read_flights_2020(spark, str(tmp_path))
    assert rows(found.select("estdepartureairport", "estarrivalairport")) == [("AAAA", "BBBB")]


def test_typed_flights(spark, tmp_path, rows):
    path = put(
        tmp_path, "f.csv",
        "callsign,number,icao24,registration,typecode,origin,destination,firstseen,lastseen,day\n"
        "C1,7,a1,R1,A320,AAAA,BBBB,2020-01-01 00:10:00+00:00,2020-01-01 01:00:05+00:00,2020-01-01 00:00:00+00:00\n"
        "C2,,a2,,,AAAA,,junk,NA,\n",
    )
    found = readers.read_flights_typed(spark, path)
    assert dict(found.dtypes)["day"] == "date" and dict(found.dtypes)["firstseen"] == "timestamp"
    text = found.select("callsign", "typecode", "day", F.date_format("lastseen", "yyyy-MM-dd HH:mm:ss").alias("l"))
    assert rows(text) == [("C1", "A320", date(2020, 1, 1), "2020-01-01 01:00:05"), ("C2", None, None, None)]


def test_preamble_csv(spark, tmp_path, rows):
    body = "".join(f"note {i},,\n" for i in range(9)) + "\n"
    head = "Role,Tail/Registration Number,Engine Type,aircraft Variant ICAO Code,Aircraft Manufacturer,Base\n"
    path = put(tmp_path, "fleet.csv", body + head + '"Combi","R1",E,A320,"Air, Bus",X\nNA,R2,,,"",Y\n')
    found = readers.read_fleet(spark, path)
    assert found.columns == ["Tail/Registration Number", "Role", "Engine Type", "aircraft Variant ICAO Code", "Aircraft Manufacturer"]
    assert rows(found) == [("R1", "Combi", "E", "A320", "Air, Bus"), ("R2", None, None, None, None)]


def test_preamble_of_a_file_in_several_splits(spark, tmp_path):
    lines = ["preamble"] * 10 + ["a,b"] + [f"{i},{'x' * 50}" for i in range(4000)]
    path = put(tmp_path, "big.csv", "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = readers.read_csv_skip(spark, path)
        assert found.rdd.getNumPartitions() > 3
        assert found.count() == 4000
        assert found.select(F.sum("a")).first()[0] == sum(range(4000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_fuel_tables(spark, tmp_path, rows):
    grid = readers.read_fuel_grid(spark, put(tmp_path, "grid.csv", "Type,125,250.5\nA320,1000,NA\n"))
    assert grid.columns == ["Type", "125", "250.5"] and rows(grid) == [("A320", 1000.0, None)]
    rates = readers.read_fuel_rates(
        spark, put(tmp_path, "rates.csv", "Aircraft,Type_Code,maximum range nm,Minimum range nm,Fuel burn kg/nm\nx,A388,8000,100,17.5\n")
    )
    assert rows(rates) == [("A388", 17.5, 100.0, 8000.0)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("a", datetime(2019, 1, 1, 6), 1.5, "x"), ("b", None, None, None), ("c", datetime(2020, 2, 29, 23, 59, 59), 2.0, "")],
        "k string, ts timestamp, v double, s string",
    ).withColumn("ntz", F.col("ts").cast("timestamp_ntz"))
    out = str(tmp_path / "out")
    writers.write_csv(df.coalesce(1), out)
    text = next((tmp_path / "out").glob("*.csv")).read_text().splitlines()
    assert text[0] == "k,ts,v,s,ntz"
    assert sorted(text[1:]) == [
        "a,2019-01-01T06:00:00Z,1.5,x,2019-01-01T06:00:00Z", "b,NA,NA,NA,NA",
        "c,2020-02-29T23:59:59Z,2.0,,2020-02-29T23:59:59Z",
    ]
    with pytest.raises(Exception, match="(?i)already exists"):
        writers.write_csv(df, out)


def test_emissions_round_trip_prunes_years(spark, tmp_path, rows):
    row = {n: None for n in schemas.EMISSIONS.names}
    data = [{**row, "flight_day": datetime(y, 1, d), "CO2": float(y + d)} for y in (2018, 2019) for d in (1, 2, 3)]
    df = spark.createDataFrame([tuple(r[n] for n in schemas.EMISSIONS.names) for r in data], schemas.EMISSIONS)
    path = str(tmp_path / "emissions")
    writers.write_emissions(df, path)
    back = readers.read_emissions(spark, path)
    assert set(back.columns) == {*schemas.EMISSIONS.names, "flight_year"}
    one = back.filter("flight_year = 2019")
    assert rows(one, "CO2") == [(2020.0,), (2021.0,), (2022.0,)]
    days = readers.read_emissions(spark, path, date(2018, 1, 3), date(2018, 1, 31))
    assert rows(days, "CO2") == [(2021.0,)]
    for df in (one, days):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(flight_year" in text
