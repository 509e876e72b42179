import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightlens import schemas
from flightlens.operators import aggregate, clean, enrich, polyfit, reshape


# --- clean ---


def test_drop_na(spark, rows):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, float("nan"), "c"), (4, 2.0, None)], "i int, x double, s string")
    assert rows(clean.drop_na(df, ["x"]), "i") == [(1,), (4,)]
    assert rows(clean.drop_na(df), "i") == [(1,)]


def test_different_airports_drops_null(spark, rows):
    df = spark.createDataFrame([("A", "B"), ("A", "A"), (None, "B"), ("A", None)], "d string, a string")
    assert rows(clean.different_airports(df, "d", "a")) == [("A", "B")]


def test_touches_region_truth_table(spark, rows):
    codes = ["EU", "AS", None]
    df = spark.createDataFrame([(d, a) for d in codes for a in codes], "d string, a string")
    kept = set(rows(clean.touches_region(df, "d", "a", "EU")))
    assert kept == {(d, a) for d in codes for a in codes if "EU" in (d, a)}


def test_date_range(spark, rows):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(["2018-12-31", "2019-01-01", "2019-12-31", "2020-01-01", None])], "i int, d string").withColumn("d", F.to_timestamp("d"))
    both = (date(2019, 1, 1), date(2019, 12, 31))
    assert rows(clean.date_range(df, "d", *both), "i") == [(1,), (2,)]
    assert rows(clean.date_range(df, "d", start=both[0]), "i") == [(1,), (2,), (3,)]
    assert rows(clean.date_range(df, "d", *both, combine="or"), "i") == [(0,), (1,), (2,), (3,)]
    with pytest.raises(ValueError):
        clean.date_range(df, "d")


def test_keep_group_max(spark, rows):
    df = spark.createDataFrame(
        [("a", 5, 1), ("a", 5, 2), ("a", 3, 3), ("b", 5, 4), ("b", None, 5), (None, 1, 6), (None, 2, 7)], "k string, v int, i int"
    )
    assert rows(clean.keep_group_max(df, ["k"], "v"), "i") == [(1,), (2,), (7,)]


def test_first_per_key(spark, rows):
    data = [("x", 2, "late"), ("x", 1, "early"), ("x", None, "never"), ("y", None, "b"), ("y", None, "a"), (None, 1, "n")]
    df = spark.createDataFrame(data, "k string, t int, v string")
    found = clean.first_per_key(df, "k", ["t"])
    assert found.columns == ["k", "t", "v"]
    assert rows(found) == [(None, 1, "n"), ("x", 1, "early"), ("y", None, "a")]
    assert rows(clean.first_per_key(df.repartition(3, "v"), "k", ["t"])) == rows(found)


# --- enrich ---


def test_attach_airports(spark, rows):
    airports = spark.createDataFrame([("A", "EU", 1.0), ("B", None, 2.0)], "ICAO string, continent string, longitude_deg double")
    flights = spark.createDataFrame([("A", "B"), ("A", "Z")], "d string, a string")
    found = enrich.attach_airports(flights, airports, "d", "a", ["continent", "longitude_deg"])
    assert found.columns == ["d", "a", "departure_continent", "departure_longitude_deg", "arrival_continent", "arrival_longitude_deg"]
    assert rows(found) == [("A", "B", "EU", 1.0, None, 2.0), ("A", "Z", "EU", 1.0, None, None)]


def test_unknown_address_matches_unknown_address(spark, rows):
    aircraft = spark.createDataFrame([("a1", "R1"), (None, "R0")], "icao24 string, registration string")
    flights = spark.createDataFrame([("a1", 1), (None, 2), ("a9", 3)], "icao24 string, i int")
    assert rows(enrich.attach_registration(flights, aircraft), "i", "registration") == [(1, "R1"), (2, "R0"), (3, None)]


def fleet(spark, data):
    columns = [schemas.FLEET_REGISTRATION, schemas.FLEET_TYPE, schemas.FLEET_ROLE, schemas.FLEET_MANUFACTURER]
    return spark.createDataFrame(data, ", ".join(f"`{c}` string" for c in columns))


def test_lookup_equals_two_joins(spark, rows):
    sheet = fleet(spark, [("R1", "T1", "P", "M"), ("R1", "T2", "P", "M"), ("R2", None, "P", "M"), (None, "T1", "P", "M"), ("R0", "T3", None, "M")])
    aircraft = spark.createDataFrame([("a1", "R1"), ("a1", "R1"), ("a2", "R2"), ("a3", None), (None, "R0")], "icao24 string, registration string")
    flights = spark.createDataFrame([("a1", 1), ("a2", 2), ("a3", 3), (None, 4), ("a9", 5)], "icao24 string, i int")
    columns = ["i", "icao24", "registration", "aircraft_type", "aircraft_role"]
    chained = enrich.attach_fleet(enrich.attach_registration(flights, aircraft), sheet)
    single = enrich.attach_aircraft(flights, enrich.aircraft_lookup(aircraft, sheet))
    assert rows(single, *columns) == rows(chained, *columns)
    assert len(rows(single)) == 5


def test_type_manufacturers(spark, rows):
    sheet = fleet(spark, [("1", "T1", "P", "M"), ("2", "T1", "P", "M"), ("3", "T1", "P", "N"), ("4", "T2", "P", None)])
    assert rows(enrich.type_manufacturers(sheet)) == [("T1", "M"), ("T1", "N")]


def test_semi_and_anti(spark, rows):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "aircraft_type string, i int")
    types = spark.createDataFrame([("a",), ("a",), (None,)], "aircraft_type string")
    assert rows(enrich.only_types(df, types), "i") == [(1,)]
    assert rows(enrich.unknown_to(df, types, "aircraft_type"), "i") == [(2,)]


# --- reshape ---


def test_unpivot_counts_and_nulls(spark):
    rng = random.Random(2)
    data = [(f"T{i}", *[rng.choice([None, rng.random()]) for _ in range(4)]) for i in range(20)]
    wide = spark.createDataFrame(data, "Type string, `125` double, `250` double, `500` double, note double")
    long = reshape.unpivot_all_but(wide, ["Type"], "distance", "fuelburn")
    assert long.count() == 20 * 4
    points = reshape.grid_points(wide.drop("note"))
    assert points.count() == sum(v is not None for row in data for v in row[1:4])
    assert dict(points.dtypes) == {"type": "string", "distance": "double", "fuelburn": "double"}
    assert reshape.grid_points(wide).count() == points.count()  # a header that is no number is dropped


def test_unpivot_named(spark, rows):
    df = spark.createDataFrame([("T", 9.0, 1.0, 2.0)], "Type_Code string, rate double, lo double, hi double")
    assert rows(reshape.unpivot_named(df, ["lo", "hi"], "distance")) == [("T", 9.0, "hi", 2.0), ("T", 9.0, "lo", 1.0)]


def test_nest(spark):
    df = spark.createDataFrame([("T", 2.0, 20.0), ("T", 1.0, 10.0)], "type string, distance double, fuelburn double")
    assert [tuple(p) for p in reshape.nest_points(df).first()["data"]] == [(1.0, 10.0), (2.0, 20.0)]


def test_pivot_wide(spark, rows):
    df = spark.createDataFrame([("k", "a", 1), ("k", "a", 2), ("k", "c", 5)], "k string, n string, v int")
    wide = reshape.pivot_wide(df, ["k"], "n", ["a", "b", "c"], F.collect_list("v"))
    found = wide.first()
    assert sorted(found["a"]) == [1, 2] and not found["b"] and found["c"] == [5]
    with pytest.raises(ValueError, match="'c'"):
        reshape.pivot_wide(df, ["k"], "n", ["a", "b"], F.collect_list("v"))


def test_select_prefix(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "id int, `Engine Type` int, `aircraft x` int, other int")
    assert reshape.select_prefix(df, ["Engine", "Aircraft"], ["id"]).columns == ["id", "Engine Type", "aircraft x"]


def test_bind_rows(spark, rows):
    a = spark.createDataFrame([(1, 2)], "a int, b int")
    b = spark.createDataFrame([(4, 3, 5)], "b int, a int, c int")
    found = reshape.bind_rows(a, b)
    assert found.columns == ["a", "b", "c"]
    assert rows(found) == [(1, 2, None), (3, 4, 5)]
    assert reshape.bind_distinct(a, a).count() == 1


# --- aggregate ---


def test_sums_and_counts(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None)], "k string, v double")
    assert rows(aggregate.sum_by(df, ["k"], "v", "s")) == [("a", 3.0), ("b", None)]
    assert rows(aggregate.count_by(df, ["k"], "n")) == [("a", 2), ("b", 1)]
    assert rows(aggregate.count_and_sum_by(df, ["k"], "v", "n", "s")) == [("a", 2, 3.0), ("b", 1, None)]
    assert aggregate.total(df, "v", "t").first()["t"] is None
    assert aggregate.total(df.filter("k = 'a'"), "v", "t").first()["t"] == 3.0
    assert aggregate.total(df.filter("k = 'z'"), "v", "t").first()["t"] == 0.0


def test_sum_does_not_depend_on_partitions(spark, rows):
    df = spark.range(1000).selectExpr("id % 7 as k", "id as v")
    expected = rows(aggregate.sum_by(df, ["k"], "v", "s"))
    for n in (1, 3, 16):
        assert rows(aggregate.sum_by(df.repartition(n), ["k"], "v", "s")) == expected


def test_sort_order(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "v int")
    assert [r.v for r in df.orderBy(*aggregate.ascending("v")).collect()] == [1, 2, None]
    assert [r.v for r in df.orderBy(*aggregate.descending("v")).collect()] == [2, 1, None]


def test_outliers(spark, rows):
    values = [1.0, 2.0, 3.0, 4.0, 7.0, 9.0, 100.0, 5.0, None]
    df = spark.createDataFrame([(k, i, v) for k in ("g", None) for i, v in enumerate(values)], "k string, i int, v double")
    fences = aggregate.outlier_fences(df, ["k"], "v").first()
    assert (fences["low"], fences["high"]) == (-4.375, 14.625)
    expected = [(i, None if v == 100.0 else v) for i, v in enumerate(values)]
    for key in ("k = 'g'", "k is null"):
        assert rows(aggregate.remove_outliers(df, ["k"], "v").filter(key), "i", "v") == expected


def test_value_on_fence_is_kept(spark, rows):
    base = [2.0, 2.0, 4.0, 4.0, 4.0]
    df = spark.createDataFrame([("g", v) for v in [*base, 7.0, 7.1]], "k string, v double")
    q1, q3 = np.quantile([*base, 7.0, 7.1], [0.25, 0.75])
    kept = [v for (v,) in rows(aggregate.remove_outliers(df, ["k"], "v"), "v")]
    assert kept == sorted([v for v in [*base, 7.0, 7.1] if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)])
    flat = spark.createDataFrame([("g", 1.0)] * 5 + [("g", 1.5)], "k string, v double")
    assert rows(aggregate.remove_outliers(flat, ["k"], "v"), "v") == [(None,)] + [(1.0,)] * 5


# --- fit ---


def points(spark, data):
    return spark.createDataFrame(data, "type string, distance double, fuelburn double")


def test_fit_recovers_cubic(spark):
    exact = [("T", x, 100 + 2 * x + 0.01 * x**2 + 0.00001 * x**3) for x in (125.0, 250.0, 500.0, 1000.0, 3000.0)]
    found = polyfit.fit_polynomial(points(spark, exact), "type", "distance", "fuelburn").first()
    assert [found[f"c{k}"] for k in range(4)] == pytest.approx([100, 2, 0.01, 0.00001], rel=1e-8)
    assert found["n"] == 5


def test_fit_far_from_zero(spark):
    exact = [("T", 8000.0 + 20 * k, 5 + 2 * (8000.0 + 20 * k) + 1e-6 * (8000.0 + 20 * k) ** 3) for k in range(11)]
    found = polyfit.fit_polynomial(points(spark, exact), "type", "distance", "fuelburn").first()
    assert found["c1"] == pytest.approx(2, rel=1e-3) and found["c3"] == pytest.approx(1e-6, rel=1e-6)
    assert abs(found["c2"]) < 1e-7 and found["c0"] == pytest.approx(5, abs=5)


def test_fit_too_few_points(spark):
    few = [("T", x, x) for x in (1.0, 2.0, 3.0)] * 4 + [("T", None, 1.0), ("T", 4.0, None)]
    found = polyfit.fit_polynomial(points(spark, few), "type", "distance", "fuelburn").first()
    assert [found[f"c{k}"] for k in range(4)] == [None] * 4


def test_fit_matches_least_squares(spark):
    rng = np.random.default_rng(5)
    data = []
    for group in range(4):
        x = rng.uniform(50, 8000, 300)
        data += [(f"G{group}", float(a), float(b)) for a, b in zip(x, 500 + 3 * x + rng.normal(0, 900, 300))]
    fitted = {r["type"]: r for r in polyfit.fit_polynomial(points(spark, data), "type", "distance", "fuelburn").collect()}
    for group in fitted:
        x = np.array([a for g, a, _ in data if g == group])
        y = np.array([b for g, _, b in data if g == group])
        scale = x.max()
        dense = np.linalg.lstsq(np.vander(x / scale, 4, increasing=True), y, rcond=None)[0] / scale ** np.arange(4)
        assert [fitted[group][f"c{k}"] for k in range(4)] == pytest.approx(list(dense), rel=1e-7)
