import math
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from flightlens.functions import classify, fuel, geo, linalg, nulls, scalars


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(value, kind="double"):
    return F.lit(value).cast(kind)


def test_distance_known_value(spark):
    found = one(spark, geo.distance_nm(lit(4.764), lit(52.31), lit(-0.4543), lit(51.47)))
    assert found == pytest.approx(200.00883124359655, abs=1e-9)


def test_distance_equal_points_and_null(spark):
    assert one(spark, geo.distance_nm(lit(5.0), lit(50.0), lit(5.0), lit(50.0))) == 0
    for missing in range(4):
        ends = [lit(None if i == missing else 10.0 + i) for i in range(4)]
        assert one(spark, geo.distance_nm(*ends)) is None


def test_distance_symmetric_and_bounded(spark):
    rng = random.Random(1)
    points = [tuple(rng.uniform(a, b) for a, b in ((-180, 180), (-90, 90)) * 2) for _ in range(200)]
    points += [(0.0, 0.0, 180.0, 0.0), (10.0, 90.0, 50.0, -90.0), (-180.0, 0.0, 180.0, 0.0)]
    df = spark.createDataFrame(points, "a double, b double, c double, d double")
    a, b, c, d = (F.col(n) for n in "abcd")
    half = math.pi * geo.EARTH_RADIUS_M * geo.METRE_TO_NMI
    for there, back in df.select(geo.distance_nm(a, b, c, d), geo.distance_nm(c, d, a, b)).collect():
        assert there == pytest.approx(back, abs=1e-6)
        assert 0 <= there <= half + 1e-6


def test_polynomial_forms(spark):
    coefs = [lit(v) for v in (100.0, 2.0, 0.01, 0.00001)]
    assert one(spark, fuel.polynomial_fuel(*coefs, lit(1000.0), "as_written")) == pytest.approx(2110.00001)
    assert one(spark, fuel.polynomial_fuel(*coefs, lit(1000.0), "cubic")) == pytest.approx(22100)
    with pytest.raises(ValueError):
        fuel.polynomial_fuel(*coefs, lit(1.0), "other")


def test_rate_and_co2(spark):
    burnt = fuel.rate_fuel(lit(200.0), lit(10.0))
    assert one(spark, burnt) == 2000
    assert one(spark, fuel.co2(burnt)) == pytest.approx(6320)


def test_role_labels(spark):
    given = [*classify.ROLE_LABELS, "Space tug", None]
    df = spark.createDataFrame([(r,) for r in given], "role string").select(
        "role", classify.role_label(F.col("role")).alias("v")
    )
    found = {r.role: r.v for r in df.collect()}
    assert found == {**classify.ROLE_LABELS, "Space tug": None, None: None}
    assert set(classify.ROLE_LABELS.values()) == {"Non Commercial", "Combi", "Cargo", "Passenger"}
    assert len(classify.ROLE_LABELS) == 12


@pytest.mark.parametrize(
    "code, joined, expected", [("B77W", "X", "Boeing"), ("A320", "X", "X"), ("A320", None, None), ("RJ85", None, "Avro")]
)
def test_manufacturer(spark, code, joined, expected):
    assert one(spark, classify.manufacturer(F.lit(code), lit(joined, "string"))) == expected


@pytest.mark.parametrize("value, expected", [(0.5, 0), (1.5, 2), (2.5, 2), (-0.5, 0), (2.51, 3)])
def test_half_even(spark, value, expected):
    assert one(spark, scalars.round_half_even(lit(value))) == expected


def test_to_number(spark):
    assert one(spark, scalars.to_number(F.lit("125"))) == 125.0
    assert one(spark, scalars.to_number(F.lit("x"))) is None


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2019-01-01 00:00:00+00:00", datetime(2019, 1, 1)),
        ("2019-01-01T06:30:00Z", datetime(2019, 1, 1, 6, 30)),
        ("2019-01-01", datetime(2019, 1, 1)),
        ("1546300800", datetime(2019, 1, 1)),
        ("junk", None),
        (None, None),
    ],
)
def test_to_utc_timestamp(spark, text, expected):
    stamp = scalars.to_utc_timestamp(lit(text, "string"))
    assert one(spark, F.date_format(stamp, "yyyy-MM-dd HH:mm:ss")) == (expected and expected.strftime("%Y-%m-%d %H:%M:%S"))


@pytest.mark.parametrize(
    "year, day, expected",
    [
        (2019, 58, date(2019, 2, 28)), (2020, 58, date(2020, 2, 28)), (2020, 59, date(2020, 2, 29)),
        (2020, 60, date(2020, 3, 1)), (2020, 364, date(2020, 12, 30)), (2018, 0, date(2018, 1, 1)),
    ],
)
def test_decimal_year(spark, year, day, expected):
    value = scalars.decimal_year(year, F.lit(day + 1))
    assert one(spark, scalars.decimal_year_to_date(value)) == expected


def test_decimal_year_covers_every_day(spark):
    t = spark.range(1, 1462).select(scalars.decimal_year_to_date(scalars.decimal_year(2017, F.col("id"))).alias("d"))
    found = [r.d for r in t.collect()]
    assert len(set(found)) == len(found) and found[365] == date(2018, 1, 1) and found[1460] == date(2021, 1, 1)


def test_log_positive(spark):
    assert one(spark, scalars.log_positive(lit(0.0))) is None
    assert one(spark, scalars.log_positive(lit(math.e))) == pytest.approx(1)


@pytest.mark.parametrize("text, expected", [("A320", True), ("B738", True), ("E190", False), ("XA3", False), (None, None)])
def test_prefix(spark, text, expected):
    assert one(spark, scalars.matches_any_prefix(lit(text, "string"), ["A3", "B7"])) is expected


def test_paste_sentinel_fill(spark):
    assert one(spark, nulls.paste(F.lit("u/"), lit(None, "string"))) == "u/NA"
    assert one(spark, nulls.paste(F.lit("u/"), F.lit("KLM1"))) == "u/KLM1"
    assert one(spark, nulls.sentinel_to_null(F.lit("N/A"), "N/A")) is None
    assert one(spark, nulls.fill_from(lit(None), lit(2.0))) == 2.0


def test_strict_sum_and_max(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 1), ("b", 3)], "k string, v int")
    found = df.groupBy("k").agg(nulls.strict_sum(F.col("v")).alias("s"), nulls.strict_max(F.col("v")).alias("m"))
    assert rows(found) == [("a", None, None), ("b", 4, 3)]


def test_solve_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    for size in (1, 2, 5, 11):
        half = rng.normal(size=(size, size))
        matrix, right = half @ half.T + np.eye(size), rng.normal(size=size)
        table = F.array(*[F.array(*[F.lit(float(v)) for v in [*matrix[i], right[i]]]) for i in range(size)])
        assert one(spark, linalg.solve(table, size)) == pytest.approx(list(np.linalg.solve(matrix, right)), rel=1e-9)


def test_solve_singular_is_null(spark):
    table = F.array(F.array(lit(1.0), lit(1.0), lit(1.0)), F.array(lit(1.0), lit(1.0), lit(2.0)))
    assert one(spark, linalg.solve(table, 2)) == [None, None]


def test_strict_numbers_and_days(spark):
    from datetime import date

    rows = [(t,) for t in ("1e30", "12d", "NaN", "12", " 1.5e1 ", "Infinity", "2019-03-01 00:00:00")]
    df = spark.createDataFrame(rows, "t string").select("t", scalars.to_number(F.col("t")).alias("n"), scalars.to_utc_timestamp(F.col("t")).cast("string").alias("s"))
    found = {r.t: (r.n, r.s) for r in df.collect()}
    assert found["12d"] == (None, None) and found["NaN"] == (None, None) and found["Infinity"] == (None, None)
    assert found["1e30"][1] is None and found["12"] == (12.0, "1970-01-01 00:00:12") and found[" 1.5e1 "][0] == 15.0
    days = [date(2017, 7, 1), date(2020, 12, 31), date(2019, 1, 1), date(2020, 2, 29)]
    back = spark.range(1).select(*[scalars.decimal_year_to_date(F.lit(scalars.decimal_year_of(d))) for d in days]).first()
    assert list(back) == days
