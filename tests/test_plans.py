"""What the physical plans must and must not hold."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from flightlens import session
from flightlens.operators import clean, enrich, polyfit
from flightlens.plans import jobs, prototype, registry, reports
from flightlens.plans import standins as st

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fact_scan_reads_only_what_it_needs(spark):
    text = plan(registry.daily_count_sum(spark, FOLDER))
    assert "ReadSchema: struct<l_extendedprice:double,l_shipdate:timestamp_ntz>" in text
    assert "Exchange hashpartitioning(flight_day" in text and "partial_sum" in text


def test_date_filter_reaches_the_scan(spark):
    days = st.table(spark, FOLDER, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    text = plan(clean.date_range(days, "o_orderdate", *registry.YEAR))
    assert "GreaterThanOrEqual(o_orderdate,1998-01-01" in text


def test_dimensions_are_broadcast_after_the_check(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        flights, airports, aircraft = registry._inputs(spark, FOLDER)
        facts = session.stored(flights, "flights")
        text = plan(registry.em.typed_flights(facts, airports, aircraft))
        assert text.count("BroadcastHashJoin") >= 3 and "SortMergeJoin [est" not in text
        # one shuffle of the facts: the distinct
        assert len(re.findall(r"Exchange hashpartitioning\((?![nr]_regionkey)", text)) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_large_lookup_is_not_broadcast(spark):
    small, large = spark.range(10), spark.range(11)
    facts = spark.range(1000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(facts.join(session.checked_broadcast(small, 10), "id"))
        assert "SortMergeJoin" in plan(facts.join(session.checked_broadcast(large, 10), "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_group_operators_have_no_window_over_the_facts(spark):
    parts = st.table(spark, FOLDER, "part")
    for df in (
        clean.keep_group_max(parts, ["p_brand"], "p_retailprice"),
        clean.first_per_key(parts, "p_brand", ["p_size"]),
        polyfit.fit_polynomial(parts, "p_brand", "p_size", "p_retailprice"),
        reports.co2_day_role(st.emissions(spark, FOLDER)),
    ):
        text = plan(df)
        assert "Window" not in text and "partial_" in text


@pytest.fixture
def low_skew_limits(spark):
    """No join is broadcast by itself, and small partitions already count as skewed."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def test_hot_key_is_split_in_a_shuffled_lookup(spark, low_skew_limits):
    """Two thirds of the flights share one address; the shuffled join splits that partition."""
    address = F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.concat(F.lit("a"), F.col("id")))
    flights = spark.range(60000, numPartitions=6).select(address.alias("icao24"), F.sha2(F.col("id").cast("string"), 512).alias("pay"))
    aircraft = spark.createDataFrame([("hot", "R0"), ("a2", "R2"), ("a5", "R5")], "icao24 string, registration string")
    joined = enrich.attach_registration(flights, aircraft, rows=0)
    assert joined.filter("registration = 'R0'").count() == 40000
    joined.collect()
    assert "skew=true" in plan(joined)


def test_unknown_callsigns_are_split_when_types_are_filled_in(spark, low_skew_limits):
    """Two thirds of the flights have no callsign."""
    known = F.col("id") % 9 == 0
    flights = spark.range(60000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("c"), F.col("id") % 500)).alias("callsign"),
        F.sha2(F.col("id").cast("string"), 512).alias("icao24"), F.when(known, F.lit("R")).alias("registration"),
        F.when(known, F.lit("A320")).alias("typecode"), F.lit("A").alias("origin"), F.lit("B").alias("destination"),
        F.timestamp_seconds("id").alias("firstseen"),
    )
    flights = session.stored(flights, "flights")
    filled = prototype.impute_types(flights, rows=0)
    rows = filled.collect()
    assert "skew=true" in plan(filled)
    assert len(rows) == 60000 and all((r.typecode is None) == (r.callsign is None) for r in rows)
    missing = prototype.unresolved_flights(flights)
    assert missing.collect() == prototype.unresolved(filled).collect() and missing.count() == 1
    assert "partial_min" in plan(missing)


def test_hot_group_keeps_all_ties(spark):
    facts = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 100)).alias("k"),
        (F.col("id") % 10).alias("v"), "id",
    )
    assert clean.keep_group_max(facts, ["k"], "v").filter("k = 'hot'").count() == 1000


class Settings:
    """Stands in for a session that has, or lacks, the folder setting."""

    def __init__(self, named, master):
        self.named, self.conf, self.sparkContext = named, self, self
        self.master, self.applicationId = master, "app-1"

    def get(self, key, default=None):
        return {"spark.checkpoint.dir": self.named, "spark.sql.warehouse.dir": "file:/w"}.get(key) or default


def test_shared_folder():
    assert session.shared_dir(Settings("hdfs://x/y", "spark://m")) == "hdfs://x/y"
    assert session.shared_dir(Settings(None, "local[4]")) == "file:/w/_stored"
    with pytest.raises(ValueError):
        session.shared_dir(Settings(None, "spark://m"))


def test_stored_table_lies_in_the_shared_folder(spark):
    table = session.stored(spark.range(3), "numbers")
    assert session.shared_dir(spark) in table.inputFiles()[0] and table.count() == 3


@pytest.fixture(scope="module")
def emissions(spark, tmp_path_factory):
    """Two written emissions tables, with an unknown value and an unknown type."""
    out = str(tmp_path_factory.mktemp("emissions"))
    rows = spark.range(3000).select(
        F.date_add(F.lit(date(2018, 1, 1)), (F.col("id") % 700).cast("int")).alias("flight_day"),
        F.when(F.col("id") != 7, F.concat(F.lit("T"), F.col("id") % 3)).alias("aircraft_type"),
        F.when(F.col("id") % 2 == 0, F.lit("Cargo")).otherwise(F.lit("Passenger")).alias("aircraft_role"),
        F.when(F.col("id") != 11, 100.0 + F.col("id") % 13).alias("CO2"),
    )
    rows = rows.withColumn("flight_year", F.year("flight_day"))
    for name in ("history", "latest"):
        rows.write.partitionBy("flight_year").parquet(f"{out}/{name}")
    return spark.read.parquet(f"{out}/history"), spark.read.parquet(f"{out}/latest")


@pytest.fixture
def reads(monkeypatch):
    """Counts how often each emissions table is written on from."""
    seen = {"/history/": 0, "/latest/": 0}

    def watched(df, name):
        for folder in seen:
            seen[folder] += any(folder in f for f in df.inputFiles())
        return session.stored(df, name)

    monkeypatch.setattr(jobs, "stored", watched)
    return seen


BOUNDS = date(2019, 1, 1), date(2019, 12, 31)


def test_years_outside_the_bounds_are_not_read(emissions):
    for df in (reports.total_co2(emissions[0], *BOUNDS), reports.co2_by_type(emissions[0], *BOUNDS)):
        assert re.search(r"PartitionFilters: \[[^]]*flight_year#\d+ >= 2019", plan(df))


def test_reports_read_the_emissions_once(emissions, reads):
    tables = jobs.report_tables(*emissions, *BOUNDS)
    assert reads == {"/history/": 1, "/latest/": 1}
    assert not [f for df in tables.values() for f in df.inputFiles() if "/history/" in f or "/latest/" in f]
    history, latest = emissions
    direct = {
        "daily_co2_by_role": reports.daily_co2_by_role_clean(history, latest),
        "co2_by_type": reports.co2_by_type(history.unionByName(latest), *BOUNDS),
        "daily_flights_and_co2": reports.daily_flights_and_co2(history),
        "total_co2": reports.total_co2(history, *BOUNDS),
    }
    for name, df in direct.items():
        assert sorted(map(repr, tables[name].collect())) == sorted(map(repr, df.collect())), name


def test_forecasts_read_the_emissions_once(emissions, reads):
    jobs.forecast_tables(*emissions, *BOUNDS)
    assert reads == {"/history/": 1, "/latest/": 1}
