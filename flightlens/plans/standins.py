"""Flight tables made from the order tables that the driver supplies.

=============== ==========================================================================
flights          line items; from the supplier's nation to the customer's nation
airports         nations, with derived coordinates and the region as continent
aircraft, fleet  parts: brand is the type, part type the role
fuel grid        dearest line per brand and quantity
split grid       the same for brands up to 15, where both fuel methods are wanted
fuel rates       part prices per brand
emissions        line items with brand and part type; the price in cents stands for CO2
=============== ==========================================================================

Every table is read whole. Unknown values, which the order tables lack, are put in by value: one
supplier nation has no airport code, one has a code no airport carries, American airports have no
continent, parts of the largest size have no registration and brand 15 has an empty grid row.
Known callsigns are those of one customer segment, as an earlier lookup holds only some.
Prices are whole cents, so sums over them do not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

MAX_GRID_COLUMNS = 1000
NMI_PER_QUANTITY = 220
EMPTY_GRID_BRAND = "Brand#15"
LAST_SPLIT_BRAND = 15

# Part type -> fleet role; the last one is no known role.
PART_ROLES = {
    "ECONOMY": "Passenger",
    "LARGE": "Freighter",
    "MEDIUM": "Combi",
    "PROMO": "Corporate/Government",
    "SMALL": "Utility",
    "STANDARD": "Space tug",
}


# Columns of the driver's tables; naming them saves reading every file's footer beforehand.
TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
    " o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,"
    " l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING,"
    " l_shipdate TIMESTAMP_NTZ",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def cents(price: str):
    return F.round(F.col(price) * 100).cast("long")


def airports(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("n_nationkey")
    continent = (
        F.when(F.col("r_name") == "EUROPE", "EU")
        .when(F.col("r_name") == "AFRICA", "AF")
        .when(F.col("r_name") == "ASIA", "AS")
        .when(F.col("r_name") != "AMERICA", "OC")
    )
    nations = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return nations.select(
        F.concat(F.lit("N"), key).alias("ICAO"),
        F.col("n_name").alias("name"),
        ((key * 7) % 25 * 5 - 60).cast("double").alias("latitude_deg"),
        (key * F.lit(14.4) - F.lit(172.8)).alias("longitude_deg"),
        (key * 100).cast("double").alias("elevation_ft"),
        continent.alias("continent"),
    )


def _trips(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with both nations; the customer's nation joins the orders, which are fewer."""
    orders = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).select("o_orderkey", "o_custkey", "o_orderdate", "c_nationkey")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"
    )
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        suppliers, F.col("l_suppkey") == F.col("s_suppkey")
    )


def _departure():
    nation = F.col("s_nationkey")
    return F.when(nation == 24, "ZZZZ").when(nation != 22, F.concat(F.lit("N"), nation))


def _flight_columns():
    return [
        F.concat(F.lit("a"), "l_partkey").alias("icao24"),
        F.concat(F.lit("C"), "o_custkey", F.lit("-"), "l_linenumber").alias("callsign"),
        F.col("l_shipdate").alias("day"),
        F.col("o_orderdate").alias("firstseen"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.col("l_linenumber"))).alias("lastseen"),
    ]


def flights(spark: SparkSession, folder: str) -> DataFrame:
    return _trips(spark, folder).select(
        *_flight_columns(),
        _departure().alias("estdepartureairport"),
        F.concat(F.lit("N"), "c_nationkey").alias("estarrivalairport"),
    )


def prototype_flights(spark: SparkSession, folder: str) -> DataFrame:
    """Flights of the earlier variant, which carry registration and type, both with gaps."""
    parts = table(spark, folder, "part").select("p_partkey", "p_size", "p_type", "p_brand")
    trips = _trips(spark, folder).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return trips.select(
        *_flight_columns(),
        _departure().alias("origin"),
        F.concat(F.lit("N"), "c_nationkey").alias("destination"),
        F.when(F.col("p_size") < 50, F.concat(F.lit("R"), "l_partkey")).alias("registration"),
        F.when(F.col("p_type").isin("ECONOMY", "LARGE"), F.col("p_brand")).alias("typecode"),
    )


def aircraft(spark: SparkSession, folder: str) -> DataFrame:
    registration = F.when(F.col("p_size") < 50, F.concat(F.lit("R"), "p_partkey"))
    return table(spark, folder, "part").select(
        F.concat(F.lit("a"), "p_partkey").alias("icao24"), registration.alias("registration")
    )


def fleet(spark: SparkSession, folder: str) -> DataFrame:
    role = F.col("p_type")
    for part_type, name in PART_ROLES.items():
        role = F.when(F.col("p_type") == part_type, name).otherwise(role)
    return table(spark, folder, "part").select(
        F.concat(F.lit("R"), "p_partkey").alias("Tail/Registration Number"),
        role.alias("Role"),
        F.col("p_brand").alias("Aircraft Variant ICAO Code"),
        F.col("p_type").alias("Aircraft Manufacturer"),
    )


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with the columns of their part that the stand-ins use."""
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))


def fuel_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Wide table: ``Type`` and one column per distance, the column name being the distance.

    The columns follow from the quantities that occur, so no line is lost; too many for a wide table are an error.
    """
    lines = table(spark, folder, "lineitem").select("l_quantity").dropna().distinct().limit(MAX_GRID_COLUMNS + 1)
    quantities = sorted(r.l_quantity for r in lines.collect())
    if len(quantities) > MAX_GRID_COLUMNS:
        raise ValueError(f"more than {MAX_GRID_COLUMNS} quantities do not make a wide table")
    burn = F.when(F.col("p_brand") != EMPTY_GRID_BRAND, F.col("l_extendedprice"))
    cells = observations(spark, folder).groupBy(F.col("p_brand").alias("Type")).pivot("l_quantity", quantities)
    return cells.agg(F.max(burn)).toDF("Type", *[f"{q * NMI_PER_QUANTITY:.0f}" for q in quantities])


def split_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The grid's rows for brands up to 15; brands beyond have rates only, so both fuel methods are met."""
    return fuel_grid(spark, folder).filter(F.substring("Type", 7, 2).cast("int") <= LAST_SPLIT_BRAND)


def fuel_rates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_brand").alias("Type_Code"),
        (F.col("p_retailprice") / 100).alias("Fuel burn kg/nm"),
        F.col("p_size").cast("double").alias("Minimum range nm"),
        (F.col("p_size") * 100).cast("double").alias("maximum range nm"),
    )


def emissions(spark: SparkSession, folder: str) -> DataFrame:
    return observations(spark, folder).select(
        F.col("l_shipdate").cast("date").alias("flight_day"),
        F.col("p_brand").alias("aircraft_type"),
        F.col("p_type").alias("aircraft_role"),
        cents("l_extendedprice").alias("CO2"),
    )


def daily_emissions(spark: SparkSession, folder: str) -> DataFrame:
    """Day and CO2 alone, which needs no part."""
    return table(spark, folder, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("flight_day"), cents("l_extendedprice").alias("CO2")
    )


def known_callsigns(spark: SparkSession, folder: str) -> DataFrame:
    """Callsigns an earlier lookup holds: the first line of each customer of one segment."""
    buyers = table(spark, folder, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    return buyers.select(
        F.concat(F.lit("C"), "c_custkey", F.lit("-1")).alias("callsign"), F.col("c_mktsegment").alias("Unknown")
    )
