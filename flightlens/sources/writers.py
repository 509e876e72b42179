"""CSV and Parquet sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flightlens.sources.readers import MISSING

# Fixed value: ISO 8601 in UTC.
ISO_TIME = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV files with header, missing values as ``NA`` and UTC times in ISO form."""
    times = {n: F.col(f"`{n}`").cast("timestamp") for n, kind in df.dtypes if kind == "timestamp_ntz"}
    writer = df.withColumns(times).write if times else df.write
    writer.mode(mode).option("header", True).option("nullValue", MISSING).option("emptyValue", "").option(
        "timestampFormat", ISO_TIME
    ).csv(path)


def write_emissions(emissions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet by year, sorted by day within files.

    Rows are split by range over day, time and aircraft, so even a day with very many flights is written
    by several tasks.
    """
    order = ["flight_day", "flight_firstseen", "aircraft_ICAO24"]
    (
        emissions.withColumn("flight_year", F.year("flight_day"))
        .repartitionByRange(*order)
        .sortWithinPartitions("flight_year", *order)
        .write.mode(mode)
        .partitionBy("flight_year")
        .parquet(path)
    )
