"""CSV and Parquet sources."""

from __future__ import annotations

import csv
import re
from concurrent.futures import ThreadPoolExecutor
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flightlens import schemas
from flightlens.operators.clean import date_range
from flightlens.operators.reshape import bind_rows, select_prefix

# The text format of typed flight lists and the token for a missing value.
FLIGHT_TIME = "yyyy-MM-dd HH:mm:ssXXX"
MISSING = "NA"


def normalise_missing(df: DataFrame) -> DataFrame:
    """Empty text to null. The readers already turn ``NA`` and unquoted blanks into null."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.nullif(F.col(f"`{c}`"), F.lit("")) for c in texts})


def read_table_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """CSV with a header whose columns stand in the order of ``schema``."""
    reader = spark.read.schema(schema).option("header", True).option("nullValue", MISSING)
    return normalise_missing(reader.option("enforceSchema", False).csv(path))


def _header(line: str) -> list[str]:
    return next(csv.reader([line.lstrip("﻿")]))


def _subset(header: list[str], schema: T.StructType) -> T.StructType:
    known = {f.name: f for f in schema.fields}
    return T.StructType([known.get(name, T.StructField(name, T.StringType())) for name in header])


def read_by_header(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """CSV files with differing headers, bound by column name.

    Spark binds all files of one read by position, so files are read in one group per distinct header.
    Only the first line of each file is looked at beforehand, several files at a time; flight lists are
    monthly, so files are few and large. Columns outside ``schema`` are left out, columns a file lacks are
    null.
    """

    def first_line(path: str) -> str:
        row = spark.read.text(path).head()
        return row[0] if row else ""

    with ThreadPoolExecutor(8) as pool:
        headers = list(pool.map(first_line, paths))
    groups: dict[str, list[str]] = {}
    for path, header in zip(paths, headers):
        if header:
            groups.setdefault(header, []).append(path)
    frames = []
    for header, members in groups.items():
        frame = read_table_csv(spark, members, _subset(_header(header), schema))
        frames.append(frame.select(*[c for c in schema.names if c in frame.columns]))
    if not frames:
        return spark.createDataFrame([], schema)
    missing = {n: F.lit(None).cast(schema[n].dataType) for n in schema.names}
    bound = bind_rows(*frames)
    return bound.withColumns({n: c for n, c in missing.items() if n not in bound.columns}).select(*schema.names)


def list_files(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Files directly in ``folder`` whose path matches the regular expression, in name order."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(folder).select("path")
    return sorted(row.path for row in names.collect() if re.search(pattern, row.path.rsplit("/", 1)[-1]))


def read_flight_files(
    spark: SparkSession, folder: str, pattern: str = "flightlist_.*", schema: T.StructType = schemas.FLIGHTS
) -> DataFrame:
    """All flight lists of a folder as one table."""
    return read_by_header(spark, list_files(spark, folder, pattern), schema)


def read_flights_2020(spark: SparkSession, folder: str, pattern: str = "flightlist_.*") -> DataFrame:
    """Flight lists with ``origin`` and ``destination``, under the column names of the earlier years."""
    flights = read_flight_files(spark, folder, pattern, schemas.FLIGHTS_2020)
    renamed = {"origin": "estdepartureairport", "destination": "estarrivalairport"}
    return flights.withColumnsRenamed(renamed)


def read_flights_typed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Flight lists with typed times; ``day`` becomes a date. Binds by name through the header."""
    paths = [path] if isinstance(path, str) else path
    texts = T.StructType([T.StructField(n, T.StringType()) for n in schemas.FLIGHTS_TYPED.names])
    raw = read_by_header(spark, paths, texts)
    seen = {c: F.try_to_timestamp(F.col(c), F.lit(FLIGHT_TIME)) for c in ("firstseen", "lastseen", "day")}
    return raw.withColumns(seen).withColumn("day", F.to_date("day"))


def read_csv_skip(spark: SparkSession, path: str, skip: int = 10) -> DataFrame:
    """CSV file with ``skip`` lines before the header; all columns text.

    Lines are numbered without an extra pass: the ids of the first partition count from 0, and it holds
    the start of the file. For a single file without line breaks inside quotes.
    """
    lines = spark.read.text(path).withColumn("_line", F.monotonically_increasing_id())
    header = _header(lines.filter(F.col("_line") == skip).head()["value"])
    parsed = F.from_csv("value", _ddl(header), {"nullValue": MISSING})
    rows = lines.filter((F.col("_line") > skip) & (F.trim("value") != "")).select(parsed.alias("_r"))
    return normalise_missing(rows.select("_r.*"))


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{name.replace('`', '``')}` STRING" for name in names)


def read_fleet(spark: SparkSession, path: str, skip: int = 10) -> DataFrame:
    """Fleet sheet: registration, role and all engine and aircraft columns."""
    sheet = read_csv_skip(spark, path, skip)
    return select_prefix(sheet, ["Engine", "Aircraft"], [schemas.FLEET_REGISTRATION, schemas.FLEET_ROLE])


def read_fuel_grid(spark: SparkSession, path: str) -> DataFrame:
    """Wide fuel grid: ``Type`` and one number column per distance, named by the header."""
    header = _header(spark.read.text(path).head()[0])
    kinds = [T.StructField(n, T.StringType() if n == "Type" else T.DoubleType()) for n in header]
    return read_table_csv(spark, path, T.StructType(kinds))


def read_fuel_rates(spark: SparkSession, path: str) -> DataFrame:
    return read_by_header(spark, [path], schemas.FUEL_RATE)


def read_airports(spark: SparkSession, path: str) -> DataFrame:
    return read_by_header(spark, [path], schemas.AIRPORTS)


def read_aircraft(spark: SparkSession, path: str) -> DataFrame:
    return read_by_header(spark, [path], schemas.AIRCRAFT)


def read_callsigns(spark: SparkSession, path: str) -> DataFrame:
    return read_by_header(spark, [path], schemas.CALLSIGNS)


def read_emissions(
    spark: SparkSession, path: str, start: date | None = None, end: date | None = None
) -> DataFrame:
    """The emissions table written by ``writers.write_emissions``, optionally only some days.

    The bounds also apply to ``flight_year``, so other years' folders are not opened.
    """
    table = spark.read.parquet(path)
    if start is not None:
        table = table.filter(F.col("flight_year") >= start.year)
    if end is not None:
        table = table.filter(F.col("flight_year") <= end.year)
    return table if start is None and end is None else date_range(table, "flight_day", start, end)
