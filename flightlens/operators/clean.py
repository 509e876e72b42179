"""Row filters and de-duplication."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from flightlens.functions.nulls import strict_max


def drop_na(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows with a null or NaN in ``columns`` (all columns if not given)."""
    return df.dropna("any", subset=columns)


def different_airports(df: DataFrame, departure: str, arrival: str) -> DataFrame:
    """Keep flights between two known, different airports."""
    return df.filter(F.col(departure) != F.col(arrival))


def touches_region(df: DataFrame, departure: str, arrival: str, region: str) -> DataFrame:
    """Keep rows where either end lies in ``region``, even if the other end is unknown."""
    return df.filter((F.col(departure) == region) | (F.col(arrival) == region))


def date_range(
    df: DataFrame, column: str, start: date | None = None, end: date | None = None, combine: str = "and"
) -> DataFrame:
    """Keep days from ``start`` to ``end``, both included.

    ``combine="or"`` keeps a day that satisfies either bound, which is every known day. On a table written by year, both
    bounds also name the years, so that only their folders are read.
    """
    if "flight_year" in df.columns and column == "flight_day" and combine == "and":
        df = df.filter(F.lit(True) if start is None else F.col("flight_year") >= start.year)
        df = df.filter(F.lit(True) if end is None else F.col("flight_year") <= end.year)
    day = F.col(column).cast("date")
    bounds: list[Column] = []
    if start is not None:
        bounds.append(day >= F.lit(start))
    if end is not None:
        bounds.append(day <= F.lit(end))
    if not bounds:
        raise ValueError("give start, end or both")
    condition = bounds[0]
    for bound in bounds[1:]:
        condition = condition & bound if combine == "and" else condition | bound
    return df.filter(condition)


def keep_group_max(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows that hold the maximum of their group; ties stay, a group with a null value is dropped.

    The maximum is a grouped aggregate, combined before the shuffle, and the rows find it by a semi
    join on key and value. A group of any size is therefore never brought together in one task.
    """
    peak = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(strict_max(F.col(value)).alias("_peak"))
    match = F.col(value) == F.col("_peak")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(peak, match, "left_semi")


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the first by ``order``, nulls last, remaining columns as tiebreak.

    Written as a grouped minimum over a struct, which is combined before the shuffle; a window would
    bring all rows of a hot key into one task.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    ranked = [part for c in [*order, *rest] for part in (F.col(c).isNull().alias(f"_null_{c}"), F.col(c))]
    best = df.groupBy(key).agg(F.min(F.struct(*ranked)).alias("_best"))
    return best.select(*[F.col(key) if c == key else F.col("_best")[c].alias(c) for c in df.columns])
