"""Wide to long and back, column selection, union by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from flightlens.functions.scalars import to_number


def select_prefix(df: DataFrame, prefixes: list[str], keep: list[str] = ()) -> DataFrame:
    """``keep`` and every column whose name begins with a prefix, in any case."""
    lowered = tuple(p.lower() for p in prefixes)
    return df.select(*keep, *[c for c in df.columns if c not in keep and c.lower().startswith(lowered)])


def unpivot_all_but(df: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """One row per key and remaining column; null cells stay."""
    return df.unpivot(keys, [c for c in df.columns if c not in keys], name, value)


def unpivot_named(df: DataFrame, columns: list[str], value: str, name: str = "name") -> DataFrame:
    """One row per input row and named column, all other columns kept."""
    return df.unpivot([c for c in df.columns if c not in columns], columns, name, value)


def grid_points(grid: DataFrame, key: str = "Type") -> DataFrame:
    """Wide fuel grid to points ``type, distance, fuelburn``; header text to number, empty cells dropped."""
    long = unpivot_all_but(grid, [key], "distance", "fuelburn").withColumnRenamed(key, "type")
    return long.withColumn("distance", to_number(F.col("distance"))).dropna()


def nest_points(points: DataFrame, key: str = "type") -> DataFrame:
    """One row per type with its points as a sorted array.

    Meant for a fuel grid, where a type has at most one point per distance column. Fits do not use
    this form: they run on grouped sums.
    """
    return points.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("distance", "fuelburn"))).alias("data"))


def pivot_wide(df: DataFrame, keys: list[str], name: str, names: list[str], value: Column) -> DataFrame:
    """Named values of ``name`` become columns holding the aggregate ``value``; a value not listed is an error."""
    other = df.filter(~F.col(name).isin(names) | F.col(name).isNull()).select(name).limit(1).collect()
    if other:
        raise ValueError(f"{name} holds {other[0][0]!r}, which is not listed")
    return df.groupBy(*keys).pivot(name, names).agg(value)


def bind_rows(*frames: DataFrame) -> DataFrame:
    """Union by column name; a column missing on one side is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def bind_distinct(*frames: DataFrame) -> DataFrame:
    return bind_rows(*frames).distinct()
