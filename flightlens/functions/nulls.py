"""Null rules that differ from Spark's defaults."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _if_complete(value: Column, result: Column) -> Column:
    return F.when(F.count(F.lit(1)) == F.count(value), result)


def strict_sum(value: Column) -> Column:
    """Sum that is null as soon as one value of the group is null."""
    return _if_complete(value, F.sum(value))


def strict_max(value: Column) -> Column:
    """Maximum that is null as soon as one value of the group is null."""
    return _if_complete(value, F.max(value))


def sentinel_to_null(value: Column, token: str) -> Column:
    return F.nullif(value, F.lit(token))


def fill_from(value: Column, other: Column) -> Column:
    return F.coalesce(value, other)


def paste(*parts: Column) -> Column:
    """Text concatenation in which a null becomes the text ``NA``."""
    return F.concat(*[F.coalesce(part.cast("string"), F.lit("NA")) for part in parts])
