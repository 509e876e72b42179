"""Small dense linear algebra on array columns, one system per row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def reduced(rows: Column, size: int, tolerance: float = 1e-14) -> Column:
    """Bring the left ``size`` columns of a symmetric positive system to the identity; null without a pivot.

    Gauss-Jordan without row exchange, folded over the pivot position. Scale the system to order one
    first: a pivot within ``tolerance`` of zero makes the whole result null.
    """

    def eliminate(matrix: Column, k: Column) -> Column:
        pivot_row = F.element_at(matrix, k)
        pivot = F.element_at(pivot_row, k)
        pivot = F.when(F.abs(pivot) > tolerance, pivot)
        return F.transform(
            matrix,
            lambda row, i: F.when(i + 1 == k, F.transform(row, lambda v: v / pivot)).otherwise(
                F.zip_with(row, pivot_row, lambda a, b: a - F.element_at(row, k) / pivot * b)
            ),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(size)), rows, eliminate)


def solve(rows: Column, size: int, tolerance: float = 1e-14) -> Column:
    """Solve a symmetric positive system given as ``size`` rows of ``size + 1`` numbers; see :func:`reduced`."""
    return F.transform(reduced(rows, size, tolerance), lambda row: F.element_at(row, -1))


def dot(left: Column, right: Column) -> Column:
    """Sum of products of two equally long arrays."""
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body, or a lambda in it, uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
