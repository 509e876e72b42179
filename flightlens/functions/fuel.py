"""Fuel burn and CO2 of one flight."""

from __future__ import annotations

from pyspark.sql import Column

# Fixed value: kg CO2 per kg fuel.
CO2_PER_FUEL = 3.16


def polynomial_fuel(c0: Column, c1: Column, c2: Column, c3: Column, x: Column, form: str) -> Column:
    """Fuel from cubic coefficients.

    ``form="cubic"`` is the polynomial; ``form="as_written"`` is ``c0 + c1*x + c2*x + c3``, the sum
    without powers that published results were made with. There is no default on purpose.
    """
    if form == "cubic":
        return c0 + c1 * x + c2 * x * x + c3 * x * x * x
    if form == "as_written":
        return c0 + c1 * x + c2 * x + c3
    raise ValueError(f"form must be 'as_written' or 'cubic', not {form!r}")


def rate_fuel(distance: Column, rate: Column) -> Column:
    return distance * rate


def co2(fuel: Column) -> Column:
    return fuel * CO2_PER_FUEL
