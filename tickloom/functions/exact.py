"""Exact integer arithmetic on time ticks: products in DECIMAL, division by remainder, never by floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _decimal(c, digits: int) -> Column:
    c = F.lit(c) if isinstance(c, int) else F.col(c) if isinstance(c, str) else c
    return c.cast(f"decimal({digits},0)")


def rescale(value, from_scale, to_scale) -> Column:
    """floor(value * to_scale / from_scale) of a value that isn't negative; a result beyond BIGINT is an error."""
    product, by = _decimal(value, 20) * _decimal(to_scale, 10), _decimal(from_scale, 10)
    return ((product - product % by) / by).cast("decimal(38,0)").cast("bigint")


def ceil_div(value, by) -> Column:
    """ceil(value / by) of whole numbers that aren't negative."""
    a, b = _decimal(value, 20), _decimal(by, 10)
    return ((a + (b - a % b) % b) / b).cast("decimal(38,0)").cast("bigint")


def floor_div(value, by) -> Column:
    """floor(value / by) of whole numbers that aren't negative."""
    return rescale(value, by, 1)


def seconds_text(ms: Column) -> Column:
    """Milliseconds as seconds with three decimals."""
    return F.format_string("%d.%03d", floor_div(ms, 1000), (ms % 1000).cast("bigint"))
