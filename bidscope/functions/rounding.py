"""Rounding as SQL engines do it for doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled_round(value: Column, places: int) -> Column:
    """The double times a power of ten, to the nearest whole number, half away from zero, and back: DuckDB's ``ROUND`` and its cast
    to a decimal.  Spark's own rounds the printed digits, which differs where these end in a five that the double does not reach."""
    scale = F.lit(10.0**places)
    return F.round(value * scale) / scale
