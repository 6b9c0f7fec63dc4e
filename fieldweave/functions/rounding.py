"""Rounding of doubles as doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int) -> Column:
    """x to so many places, halves away from zero, the half being one of the double x * 10^places (as in DuckDB, NumPy and C). F.round goes by the shortest decimal of x: 0.20325 is 0.2033 there, but 0.20325 * 10^4 is
    below 2032.5. Null stays null, and what is too large to have places stays as it is."""
    y = F.abs(x) * float(10**places)
    down = y - y % 1
    whole = F.signum(x) * (down + F.when(y % 1 >= 0.5, 1.0).otherwise(0.0)) / float(10**places)
    return F.when(y < 2.0**52, whole).otherwise(x)
