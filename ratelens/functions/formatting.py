"""Rate bands and KPI formatting (C-11 .. C-14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import RATE_BAND_HIGH, RATE_BAND_MEDIUM


def rate_band(col: Column, high: float = RATE_BAND_HIGH,
              medium: float = RATE_BAND_MEDIUM) -> Column:
    """C-13: 'high' above ``high``, 'medium' above ``medium``, else 'low'."""
    return F.when(col > high, "high").when(col > medium, "medium").otherwise("low")


def sign_band(col: Column) -> Column:
    """C-13 for differences: 'up' when positive, 'down' otherwise."""
    return F.when(col > 0, "up").otherwise("down")


def thousands(col: Column) -> Column:
    """'1,234' style integer text."""
    return F.format_number(col.cast("double"), 0)


def percent(col: Column, digits: int = 1) -> Column:
    """A fraction shown as '11.2%'."""
    return F.concat(F.format_number(col * 100.0, digits), F.lit("%"))


def fixed(col: Column, digits: int = 1) -> Column:
    """A number with ``digits`` decimals, e.g. '4.4'."""
    return F.format_number(col.cast("double"), digits)
