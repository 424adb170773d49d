"""Integer arithmetic whose result does not depend on session settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap32(value: Column) -> Column:
    """``value``, a bigint, reduced to the range of a 32-bit integer as two's complement wraps it.

    Computed by remainder, so neither ANSI mode nor a cast decides the outcome.
    """
    half = F.lit(1 << 31)
    return F.pmod(value.cast("bigint") + half, F.lit(1 << 32)) - half
