"""Filter, multiply-add and sum of one integer column in a single scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import wrap32


def fused_sum(df: DataFrame, column: str, threshold: int, multiplier: int, addend: int, alias: str = "total", wrap: bool = False) -> DataFrame:
    """One row: the sum of ``column * multiplier + addend`` where ``column > threshold``, else 0.

    A null takes the 0 of the ELSE branch; an empty input sums to null.  The
    product is a bigint, so it cannot overflow a 32-bit column under ANSI mode;
    ``wrap`` asks for each row's value modulo 2^32 instead.
    """
    x = F.col(column).cast("bigint")
    value = x * F.lit(multiplier).cast("bigint") + F.lit(addend).cast("bigint")
    value = wrap32(value) if wrap else value
    return df.agg(F.sum(F.when(x > threshold, value).otherwise(F.lit(0).cast("bigint"))).alias(alias))
