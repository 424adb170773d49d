"""Dense numbers for combinations of dimension attributes.

Each dimension's distinct attribute tuples are numbered from 0 in sorted order;
numbers combine as digits of a mixed-radix integer, first dimension lowest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.star import Dimension

#: Attribute types that have an encoding.
SUPPORTED = {"int", "bigint", "smallint", "tinyint", "boolean", "date", "string"}


def components(dimension: Dimension, alias: str = "component") -> DataFrame:
    """The distinct attribute tuples of a dimension with their numbers.

    The tuples are distinct before they are ranked, so the one task of the
    ranking holds distinct attribute values, not rows.
    """
    distinct = dimension.df.select(*dimension.attrs).distinct()
    return distinct.withColumn(alias, F.row_number().over(Window.orderBy(*dimension.attrs)).cast("bigint") - 1)


def encode(dimensions: list[Dimension], alias: str = "group_id") -> DataFrame:
    """Every combination of attribute tuples with its number."""
    out, radix = None, F.lit(1).cast("bigint")
    for k, dimension in enumerate(dimensions):
        numbered = components(dimension, f"_c{k}")
        size = numbered.agg(F.count(F.lit(1)).alias(f"_d{k}"))
        # one row of a size joins the tuples of its own dimension, both attribute-sized
        numbered = numbered.join(size, F.lit(True))
        out = numbered if out is None else out.join(numbered, F.lit(True))
    value = F.lit(0).cast("bigint")
    for k in range(len(dimensions)):
        value = value + F.col(f"_c{k}") * radix
        radix = radix * F.col(f"_d{k}")
    return out.select(*(a for d in dimensions for a in d.attrs), value.alias(alias))


def decode(numbers: DataFrame, dimensions: list[Dimension], column: str = "group_id") -> DataFrame:
    """The attribute tuples of group numbers, beside the columns of ``numbers``."""
    out, rest = numbers, F.col(column)
    kept = list(numbers.columns)
    for k, dimension in enumerate(dimensions):
        numbered = components(dimension, f"_c{k}")
        size = numbered.agg(F.count(F.lit(1)).alias(f"_d{k}"))
        out = out.join(size, F.lit(True)).withColumn(f"_digit{k}", rest % F.col(f"_d{k}"))
        out = out.withColumn(f"_rest{k}", F.expr(f"({column if k == 0 else f'_rest{k - 1}'}) div _d{k}"))
        rest = F.col(f"_rest{k}")
        out = out.join(numbered, F.col(f"_digit{k}") == F.col(f"_c{k}"))
    return out.select(*kept, *(a for d in dimensions for a in d.attrs))


@dataclass(frozen=True)
class GroupSpaceReport:
    """Whether the combinations can be numbered, how many there are, and why not."""

    eligible: bool
    sizes: tuple[int, ...]
    groups: int
    reason: str = ""


def report(dimensions: list[Dimension], max_groups: int = 1 << 20) -> GroupSpaceReport:
    """Checks the types, emptiness and number of groups; one count per dimension."""
    for d in dimensions:
        for name, kind in d.df.select(*d.attrs).dtypes:
            if kind not in SUPPORTED and not kind.startswith("decimal"):
                return GroupSpaceReport(False, (), 0, f"unsupported type {kind} of {name}")
    sizes, groups = [], 1
    for d in dimensions:
        n = d.df.select(*d.attrs).distinct().count() if d.attrs else int(not d.df.isEmpty())
        sizes.append(n)
        groups *= n
        if not n:
            return GroupSpaceReport(False, tuple(sizes), 0, "empty dimension")
        if d.attrs and d.df.groupBy(d.key).agg(F.count_distinct(F.struct(*d.attrs)).alias("n")).filter("n > 1").limit(1).count():
            return GroupSpaceReport(False, tuple(sizes), 0, "duplicate key with attributes")
    if groups > max_groups:
        return GroupSpaceReport(False, tuple(sizes), groups, f"{groups} groups exceed {max_groups}")
    return GroupSpaceReport(True, tuple(sizes), groups)
