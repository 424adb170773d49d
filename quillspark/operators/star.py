"""Star queries: a fact table, dimensions joined to it on one key each, and what is made of the rows.

No operator hints a broadcast.  Catalyst broadcasts a dimension below
``spark.sql.autoBroadcastJoinThreshold`` by its statistics, AQE by its measured
size after the filter; larger ones meet the fact by a shuffle, whose skewed
partitions AQE splits.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dimension:
    """Rows keyed by ``key`` with the attributes a query returns or groups by.

    ``unique`` is the caller's knowledge that no key repeats; it is never found
    out by a job.
    """

    df: DataFrame
    key: str
    attrs: tuple[str, ...] = ()
    unique: bool = False

    def plan(self) -> DataFrame:
        return self.df.select(self.key, *(a for a in self.attrs if a != self.key))


@dataclass(frozen=True)
class Join:
    """``fact_key`` of the fact meets the key of ``dimension``; nulls on either side meet nothing."""

    fact_key: str
    dimension: Dimension


@dataclass(frozen=True)
class Agg:
    """``sum``, ``avg``, ``min``, ``max``, ``count`` or ``count_distinct`` of a column, or ``count`` of rows.

    ``where`` restricts the rows the aggregate sees, not the groups.
    """

    kind: str
    column: str | Column | None
    alias: str
    where: Column | None = None

    def build(self) -> Column:
        value = F.lit(1) if self.column is None else F.col(self.column) if isinstance(self.column, str) else self.column
        if self.where is not None:
            value = F.when(self.where, value)
        kinds = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "count_distinct": F.count_distinct}
        if self.kind not in kinds:
            raise ValueError(f"unknown aggregate {self.kind!r}")
        return kinds[self.kind](value).alias(self.alias)


@dataclass(frozen=True)
class StarQuery:
    """What :func:`star_aggregate` computes; ``grouping`` is plain, rollup or cube."""

    fact: DataFrame
    joins: tuple[Join, ...]
    aggs: tuple[Agg, ...]
    group_by: tuple[str, ...] = ()
    where: Column | None = None
    grouping: str = "plain"
    extra: tuple[Column, ...] = field(default=())


def _joined(fact: DataFrame, joins: tuple[Join, ...] | list[Join], how: str = "inner") -> DataFrame:
    for join in joins:
        dim = join.dimension.plan()
        left, right = fact[join.fact_key], dim[join.dimension.key]
        fact = fact.join(dim, left == right, how)
        if join.fact_key == join.dimension.key:
            fact = fact.drop(right)
    return fact


def membership_count(fact: DataFrame, joins: list[Join], alias: str = "n") -> DataFrame:
    """One row: the rows an inner join of the fact with every dimension would have.

    A dimension known to be unique is a semi join.  Any other is first reduced
    to a count by key, so its copies never multiply rows; the weights of a row
    multiply and sum to the same number.  No row met: 0.
    """
    weights: list[Column] = []
    for k, join in enumerate(joins):
        dim = join.dimension.df.select(F.col(join.dimension.key).alias(f"_key{k}"))
        match = fact[join.fact_key] == F.col(f"_key{k}")
        if join.dimension.unique:
            fact = fact.join(dim, match, "left_semi")
        else:
            counts = dim.groupBy(f"_key{k}").agg(F.count(F.lit(1)).alias(f"_weight{k}"))
            fact = fact.join(counts, match)
            weights.append(F.col(f"_weight{k}"))
    if not weights:
        return fact.agg(F.count(F.lit(1)).alias(alias))
    return fact.agg(F.coalesce(F.sum(reduce(mul, weights)), F.lit(0).cast("bigint")).alias(alias))


def star_aggregate(query: StarQuery) -> DataFrame:
    """Aggregates over the joined rows, by attributes of any side.

    A null attribute is a group; a key with several attribute rows falls in
    several groups; a group without rows does not appear.  Without ``group_by``
    one row comes back, whose sums are null where nothing was met.
    """
    rows = _joined(query.fact if query.where is None else query.fact.filter(query.where), query.joins)
    aggs = [*(a.build() for a in query.aggs), *query.extra]
    if not query.group_by:
        return rows.agg(*aggs)
    grouped = {"plain": rows.groupBy, "rollup": rows.rollup, "cube": rows.cube}[query.grouping]
    return grouped(*query.group_by).agg(*aggs)


def star_join(fact: DataFrame, joins: list[Join], columns: list[str], how: str = "inner") -> DataFrame:
    """The joined rows themselves, ``columns`` of the fact and the dimensions, order unspecified."""
    return _joined(fact, joins, how).select(*columns)
