"""Aggregates over one or two measures, grouped or global."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.plans.model import Measure, PlanError

_ARITHMETIC = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: F.try_divide(a, b),
}
_FUNCTIONS = {"SUM": F.sum, "COUNT": F.count, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


def measure(m: Measure) -> Column:
    if m.function not in _FUNCTIONS:
        raise PlanError(f"unknown function {m.function}")
    value = F.col(m.left)
    if m.operator:
        value = _ARITHMETIC[m.operator](value, F.col(m.right))
    return _FUNCTIONS[m.function](value).alias(m.alias)


def aggregate(df: DataFrame, keys: list[str], measures: tuple[Measure, ...], drop_zero: bool = False) -> DataFrame:
    """Partial and final hash aggregate. drop_zero: leave out rows whose first measure is 0 or,
    for a global aggregate over nothing, null."""
    columns = [measure(m) for m in measures]
    out = df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)
    return out.filter(F.col(measures[0].alias) != 0) if drop_zero else out


def distinct_members(df: DataFrame, attribute: str) -> DataFrame:
    """The members of a level that occur."""
    return df.select(attribute).distinct()


def cube(df: DataFrame, keys: list[str], measures: tuple[Measure, ...], subtotals: str = "cube") -> DataFrame:
    """Extension: SQL CUBE or ROLLUP with subtotal rows."""
    grouped = df.cube(*keys) if subtotals == "cube" else df.rollup(*keys)
    return grouped.agg(F.grouping_id().alias("grouping_id"), *[measure(m) for m in measures])
