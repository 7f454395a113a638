"""Joins of the star: dimension membership and dimension attributes.

No side is broadcast by hint here unless its size is fixed by the schema (nations, regions):
customers, parts and suppliers grow with the data, so their size is left to the statistics of the
filtered relation (spark.sql.autoBroadcastJoinThreshold, and AQE at run time).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(lower: DataFrame, upper: DataFrame, on: Column, fixed: bool = False) -> DataFrame:
    """N:1 inner join to the level above. fixed: the upper level's size does not depend on the data."""
    return lower.join(F.broadcast(upper) if fixed else upper, on, "inner")


def members(lower: DataFrame, upper: DataFrame, on: Column) -> DataFrame:
    """Rows of lower that have a match: membership without columns of the upper side."""
    return lower.join(upper, on, "left_semi")


def star_join(fact: DataFrame, dimensions: list[tuple[DataFrame, str, str, bool]]) -> DataFrame:
    """fact joined to each (dimension, fact key, dimension key, needed columns?)."""
    for frame, fact_key, key, attributes in dimensions:
        on = fact[fact_key] == frame[key]
        fact = lookup(fact, frame, on).drop(frame[key]) if attributes else members(fact, frame, on)
    return fact
