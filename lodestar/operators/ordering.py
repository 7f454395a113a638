"""Ordering and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.plans.model import OrderKey, PlanError

#: Names that mean the first measure whatever its alias is.
METRIC_NAMES = ("REVENUE", "LO_REVENUE", "PROFIT")


def resolve(name: str, groups: list[str], aliases: list[str]) -> str | None:
    if name in aliases:
        return name
    if name in groups:
        return name
    return aliases[0] if name in METRIC_NAMES and aliases else None


def order(df: DataFrame, keys: tuple[OrderKey, ...], groups: list[str], aliases: list[str], lenient: bool = False) -> DataFrame:
    """Sort by the keys, then by the remaining group columns, so that ties have one order."""
    columns, used = [], set()
    for key in keys:
        name = resolve(key.name, groups, aliases)
        if name is None:
            if not lenient:
                raise PlanError(f"cannot order by {key.name!r}")
            continue
        used.add(name)
        columns.append(F.col(name).asc() if key.ascending else F.col(name).desc())
    return df.orderBy(*columns, *[F.col(g).asc() for g in groups if g not in used]) if columns else df


def top(df: DataFrame, k: int) -> DataFrame:
    """Extension: the first k rows of an ordered result (TakeOrderedAndProject)."""
    return df.limit(k)
