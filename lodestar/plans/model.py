"""The query plan: plain dataclasses between the parser and the compiler."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class PlanError(ValueError):
    """The query document is malformed or names something that does not exist."""


class Op(Enum):
    EQ = "="
    LT = "<"
    GT = ">"
    LE = "<="
    GE = ">="
    BETWEEN = "BETWEEN"
    IN = "IN"


@dataclass(frozen=True)
class Predicate:
    """``attribute op values``; BETWEEN has two values, IN one or more."""

    attribute: str
    op: Op
    values: tuple
    table: str | None = None

    def __str__(self) -> str:
        return f"{self.attribute} {self.op.value} {', '.join(map(str, self.values))}"


@dataclass(frozen=True)
class OlapStep:
    """One dimension of the cube: what it is filtered by and which level it is grouped on.

    kind is DRILLDOWN or ROLLUP. Both mean the same relation (filter any level, group on any
    level); the word is kept for printing.
    """

    kind: str
    dimension: str
    group: str | None = None
    filters: tuple[Predicate, ...] = ()


@dataclass(frozen=True)
class Measure:
    """``function(left [operator right]) AS alias``."""

    function: str
    left: str
    operator: str | None = None
    right: str | None = None
    alias: str = "REVENUE"
    table: str = "LINEORDER"
    engine: str = "GPU"

    def __str__(self) -> str:
        inner = f"{self.left} {self.operator} {self.right}" if self.operator else self.left
        return f"{self.function}({inner}) AS {self.alias}"


@dataclass(frozen=True)
class OrderKey:
    name: str
    ascending: bool = True


@dataclass(frozen=True)
class QueryPlan:
    project: tuple[str, ...] = ()
    order_by: tuple[OrderKey, ...] = ()
    steps: tuple[OlapStep, ...] = ()
    filters: tuple[Predicate, ...] = ()
    measures: tuple[Measure, ...] = ()
    limit: int | None = None
    warnings: tuple[str, ...] = field(default=(), compare=False)

    def attributes(self) -> set[str]:
        names = {s.group for s in self.steps if s.group}
        names |= {p.attribute for s in self.steps for p in s.filters}
        return names | {p.attribute for p in self.filters}
