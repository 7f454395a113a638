"""QueryPlan -> one lazy DataFrame.

Each dimension is flattened only as high as its attributes need, filtered, and cut to its key and its
grouped attributes. Several steps on one dimension meet in one join, and a step without a group is a
semi join. Date levels are computed from the order's date, without a join; spans of dates that the
filters imply reach the scan of orders as plain bounds.

Order of the joins: parts and suppliers cut the lines, customers and dates cut the orders, and only
what both leave meets. A dimension whose files are small enough is broadcast; the size of any other
is left to the adaptive planner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import aggregates, joins, ordering, predicates
from lodestar.plans.hierarchy import Hierarchy
from lodestar.plans.model import PlanError, Predicate, QueryPlan
from lodestar.sources.catalog import FROM_ORDERS, FROM_PART

_KEYS = {"CUSTOMER": ("LO_CUSTKEY", "C_CUSTKEY"), "SUPPLIER": ("LO_SUPPKEY", "S_SUPPKEY"), "PART": ("LO_PARTKEY", "P_PARTKEY")}


def _bind(plan: QueryPlan, hierarchy: Hierarchy, compat: bool):
    """Group columns in step order, and the predicates of each dimension."""
    groups: list[str] = []
    by_dimension: dict[str, list[Predicate]] = {}
    known = {*hierarchy.paths, hierarchy.fact["table"]}
    for step in plan.steps:
        if step.dimension not in known:
            if compat:
                continue
            raise PlanError(f"unknown dimension {step.dimension!r}")
        for name in [step.group] * bool(step.group) + [p.attribute for p in step.filters]:
            if hierarchy.resolve(name).dimension != step.dimension:
                raise PlanError(f"{name} is not an attribute of {step.dimension}")
        if step.group and step.group not in groups:
            groups.append(step.group)
        by_dimension.setdefault(step.dimension, []).extend(step.filters)
    for p in plan.filters:
        by_dimension.setdefault(hierarchy.resolve(p.attribute).dimension, []).append(p)
    for g in groups:
        by_dimension.setdefault(hierarchy.resolve(g).dimension, [])
    return groups, by_dimension


def _side(catalog, name: str, wanted: list[Predicate], kept: list[str], more: set[str]) -> tuple[DataFrame, str, str, bool]:
    """A filtered dimension as star_join() takes it; more: measures that it holds."""
    hierarchy, (fact_key, key) = catalog.hierarchy, _KEYS[name]
    frame = catalog.dimension(name, {*kept, *more, *(p.attribute for p in wanted)})
    frame = predicates.where(frame, [predicates.condition(hierarchy.resolve(p.attribute), p) for p in wanted])
    frame = frame.select(F.col(key).alias(f"__{key}"), *kept, *sorted(more))
    return (F.broadcast(frame) if catalog.small(name) else frame), fact_key, f"__{key}", bool(kept or more)


def _assemble(catalog, needed: set[str], filters: list[Predicate], by_dimension: dict[str, list[Predicate]], groups: list[str]) -> DataFrame:
    """The filtered star with the needed columns of the fact and the groups."""
    hierarchy = catalog.hierarchy
    kept = {d: [g for g in groups if hierarchy.resolve(g).dimension == d] for d in _KEYS}
    used = [d for d in _KEYS if kept[d] or by_dimension.get(d)]
    cost = needed & FROM_PART
    if cost and "PART" not in used:
        used.append("PART")
    sides = {d: _side(catalog, d, by_dimension.get(d, []), kept[d], cost if d == "PART" else set()) for d in used}

    def held(names) -> list:
        return [predicates.condition(hierarchy.resolve(p.attribute), p) for p in filters if hierarchy.resolve(p.attribute).name in names]

    from_orders = (needed & FROM_ORDERS) | ({"LO_CUSTKEY"} if "CUSTOMER" in used else set())
    from_lines = needed - FROM_ORDERS - FROM_PART
    keys = {_KEYS[d][0] for d in ("PART", "SUPPLIER") if d in used}
    df = predicates.where(catalog.lines(from_lines | keys, bool(from_orders)), held(from_lines))
    # memberships first: Catalyst moves a semi join below an inner one, and its hint is lost on the way
    df = joins.star_join(df, sorted((sides[d] for d in ("PART", "SUPPLIER") if d in used), key=lambda side: side[3]))
    df = predicates.where(df, held(cost))
    if from_orders:
        spans = [s for p in filters if (s := predicates.date_span(p))]
        orders = predicates.where(catalog.orders(from_orders, spans), held(from_orders))
        orders = joins.star_join(orders, [sides["CUSTOMER"]] if "CUSTOMER" in used else [])
        df = joins.lookup(df, orders, df["__order"] == orders["__key"])
    return df


def compile_plan(catalog, plan: QueryPlan, compat: bool = False) -> DataFrame:
    """compat: drop groups whose sum is 0 and empty scalars, skip unknown dimensions and order keys."""
    hierarchy = catalog.hierarchy
    groups, by_dimension = _bind(plan, hierarchy, compat)
    fact_name = hierarchy.fact["table"]
    operands = {c for m in plan.measures for c in (m.left, m.right) if c}
    for name in operands:
        if hierarchy.resolve(name).dimension != fact_name:
            raise PlanError(f"{name} is not a measure of {fact_name}")

    own = [d for d in by_dimension if d in (fact_name, "DATE")]  # held or computed by the fact itself
    filters = [p for d in own for p in by_dimension[d]]
    needed = operands | {p.attribute for p in filters} | {g for g in groups if hierarchy.resolve(g).dimension in own}
    needed = {hierarchy.resolve(c).name for c in needed}
    joined = _assemble(catalog, needed, filters, by_dimension, groups)

    aliases = [m.alias for m in plan.measures]
    out = aggregates.aggregate(joined, groups, plan.measures, drop_zero=compat)
    out = ordering.order(out, plan.order_by, groups, aliases, lenient=compat)
    if plan.limit is not None:
        out = ordering.top(out, plan.limit)
    if plan.project:
        names = [ordering.resolve(n, groups, aliases) for n in plan.project]
        if None in names and not compat:
            raise PlanError(f"cannot project {plan.project[names.index(None)]!r}")
        out = out.select(*dict.fromkeys(n for n in names if n))
    return out
