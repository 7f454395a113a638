"""Text forms of a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lodestar.plans.model import QueryPlan


def render(plan: QueryPlan) -> str:
    out = ["Projection: " + (", ".join(plan.project) or "all")]
    for step in plan.steps:
        shown = " and ".join(map(str, step.filters)) or "no filter"
        out.append(f"{step.kind} {step.dimension}: group {step.group or 'none'}; {shown}")
    out += [f"Filter: {p.table + '.' if p.table else ''}{p}" for p in plan.filters]
    out += [f"Aggregate: {m} on {m.table} (engine hint {m.engine}, ignored)" for m in plan.measures]
    out.append("Order: " + (", ".join(f"{k.name} {'ASC' if k.ascending else 'DESC'}" for k in plan.order_by) or "none"))
    out += [f"Warning: {w}" for w in plan.warnings]
    return "\n".join(out)


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
