"""Filters: typed comparisons on one attribute."""

from __future__ import annotations

import re
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import brand_number
from lodestar.plans.hierarchy import Attribute
from lodestar.plans.model import Op, PlanError, Predicate


def _literal(attribute: Attribute, value, as_number: bool):
    if as_number:
        m = re.search(r"(\d+)$", str(value))
        if not m:
            raise PlanError(f"{attribute.name}: {value!r} has no number at its end")
        return int(m[1])
    if attribute.kind == "int":
        try:
            return int(str(value))
        except ValueError:
            raise PlanError(f"{attribute.name} is a number; {value!r} is none") from None
    return str(value)


def condition(attribute: Attribute, predicate: Predicate, column: Column | None = None) -> Column:
    """The predicate as a Column. Attributes with suffix order compare ranges by number, so
    MFGR#999 lies before MFGR#2221; equality and IN compare the text itself."""
    col = F.col(attribute.name) if column is None else column
    ranged = predicate.op not in (Op.EQ, Op.IN)
    by_number = attribute.compare == "suffix" and ranged
    values = [_literal(attribute, v, by_number) for v in predicate.values]
    if by_number:
        col = brand_number(col)
    match predicate.op:
        case Op.EQ:
            return col == values[0]
        case Op.LT:
            return col < values[0]
        case Op.GT:
            return col > values[0]
        case Op.LE:
            return col <= values[0]
        case Op.GE:
            return col >= values[0]
        case Op.BETWEEN:
            return col.between(*values)
        case Op.IN:
            return col.isin(*values)
    raise PlanError(f"unsupported operator {predicate.op}")


_MONTHS = {date(2000, k, 1).strftime("%b"): k for k in range(1, 13)}


def _period(name: str, value) -> tuple[date, date] | None:
    """[first, end) of the days that this member of a calendar level holds; null if it is none."""
    text = str(value)
    if name == "D_YEARMONTH" and text[:3] in _MONTHS and text[3:].isdigit():
        name, text = "D_YEARMONTHNUM", f"{text[3:]}{_MONTHS[text[:3]]:02}"
    try:
        if name == "D_YEAR":
            return date(int(text), 1, 1), date(int(text) + 1, 1, 1)
        if name == "D_YEARMONTHNUM":
            year, month = divmod(int(text), 100)
            return date(year, month, 1), date(year + month // 12, month % 12 + 1, 1)
        if name in ("D_DATEKEY", "LO_ORDERDATE"):
            day = date(int(text) // 10000, int(text) // 100 % 100, int(text) % 100)
            return day, date.fromordinal(day.toordinal() + 1)
    except (ValueError, OverflowError):
        pass
    return None


def date_span(predicate: Predicate) -> tuple[date, date] | None:
    """[first, end) that a condition on a calendar level implies for the day, if it implies one."""
    name = predicate.attribute.upper()
    spans = [_period(name, v) for v in predicate.values]
    if None in spans or (name == "D_YEARMONTH" and predicate.op not in (Op.EQ, Op.IN)):
        return None
    first, end = min(s[0] for s in spans), max(s[1] for s in spans)
    match predicate.op:
        case Op.EQ | Op.IN | Op.BETWEEN:
            return first, end
        case Op.LT:
            return date.min, first
        case Op.LE:
            return date.min, end
        case Op.GT:
            return end, date.max
        case Op.GE:
            return first, date.max
    return None


def where(df: DataFrame, conditions: list[Column]) -> DataFrame:
    """One filter with all conditions, which Catalyst splits and pushes down."""
    return df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df
