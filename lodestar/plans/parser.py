"""JSON query document -> QueryPlan.

Object keys match without regard to case; the step words DRILLDOWN and ROLLUP, the operators and
all table and column names match exactly. Unknown operators are an error.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

from lodestar.plans.model import Measure, OlapStep, Op, OrderKey, PlanError, Predicate, QueryPlan

_OPS = {"=": Op.EQ, "<": Op.LT, ">": Op.GT, "<=": Op.LE, ">=": Op.GE, "BETWEENAND": Op.BETWEEN, "BETWEEN": Op.BETWEEN, "OR": Op.IN, "IN": Op.IN}
_MEASURE = re.compile(r"\s*(\w+)\s*(?:([-+*/])\s*(\w+)\s*)?")
FUNCTIONS = ("SUM", "COUNT", "AVG", "MIN", "MAX")
CORPUS = Path(__file__).parents[1] / "corpus"


def _get(obj: dict, key: str, default=None):
    if key in obj:
        return obj[key]
    return next((v for k, v in obj.items() if k.upper() == key), default)


def _list(value, what: str) -> list:
    if value is None:
        return []
    if not isinstance(value, list):
        raise PlanError(f"{what} must be a list")
    return value


def _predicate(obj: dict) -> Predicate:
    name, text, value = _get(obj, "NAME"), _get(obj, "EXPRESSION", "="), _get(obj, "VALUE")
    if not isinstance(name, str) or not name:
        raise PlanError("a filter needs a NAME")
    if text not in _OPS:
        raise PlanError(f"unknown operator {text!r} on {name}")
    op = _OPS[text]
    values = tuple(value) if isinstance(value, list) else (value,)
    if any(isinstance(v, (dict, list, bool)) or v is None for v in values) or not values:
        raise PlanError(f"{name}: VALUE must be a number, a text or a list of them")
    if op is Op.BETWEEN and len(values) != 2:
        raise PlanError(f"{name}: {text} needs two values")
    if isinstance(value, list) and op is not Op.BETWEEN:
        op = Op.IN
    return Predicate(name, op, values, _get(obj, "TABLE"))


def _step(kind: str, obj: dict) -> OlapStep:
    dimension, group, filters = _get(obj, "DIMENSION"), _get(obj, "GROUP"), _get(obj, "FILTER")
    if not isinstance(dimension, str):
        raise PlanError(f"a {kind} step needs a DIMENSION")
    if isinstance(filters, dict):
        filters = [filters] if filters else []
    return OlapStep(kind, dimension, group if isinstance(group, str) and group else None, tuple(_predicate(f) for f in _list(filters, "FILTER") if f))


def _measure(obj: dict, warnings: list[str]) -> Measure:
    function, text = str(_get(obj, "FUNCTION", "SUM")).upper(), str(_get(obj, "EXPRESSION", ""))
    if function not in FUNCTIONS:
        raise PlanError(f"unknown function {function!r}")
    if not (m := _MEASURE.fullmatch(text)):
        raise PlanError(f"not a measure: {text!r}; write A or A op B with op one of + - * /")
    engine = str(_get(obj, "EXECUTION_ENGINE", "GPU")).upper()
    if engine not in ("GPU", "CPU"):
        warnings.append(f"unknown engine {engine!r}; the hint changes nothing here")
        engine = "GPU"
    return Measure(function, m[1], m[2], m[3], _get(obj, "ALIAS") or "REVENUE", _get(obj, "TABLE", "LINEORDER"), engine)


def parse_query(source: str | dict | Path) -> QueryPlan:
    """source: a document, its JSON text, a path, or the bare name of a query of the corpus."""
    if isinstance(source, Path) or isinstance(source, str) and not source.lstrip().startswith("{"):
        path = Path(source)
        for at in (path, CORPUS / path.name, CORPUS / f"{path.name}.json"):
            if at.is_file():
                source = json.loads(at.read_text())
                break
        else:
            raise PlanError(f"no query file {source}")
    elif isinstance(source, str):
        try:
            source = json.loads(source)
        except ValueError as e:
            raise PlanError(f"not JSON: {e}") from e
    select = _get(source, "SELECT")
    if not isinstance(select, dict):
        raise PlanError("the document has no SELECT object")
    warnings: list[str] = []
    steps = []
    for block in _list(_get(select, "OLAP"), "OLAP"):
        if not isinstance(block, dict):
            raise PlanError("OLAP must hold objects")
        for kind, items in block.items():  # in the order of the document
            if kind not in ("DRILLDOWN", "ROLLUP"):
                raise PlanError(f"unknown OLAP step {kind!r}")
            steps += [_step(kind, x) for x in ([items] if isinstance(items, dict) else _list(items, kind))]
    order = [OrderKey(_get(x, "NAME"), _get(x, "MODE", "ASC") == "ASC") for x in _list(_get(select, "ORDERBY"), "ORDERBY") if isinstance(x, dict) and _get(x, "NAME")]
    measures = tuple(_measure(x, warnings) for x in _list(_get(select, "AGG"), "AGG"))
    if not measures:
        raise PlanError("AGG is empty")
    if len({m.alias for m in measures}) < len(measures):
        raise PlanError("two measures have one alias")
    limit = _get(select, "LIMIT")
    return QueryPlan(
        tuple(x for x in _list(_get(select, "PROJECT"), "PROJECT") if isinstance(x, str)),
        tuple(order),
        tuple(steps),
        tuple(_predicate(x) for x in _list(_get(select, "FILTING"), "FILTING") if x),
        measures,
        int(limit) if limit is not None else None,
        tuple(warnings),
    )
