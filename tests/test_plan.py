import json
import re
from datetime import date

import pytest

from lodestar.cli import main
from lodestar.operators.predicates import date_span
from lodestar.plans.compiler import compile_plan
from lodestar.plans.hierarchy import Hierarchy
from lodestar.plans.model import Op, PlanError
from lodestar.plans.parser import parse_query
from lodestar.plans.printer import physical, render
from lodestar.queries import _doc
from lodestar.sources.catalog import StarCatalog


def parsed(**more):
    return parse_query(_doc(**more))


@pytest.mark.parametrize(
    ("text", "op"),
    [("=", Op.EQ), ("<", Op.LT), (">", Op.GT), ("<=", Op.LE), (">=", Op.GE)],
)
def test_operators(text, op):
    assert parsed(steps=[("DATE", None, ("D_YEAR", text, 1996))]).steps[0].filters[0].op is op


def test_lists_are_ranges_or_sets():
    f = lambda op, v: parsed(steps=[("DATE", None, ("D_YEAR", op, v))]).steps[0].filters[0]
    assert f("BETWEENAND", [1, 2]).op is f("BETWEEN", [1, 2]).op is Op.BETWEEN
    assert f("OR", [1, 2]).op is Op.IN
    assert f("OR", 1).values == (1,)
    assert f("=", [1, 2, 3]).op is Op.IN


@pytest.mark.parametrize(
    "doc",
    [
        "{not json",
        {"FROM": 1},
        _doc([("DATE", None, ("D_YEAR", "~", 1))]),
        _doc([("DATE", None, ("D_YEAR", "BETWEEN", [1]))]),
        _doc(measure="LO_REVENUE*2*3"),
        _doc(function="MEDIAN"),
        {"SELECT": {"OLAP": [{"SLICE": []}], "AGG": [{"EXPRESSION": "LO_REVENUE"}]}},
        {"SELECT": {"AGG": []}},
        "no_such_query",
    ],
)
def test_bad_documents(doc):
    with pytest.raises(PlanError):
        parse_query(doc)


@pytest.mark.parametrize(
    "doc",
    [
        _doc([("PLANET", "D_YEAR")]),
        _doc([("DATE", "C_CITY")]),
        _doc([("DATE", "D_CENTURY")]),
        _doc([("DATE", None, ("D_YEAR", "=", "3ABC"))]),
        _doc(measure="D_YEAR"),
        _doc(order=[("P_BRAND", "ASC")]),
        _doc(project=["P_BRAND"]),
    ],
)
def test_bad_names(spark, data, doc):
    with pytest.raises(PlanError):
        compile_plan(StarCatalog(spark, f"{data}/sf0.001"), parse_query(doc))


def test_compat_ignores_unknown_names(spark, data):
    doc = _doc([("PLANET", None), ("DATE", "D_YEAR")], order=[("P_BRAND", "ASC")], project=["P_BRAND", "REVENUE"])
    assert compile_plan(StarCatalog(spark, f"{data}/sf0.001"), parse_query(doc), compat=True).columns == ["REVENUE"]


def test_keys_match_in_any_case_and_empty_objects_mean_nothing():
    doc = json.loads(json.dumps(_doc([("DATE", "D_YEAR")])).replace('"SELECT"', '"select"').replace('"AGG"', '"Agg"'))
    plan = parse_query(doc)
    assert plan.steps[0].group == "D_YEAR"
    assert parsed(steps=[("DATE", None)]).steps[0].group is None


def test_engine_hint_warns_and_order_entries_may_be_words():
    doc = _doc()
    doc["SELECT"]["AGG"][0]["EXECUTION_ENGINE"] = "tpu"
    doc["SELECT"]["ORDERBY"] = ["NONE"]
    plan = parse_query(doc)
    assert plan.warnings and plan.order_by == ()


def test_printing():
    text = render(parse_query("q2_1"))
    assert "P_CATEGORY = MFGR#12" in text and "SUM(LO_REVENUE) AS REVENUE" in text
    assert "CUSTOMER\n  -> C_CITY: CITY" in Hierarchy.load().render()


def test_plan_prunes_columns_and_tables_and_pushes_filters(spark, data):
    df = compile_plan(StarCatalog(spark, f"{data}/sf0.01"), parse_query("q1_1"))
    text = physical(df)
    assert "p_retailprice" not in text and "l_tax" not in text
    text = physical(compile_plan(StarCatalog(spark, f"{data}/sf0.01"), parse_query("q3_1")))
    assert "EqualTo(r_name,ASIA)" in text and "BroadcastHashJoin" in text


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_dimensions_cut_lines_and_orders_before_these_meet(spark, data):
    star = StarCatalog(spark, f"{data}/sf0.01")
    for name in ("q4_1", "q3_1"):
        text = final_plan(compile_plan(star, parse_query(name)))
        depth = {k: next(len(line) - len(line.lstrip(" :+-")) for line in text.splitlines() if k in line) for k in ("l_orderkey#", "[__order#", "[LO_SUPPKEY#", "[LO_CUSTKEY#") if k in text}
        # deeper in the tree: earlier
        assert depth["[LO_SUPPKEY#"] > depth["[__order#"] and depth["[LO_CUSTKEY#"] > depth["[__order#"], text
        assert "hashpartitioning(LO_SUPPKEY" not in text and "hashpartitioning(LO_CUSTKEY" not in text
        assert text.count("part.parquet") <= 1


def test_date_filters_reach_the_scan_as_bounds(spark, data):
    star = StarCatalog(spark, f"{data}/sf0.001")
    for name, first, end in (("q3_1", "1995-01-01", "2001-01-01"), ("q1_2", "1997-01-01", "1997-02-01"), ("q3_4", "1997-12-01", "1998-01-01")):
        text = re.sub(r"#\d+", "#{}", physical(compile_plan(star, parse_query(name))))
        assert f"(o_orderdate#{{}} >= {first} 00:00:00)" in text and f"(o_orderdate#{{}} < {end} 00:00:00)" in text
    spans = lambda *f: date_span(parse_query(_doc([("DATE", None, f)])).steps[0].filters[0])
    assert spans("D_YEARMONTHNUM", ">", 199712) == (date(1998, 1, 1), date.max)
    assert spans("D_DATEKEY", "<=", 19970228) == (date.min, date(1997, 3, 1))
    assert spans("D_YEARMONTH", "<", "Dec1997") is None and spans("D_WEEKNUMINYEAR", "=", 6) is None
    assert spans("D_YEAR", "=", 99999) is None and spans("D_YEARMONTH", "=", "Xyz1997") is None


def test_large_dimensions_are_not_broadcast_by_hint(spark, data):
    star = StarCatalog(spark, f"{data}/sf0.001")
    assert star.small("supplier")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert not star.small("supplier")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_command_line(data, capsys, spark):
    assert main(["q4_1", "--data", f"{data}/sf0.001", "--explain"]) == 0
    out = capsys.readouterr().out
    assert "Total Rows: 18" in out and "BroadcastHashJoin" in out
