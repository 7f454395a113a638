"""Registered queries of the star engine and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.operators import aggregates, joins, ordering
from lodestar.operators.ordering import top
from lodestar.plans.compiler import compile_plan
from lodestar.plans.model import Measure, OrderKey
from lodestar.plans.parser import CORPUS, parse_query
from lodestar.sources.catalog import StarCatalog
from lodestar.streaming.events import windowed

Query = Callable[[SparkSession, str], DataFrame]
CORPUS_NAMES = sorted(p.stem for p in CORPUS.glob("q*.json"))


def _doc(steps=(), measure="LO_REVENUE", alias="REVENUE", filters=(), order=(), project=(), function="SUM", kind="DRILLDOWN", more=(), limit=None) -> dict:
    def one(dimension, group, *fs):
        return {"DIMENSION": dimension, "GROUP": group or {}, "FILTER": [dict(zip(("NAME", "EXPRESSION", "VALUE"), f, strict=True)) for f in fs]}

    aggs = [{"FUNCTION": function, "EXPRESSION": measure, "ALIAS": alias}] + [dict(zip(("FUNCTION", "EXPRESSION", "ALIAS"), m, strict=True)) for m in more]
    return {"SELECT": {
        "PROJECT": list(project), "ORDERBY": [{"NAME": n, "MODE": m} for n, m in order], "OLAP": [{kind: [one(*s) for s in steps]}],
        "FILTING": [dict(zip(("NAME", "EXPRESSION", "VALUE"), f, strict=True)) for f in filters], "AGG": aggs, **({"LIMIT": limit} if limit else {}),
    }}


def _run(doc, spark: SparkSession, sf_dir: str, compat: bool = False) -> DataFrame:
    return compile_plan(StarCatalog(spark, sf_dir), parse_query(doc), compat)


def _scan_fact(spark, sf_dir):
    return StarCatalog(spark, sf_dir).fact()


def _scan_dim(name, spark, sf_dir):
    return StarCatalog(spark, sf_dir).dimension(name)


def _semi_mark(spark, sf_dir):
    """Nations of a region, marked from above, and their suppliers: two semi joins."""
    c = StarCatalog(spark, sf_dir)
    region, nation, supplier = c.table("region").filter(F.col("r_name") == "ASIA"), c.table("nation"), c.table("supplier")
    nations = joins.members(nation, region, nation["n_regionkey"] == region["r_regionkey"])
    return joins.members(supplier, nations, supplier["s_nationkey"] == nations["n_nationkey"]).select("s_suppkey", "s_name")


def _members(spark, sf_dir):
    return aggregates.distinct_members(StarCatalog(spark, sf_dir).dimension("PART"), "P_BRAND1")


def _ranked(doc, columns, spark, sf_dir):
    """The order made visible: a rank column over the keys of the query."""
    plan = parse_query(doc)
    df = _run(doc, spark, sf_dir)
    keys = [F.col(k.name).asc() if k.ascending else F.col(k.name).desc() for k in plan.order_by]
    return df.withColumn("PLACE", F.row_number().over(W.orderBy(*keys, *columns)))


def _subtotals(kind, spark, sf_dir):
    c = StarCatalog(spark, sf_dir)
    fact, supplier = c.fact({"LO_SUPPKEY", "LO_REVENUE", "D_YEAR"}), c.dimension("SUPPLIER", {"S_REGION"})
    joined = joins.lookup(fact, supplier, fact["LO_SUPPKEY"] == supplier["S_SUPPKEY"])
    return aggregates.cube(joined, ["S_REGION", "D_YEAR"], (Measure("SUM", "LO_REVENUE", alias="REVENUE"),), kind).select("S_REGION", "D_YEAR", F.col("grouping_id").cast("int").alias("GROUPING_ID"), "REVENUE")


def _top(spark, sf_dir):
    df = _run(_doc([("SUPPLIER", "S_CITY")]), spark, sf_dir)
    return top(ordering.order(df, (OrderKey("REVENUE", False),), ["S_CITY"], ["REVENUE"]), 10)


def _events(spark, sf_dir):
    return windowed(spark.read.parquet(f"{sf_dir}/events.parquet"))


_STAR = """WITH lineorder AS (
 SELECT l_orderkey AS LO_ORDERKEY, l_linenumber AS LO_LINENUMBER, o_custkey AS LO_CUSTKEY, l_partkey AS LO_PARTKEY, l_suppkey AS LO_SUPPKEY,
  CAST(year(o_orderdate)*10000+month(o_orderdate)*100+day(o_orderdate) AS INT) AS LO_ORDERDATE,
  CAST(round(l_quantity) AS INT) AS LO_QUANTITY, CAST(round(l_discount*100) AS INT) AS LO_DISCOUNT,
  CAST(round(l_extendedprice*100) AS BIGINT) AS LO_EXTENDEDPRICE,
  CAST(floor(round(l_extendedprice*100)*(100-round(l_discount*100))/100) AS BIGINT) AS LO_REVENUE,
  CAST(floor(6*round(p_retailprice*100)/10) AS BIGINT) AS LO_SUPPLYCOST,
  CAST(year(o_orderdate) AS INT) AS D_YEAR, CAST(year(o_orderdate)*100+month(o_orderdate) AS INT) AS D_YEARMONTHNUM,
  strftime(o_orderdate,'%b%Y') AS D_YEARMONTH, CAST(floor((dayofyear(o_orderdate)-1)/7)+1 AS INT) AS D_WEEKNUMINYEAR
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey),
cust AS (SELECT c_custkey AS C_CUSTKEY, concat(rpad(substr(n_name,1,9),9,' '), c_custkey % 10) AS C_CITY, n_name AS C_NATION, r_name AS C_REGION
 FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey),
supp AS (SELECT s_suppkey AS S_SUPPKEY, concat(rpad(substr(n_name,1,9),9,' '), s_suppkey % 10) AS S_CITY, n_name AS S_NATION, r_name AS S_REGION
 FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey),
num AS (SELECT p_partkey, p_size, CAST(regexp_extract(p_brand,'([0-9]+)$',1) AS INT) AS n FROM part),
brand AS (SELECT p_partkey AS P_PARTKEY, concat('MFGR#', CAST(floor((n-1)/5)+1 AS INT)) AS P_MFGR,
  concat('MFGR#', CAST(floor((n-1)/5)+1 AS INT), (n-1)%5+1) AS P_CATEGORY,
  concat('MFGR#', CAST(floor((n-1)/5)+1 AS INT), (n-1)%5+1, (p_size-1)%40+1) AS P_BRAND1 FROM num)
"""
_C, _S, _P = " JOIN cust ON LO_CUSTKEY=C_CUSTKEY", " JOIN supp ON LO_SUPPKEY=S_SUPPKEY", " JOIN brand ON LO_PARTKEY=P_PARTKEY"
_NUM = "CAST(regexp_extract(P_BRAND1,'([0-9]+)$',1) AS INT)"


def _sql(select: str, joined: str = "", where: str = "", group: str = "", metric: str = "SUM(LO_REVENUE)", alias: str = "REVENUE", kind: str = "BIGINT", more: str = "") -> str:
    measured = f"CAST({metric} AS {kind}) AS {alias}{more}"
    return f"{_STAR}SELECT {select + ', ' if select else ''}{measured} FROM lineorder{joined}{' WHERE ' + where if where else ''}{' GROUP BY ' + group if group else ''}"


_PRODUCT, _PROFIT = "SUM(LO_EXTENDEDPRICE*LO_DISCOUNT)", "SUM(LO_REVENUE-LO_SUPPLYCOST)"
_CITIES = "('NATION_7 1','NATION_7 2')"
_AMERICA = "C_REGION='AMERICA' AND S_REGION='AMERICA' AND P_MFGR IN ('MFGR#1','MFGR#2')"

CORPUS_SQL = {
    "q1_1": _sql("", where="D_YEAR=1996 AND LO_DISCOUNT BETWEEN 1 AND 3 AND LO_QUANTITY<25", metric=_PRODUCT),
    "q1_2": _sql("", where="D_YEARMONTH='Jan1997' AND LO_DISCOUNT BETWEEN 4 AND 6 AND LO_QUANTITY BETWEEN 26 AND 35", metric=_PRODUCT),
    "q1_3": _sql("", where="D_YEAR=1997 AND D_WEEKNUMINYEAR=6 AND LO_DISCOUNT BETWEEN 5 AND 7 AND LO_QUANTITY BETWEEN 26 AND 35", metric=_PRODUCT),
    "q2_1": _sql("P_BRAND1, D_YEAR", _P + _S, "P_CATEGORY='MFGR#12' AND S_REGION='AMERICA'", "P_BRAND1, D_YEAR"),
    "q2_2": _sql("P_BRAND1, D_YEAR", _P + _S, f"{_NUM} BETWEEN 2221 AND 2228 AND S_REGION='ASIA'", "P_BRAND1, D_YEAR"),
    "q2_3": _sql("P_BRAND1, D_YEAR", _P + _S, "P_BRAND1='MFGR#2239' AND S_REGION='EUROPE'", "P_BRAND1, D_YEAR"),
    "q3_1": _sql("S_NATION, C_NATION, D_YEAR", _S + _C, "S_REGION='ASIA' AND C_REGION='ASIA' AND D_YEAR BETWEEN 1995 AND 2000", "ALL"),
    "q3_2": _sql("S_CITY, C_CITY, D_YEAR", _S + _C, "S_NATION='NATION_7' AND C_NATION='NATION_7' AND D_YEAR BETWEEN 1995 AND 2000", "ALL"),
    "q3_3": _sql("S_CITY, C_CITY, D_YEAR", _S + _C, f"S_CITY IN {_CITIES} AND C_CITY IN {_CITIES} AND D_YEAR BETWEEN 1995 AND 2000", "ALL"),
    "q3_4": _sql("D_YEAR, C_CITY, S_CITY", _S + _C, f"S_CITY IN {_CITIES} AND C_NATION='NATION_7' AND D_YEARMONTH='Dec1997'", "ALL"),
    "q4_1": _sql("D_YEAR, C_NATION", _S + _C + _P, _AMERICA, "ALL", _PROFIT, "PROFIT"),
    "q4_2": _sql("D_YEAR, S_NATION, P_CATEGORY", _S + _C + _P, f"{_AMERICA} AND D_YEAR IN (1997,1998)", "ALL", _PROFIT, "PROFIT"),
    "q4_3": _sql("D_YEAR, S_CITY, P_BRAND1", _S + _P, "S_NATION='NATION_7' AND P_CATEGORY='MFGR#14' AND D_YEAR IN (1997,1998)", "ALL", _PROFIT, "PROFIT"),
}

_METRIC_DESC = _doc([("SUPPLIER", "S_NATION")], order=[("REVENUE", "DESC")])
_MULTI_KEY = _doc([("SUPPLIER", "S_REGION"), ("DATE", "D_YEAR")], order=[("D_YEAR", "DESC"), ("S_REGION", "ASC")])
_NEVER = [("DATE", "D_YEAR", ("D_YEAR", "=", 1900))]

#: One query for each operator: (query, SQL).
OPERATORS: dict[str, tuple[Query, str]] = {
    "scan_fact": (_scan_fact, _STAR + "SELECT LO_ORDERKEY, LO_LINENUMBER, LO_CUSTKEY, LO_PARTKEY, LO_SUPPKEY, LO_ORDERDATE, LO_QUANTITY, LO_DISCOUNT, LO_EXTENDEDPRICE, LO_REVENUE, LO_SUPPLYCOST FROM lineorder"),
    "scan_dim": (partial(_scan_dim, "CUSTOMER"), _STAR + "SELECT * FROM cust"),
    "scan_dim_supplier": (partial(_scan_dim, "SUPPLIER"), _STAR + "SELECT * FROM supp"),
    "scan_dim_part": (partial(_scan_dim, "PART"), _STAR + "SELECT * FROM brand"),
    "scan_dim_date": (partial(_scan_dim, "DATE"), _STAR + "SELECT DISTINCT LO_ORDERDATE AS D_DATEKEY, D_YEAR, D_YEARMONTHNUM, D_YEARMONTH, D_WEEKNUMINYEAR FROM (SELECT CAST(year(o_orderdate)*10000+month(o_orderdate)*100+day(o_orderdate) AS INT) AS LO_ORDERDATE, CAST(year(o_orderdate) AS INT) AS D_YEAR, CAST(year(o_orderdate)*100+month(o_orderdate) AS INT) AS D_YEARMONTHNUM, strftime(o_orderdate,'%b%Y') AS D_YEARMONTH, CAST(floor((dayofyear(o_orderdate)-1)/7)+1 AS INT) AS D_WEEKNUMINYEAR FROM orders)"),
    "filter_eq": (partial(_run, _doc([("DATE", "D_YEARMONTH", ("D_YEAR", "=", 1997))])), _sql("D_YEARMONTH", where="D_YEAR=1997", group="ALL")),
    "filter_lt": (partial(_run, _doc([("LINEORDER", "LO_DISCOUNT", ("LO_QUANTITY", "<", 10))])), _sql("LO_DISCOUNT", where="LO_QUANTITY<10", group="ALL")),
    "filter_between": (partial(_run, _doc([("LINEORDER", "LO_QUANTITY", ("LO_DISCOUNT", "BETWEEN", [2, 4]))])), _sql("LO_QUANTITY", where="LO_DISCOUNT BETWEEN 2 AND 4", group="ALL")),
    "filter_in1": (partial(_run, _doc([("SUPPLIER", "S_NATION", ("S_REGION", "OR", ["ASIA"]))])), _sql("S_NATION", _S, "S_REGION='ASIA'", "ALL")),
    "filter_in2": (partial(_run, _doc([("SUPPLIER", "S_NATION", ("S_REGION", "OR", ["ASIA", "EUROPE"]))])), _sql("S_NATION", _S, "S_REGION IN ('ASIA','EUROPE')", "ALL")),
    "filter_in_many": (partial(_run, _doc([("DATE", "D_YEAR", ("D_YEAR", "IN", [1995, 1996, 1998, 2000]))])), _sql("D_YEAR", where="D_YEAR IN (1995,1996,1998,2000)", group="ALL")),
    "filter_and_chain": (partial(_run, _doc([("DATE", "D_YEAR", ("D_YEAR", ">=", 1996), ("D_WEEKNUMINYEAR", "<", 20)), ("CUSTOMER", "C_NATION", ("C_REGION", "=", "ASIA"), ("C_NATION", "OR", ["NATION_2", "NATION_7", "NATION_12"]))])), _sql("D_YEAR, C_NATION", _C, "D_YEAR>=1996 AND D_WEEKNUMINYEAR<20 AND C_REGION='ASIA' AND C_NATION IN ('NATION_2','NATION_7','NATION_12')", "ALL")),
    "filter_gt_le_ge": (partial(_run, _doc([("LINEORDER", "LO_QUANTITY", ("LO_DISCOUNT", ">", 2), ("LO_QUANTITY", "<=", 30), ("LO_QUANTITY", ">=", 5))])), _sql("LO_QUANTITY", where="LO_DISCOUNT>2 AND LO_QUANTITY<=30 AND LO_QUANTITY>=5", group="ALL")),
    "filter_fact": (partial(_run, _doc([("LINEORDER", None, ("LO_REVENUE", ">", 3000000)), ("DATE", "D_YEAR")])), _sql("D_YEAR", where="LO_REVENUE>3000000", group="ALL")),
    "filting_global": (partial(_run, _doc([("DATE", "D_YEAR")], filters=[("S_REGION", "=", "AFRICA"), ("LO_DISCOUNT", "<", 5), ("P_MFGR", "=", "MFGR#3")])), _sql("D_YEAR", _S + _P, "S_REGION='AFRICA' AND LO_DISCOUNT<5 AND P_MFGR='MFGR#3'", "ALL")),
    "filter_yearmonthnum": (partial(_run, _doc([("DATE", "D_YEARMONTH", ("D_YEARMONTHNUM", "BETWEEN", [199611, 199702]))])), _sql("D_YEARMONTH", where="D_YEARMONTHNUM BETWEEN 199611 AND 199702", group="ALL")),
    "rollup_semi_mark": (_semi_mark, "SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey WHERE r_name='ASIA'"),
    "drilldown_region_to_base": (partial(_run, _doc([("SUPPLIER", "S_SUPPKEY", ("S_REGION", "=", "AFRICA"))])), _sql("S_SUPPKEY", _S, "S_REGION='AFRICA'", "ALL")),
    "drilldown_group_lower": (partial(_run, _doc([("CUSTOMER", "C_CITY", ("C_REGION", "=", "EUROPE"))])), _sql("C_CITY", _C, "C_REGION='EUROPE'", "ALL")),
    "drilldown_group_higher": (partial(_run, _doc([("PART", "P_MFGR", ("P_BRAND1", "<", "MFGR#2000"))])), _sql("P_MFGR", _P, f"{_NUM}<2000", "ALL")),
    "rollup_month_to_year": (partial(_run, _doc([("DATE", "D_YEAR", ("D_YEARMONTH", "=", "Dec1997"))], kind="ROLLUP")), _sql("D_YEAR", where="D_YEARMONTH='Dec1997'", group="ALL")),
    "rollup_city_to_region": (partial(_run, _doc([("CUSTOMER", "C_REGION", ("C_CITY", "OR", ["NATION_7 1", "NATION_9 4"]))], kind="ROLLUP")), _sql("C_REGION", _C, "C_CITY IN ('NATION_7 1','NATION_9 4')", "ALL")),
    "star_join_1": (partial(_run, _doc([("PART", "P_CATEGORY")])), _sql("P_CATEGORY", _P, group="ALL")),
    "star_join_2": (partial(_run, _doc([("PART", "P_MFGR"), ("SUPPLIER", "S_REGION")])), _sql("P_MFGR, S_REGION", _P + _S, group="ALL")),
    "star_join_4": (partial(_run, _doc([("PART", "P_MFGR"), ("SUPPLIER", "S_REGION"), ("CUSTOMER", "C_REGION"), ("DATE", "D_YEAR")])), _sql("P_MFGR, S_REGION, C_REGION, D_YEAR", _P + _S + _C, group="ALL")),
    "semi_join_no_group": (partial(_run, _doc([("SUPPLIER", None, ("S_NATION", "=", "NATION_3")), ("DATE", "D_YEAR")])), _sql("D_YEAR", _S, "S_NATION='NATION_3'", "ALL")),
    "sum_single": (partial(_run, _doc([("DATE", "D_YEAR")], "LO_EXTENDEDPRICE", "TOTAL")), _sql("D_YEAR", group="ALL", metric="SUM(LO_EXTENDEDPRICE)", alias="TOTAL")),
    "sum_product": (partial(_run, _doc([("DATE", "D_YEAR")], "LO_EXTENDEDPRICE*LO_DISCOUNT", "TOTAL")), _sql("D_YEAR", group="ALL", metric=_PRODUCT, alias="TOTAL")),
    "sum_subtract": (partial(_run, _doc([("DATE", "D_YEAR")], "LO_REVENUE - LO_SUPPLYCOST", "TOTAL")), _sql("D_YEAR", group="ALL", metric=_PROFIT, alias="TOTAL")),
    "sum_add": (partial(_run, _doc([("DATE", "D_YEAR")], "LO_REVENUE+LO_SUPPLYCOST", "TOTAL")), _sql("D_YEAR", group="ALL", metric="SUM(LO_REVENUE+LO_SUPPLYCOST)", alias="TOTAL")),
    "max_divide": (partial(_run, _doc([("DATE", "D_YEAR")], "LO_EXTENDEDPRICE/LO_QUANTITY", "TOTAL", function="MAX")), _sql("D_YEAR", group="ALL", metric="MAX(LO_EXTENDEDPRICE/LO_QUANTITY)", alias="TOTAL", kind="DOUBLE")),
    "unknown_names_compat": (partial(_run, _doc([("PLANET", None), ("DATE", "D_YEAR")], order=[("P_BRAND", "ASC")]), compat=True), _sql("D_YEAR", group="ALL") + " HAVING SUM(LO_REVENUE) <> 0"),
    "agg_scalar": (partial(_run, _doc()), _sql("")),
    "agg_scalar_empty": (partial(_run, _doc([("DATE", None, ("D_YEAR", "=", 1900))])), _sql("", where="D_YEAR=1900")),
    "agg_scalar_empty_compat": (partial(_run, _doc([("DATE", None, ("D_YEAR", "=", 1900))]), compat=True), _sql("", where="D_YEAR=1900") + " HAVING SUM(LO_REVENUE) <> 0"),
    "agg_grouped": (partial(_run, _doc([("PART", "P_BRAND1")])), _sql("P_BRAND1", _P, group="ALL")),
    "agg_zero_group_compat": (partial(_run, _doc([("LINEORDER", "LO_DISCOUNT")], "LO_EXTENDEDPRICE*LO_DISCOUNT", "TOTAL"), compat=True), _sql("LO_DISCOUNT", group="ALL", metric=_PRODUCT, alias="TOTAL") + f" HAVING {_PRODUCT} <> 0"),
    "agg_many": (partial(_run, _doc([("DATE", "D_YEAR")], more=[("COUNT", "LO_REVENUE", "N"), ("MIN", "LO_REVENUE", "LEAST"), ("MAX", "LO_REVENUE", "MOST")])), _sql("D_YEAR", group="ALL", more=", COUNT(LO_REVENUE) AS N, MIN(LO_REVENUE) AS LEAST, MAX(LO_REVENUE) AS MOST")),
    "order_metric_desc": (partial(_ranked, _METRIC_DESC, ["S_NATION"]), f"SELECT *, CAST(row_number() OVER (ORDER BY REVENUE DESC, S_NATION) AS INT) AS PLACE FROM ({_sql('S_NATION', _S, group='ALL')})"),
    "order_multi_key": (partial(_ranked, _MULTI_KEY, []), f"SELECT *, CAST(row_number() OVER (ORDER BY D_YEAR DESC, S_REGION) AS INT) AS PLACE FROM ({_sql('S_REGION, D_YEAR', _S, group='ALL')})"),
    "project_reorder": (partial(_run, _doc([("PART", "P_MFGR"), ("DATE", "D_YEAR")], project=["REVENUE", "D_YEAR", "P_MFGR"])), _sql("P_MFGR, D_YEAR", _P, group="ALL")),
    "dictionary_distinct_members": (_members, _STAR + "SELECT DISTINCT P_BRAND1 FROM brand"),
    "brand_suffix_range": (partial(_run, _doc([("PART", "P_BRAND1", ("P_BRAND1", "BETWEEN", ["MFGR#999", "MFGR#1205"]))])), _sql("P_BRAND1", _P, f"{_NUM} BETWEEN 999 AND 1205", "ALL")),
    "subtotals_cube": (partial(_subtotals, "cube"), _STAR + "SELECT S_REGION, D_YEAR, CAST(GROUPING(S_REGION, D_YEAR) AS INT) AS GROUPING_ID, CAST(SUM(LO_REVENUE) AS BIGINT) AS REVENUE FROM lineorder" + _S + " GROUP BY CUBE (S_REGION, D_YEAR)"),
    "subtotals_rollup": (partial(_subtotals, "rollup"), _STAR + "SELECT S_REGION, D_YEAR, CAST(GROUPING(S_REGION, D_YEAR) AS INT) AS GROUPING_ID, CAST(SUM(LO_REVENUE) AS BIGINT) AS REVENUE FROM lineorder" + _S + " GROUP BY ROLLUP (S_REGION, D_YEAR)"),
    "top_k": (_top, _sql("S_CITY", _S, group="ALL") + " ORDER BY REVENUE DESC, S_CITY LIMIT 10"),
    "events_windowed": (_events, "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, CAST(sum(CAST(round(value*100) AS BIGINT)) AS BIGINT) AS value_cents FROM events GROUP BY ALL"),
}


def queries() -> dict[str, Query]:
    return {name: partial(_run, name) for name in CORPUS_NAMES} | {k: q for k, (q, _) in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return CORPUS_SQL | {k: sql for k, (_, sql) in OPERATORS.items()}
