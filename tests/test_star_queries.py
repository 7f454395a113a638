import pytest

from lodestar import queries as star
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(star.queries()))
def test_equals_its_sql(spark, data, name):
    sf = f"{data}/sf0.01"
    assert_same(star.queries()[name](spark, sf), sf, star.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(star.queries()) == set(star.oracle_sql())


# Results at sf0.01 that were computed beforehand with plain SQL.
@pytest.mark.parametrize(("name", "value"), [("q1_1", 12967086011), ("q1_2", 1005136731), ("q1_3", 677873063)])
def test_spot_values(spark, data, name, value):
    assert star.queries()[name](spark, f"{data}/sf0.01").collect()[0][0] == value


# Row counts at sf0.01.
COUNTS = {"q2_1": 219, "q2_2": 30, "q2_3": 5, "q3_1": 149, "q3_2": 132, "q3_3": 12, "q3_4": 1, "q4_1": 35, "q4_2": 96, "q4_3": 44}


@pytest.mark.parametrize("name", sorted(COUNTS))
def test_row_counts(spark, data, name):
    assert star.queries()[name](spark, f"{data}/sf0.01").count() == COUNTS[name]


def test_profit_by_nation_and_by_category_agree(spark, data):
    from pyspark.sql import functions as F

    a = star.queries()["q4_1"](spark, f"{data}/sf0.01").filter(F.col("D_YEAR").isin(1997, 1998)).groupBy("D_YEAR").agg(F.sum("PROFIT"))
    b = star.queries()["q4_2"](spark, f"{data}/sf0.01").groupBy("D_YEAR").agg(F.sum("PROFIT"))
    assert sorted(a.collect()) == sorted(b.collect())


def test_rows_come_in_the_order_asked_for(spark, data):
    rows = star.queries()["q3_1"](spark, f"{data}/sf0.01").collect()
    assert rows == sorted(rows, key=lambda r: (r["D_YEAR"], -r["REVENUE"]))
