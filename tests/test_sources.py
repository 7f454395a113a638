import struct

import pytest

from lodestar.operators.sinks import console, save
from lodestar.sources.catalog import StarCatalog
from lodestar.sources.flat import read_fact, read_text, verify_length
from lodestar.streaming.events import read_stream, run_available, windowed


def test_pipe_text(spark, tmp_path):
    (tmp_path / "nation_olap.csv").write_text("0|ALGERIA|0\n1|ARGENTINA|1\n")
    (tmp_path / "brand1.csv").write_text("MFGR#2221|1|1\n")
    assert [tuple(r) for r in read_text(spark, str(tmp_path), "nation_olap").collect()] == [(1, "ALGERIA", 1), (2, "ARGENTINA", 2)]
    assert read_text(spark, str(tmp_path), "brand1").collect()[0]["b1_val"] == 2221


def test_raw_columns(spark, tmp_path):
    values = list(range(-500, 500))
    (tmp_path / "lineorder.lo_revenue").write_bytes(struct.pack("<1000i", *values))
    (tmp_path / "lineorder.lo_discount").write_bytes(bytes(v % 11 for v in range(1000)))
    rows = read_fact(spark, str(tmp_path), {"lo_revenue": 4, "lo_discount": 1}).orderBy("row").collect()
    assert [r["lo_revenue"] for r in rows] == values
    assert [r["lo_discount"] for r in rows] == [v % 11 for v in range(1000)]
    (tmp_path / "lineorder.lo_discount").write_bytes(bytes(999))
    with pytest.raises(ValueError, match="999"):
        read_fact(spark, str(tmp_path), {"lo_revenue": 4, "lo_discount": 1})
    with pytest.raises(ValueError, match="x has 1"):
        verify_length(1, 2, "x")


def test_views_and_sinks(spark, data, tmp_path):
    catalog = StarCatalog(spark, f"{data}/sf0.001")
    catalog.register("ssb_")
    df = spark.sql("SELECT D_YEAR, count(*) AS n FROM ssb_lineorder JOIN ssb_date ON LO_ORDERDATE = D_DATEKEY GROUP BY D_YEAR")
    assert console(df).endswith(f"Total Rows: {df.count()}")
    save(df, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == df.count()


def test_stream_equals_batch_on_closed_windows(spark, data, tmp_path):
    run_available(read_stream(spark, f"{data}/sf0.001"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = {tuple(r) for r in windowed(spark.read.parquet(f"{data}/sf0.001/events.parquet")).collect()}
    assert got and got <= batch
