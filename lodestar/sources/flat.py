"""The on-disk star: header-less pipe text for dimensions, one raw file per fact column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions import brand_number

# Columns of each text file in the order in which they are stored.
TEXT_FILES = {
    "nation_olap": "n_nationkey int, n_name string, n_regionkey int",
    "region_olap": "r_regionkey int, r_name string",
    "city_S": "si_name string, id_city_s int, si_nationkey int",
    "city_C": "ci_name string, id_city_c int, ci_nationkey int",
    "brand1": "b_name string, id_brand1 int, b_category int",
    "category": "ca_name string, id_category int, ca_mfgrkey int",
    "mfgr": "mfgr_name string, id_mfgr int",
    "yearmonth": "ym_name string, ym_num int, id_ym int, ym_yearkey int",
    "year": "y_name int, y_key int",
    "discount": "dim_discount_val int, id_discount int",
    "quantity": "dim_quantity_val int, id_quantity int",
    "date_olap": "d_datekey int, d_yearmonth int, d_year int, d_weeknuminyear int",
    "customer_olap": "c_custkey int, c_city int",
    "supplier_olap": "s_suppkey int, s_city int",
    "part_olap": "p_partkey int, p_brand1 int",
}
# Keys that are stored from 0 and used from 1.
FROM_ZERO = {
    "nation_olap": ("n_nationkey", "n_regionkey"),
    "region_olap": ("r_regionkey",),
    "city_S": ("si_nationkey",),
    "city_C": ("ci_nationkey",),
}
# Fact columns and their width in bytes (little-endian signed integers).
BINARY_COLUMNS = {
    "lo_custkey": 4, "date_FK": 4, "lo_extendedprice": 4, "lo_partkey": 4, "lo_revenue": 4, "lo_suppkey": 4,
    "lo_supplycost": 4, "lo_discount": 1, "discount_FK": 1, "quantity_FK": 1,
}


def read_text(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One dimension file, typed, with keys counted from 1 and brand numbers derived.

    Malformed numbers raise, as a key that silently becomes null would drop rows from joins."""
    df = spark.read.schema(TEXT_FILES[name]).option("sep", "|").option("mode", "FAILFAST").csv(f"{base}/{name}.csv")
    df = df.withColumns({c: F.col(c) + 1 for c in FROM_ZERO.get(name, ())})
    return df.withColumn("b1_val", brand_number(F.col("b_name"))) if name == "brand1" else df


def verify_length(actual: int, expected: int, name: str) -> None:
    if actual != expected:
        raise ValueError(f"{name} has {actual} values; the other columns have {expected}")


def read_binary_column(spark: SparkSession, path: str, column: str, width: int) -> DataFrame:
    """A raw array as (row, column), row counted from 0.

    Spark's fixed-length record reader splits the file at record boundaries, so a column of any
    size is read by many tasks; positions come from a count per split (one number per task)."""
    kind = {1: "b", 2: "h", 4: "i", 8: "q"}[width]

    def decode(part: int, rows):
        import struct

        for k, raw in enumerate(rows):
            yield part, k, struct.unpack(f"<{kind}", bytes(raw))[0]

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField(column, T.LongType())])
    df = spark.createDataFrame(spark.sparkContext.binaryRecords(path, width).mapPartitionsWithIndex(decode), schema)
    starts, total = [], 0
    for r in df.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        starts.append((r["part"], total))
        total += r["n"]
    offsets = spark.createDataFrame(starts, "part int, base long")
    return df.join(F.broadcast(offsets), "part").select((F.col("base") + F.col("place")).alias("row"), F.col(column))


def read_fact(spark: SparkSession, base: str, columns: dict[str, int] | None = None) -> DataFrame:
    """The raw columns side by side, joined on their position; unequal lengths are an error."""
    out, length = None, None
    for name, width in (columns or BINARY_COLUMNS).items():
        df = read_binary_column(spark, f"{base}/lineorder.{name}", name, width)
        n = df.count()
        length = n if length is None else length
        verify_length(n, length, name)
        out = df if out is None else out.join(df, "row")
    return out
