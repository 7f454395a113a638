"""The star over the driver's tables, built from the columns that a query needs.

Only tables that hold a needed column are joined, so a query on discounts and dates reads neither
parts nor their prices. This relies on every line having its order and its part, as a star's
foreign keys do. Lines and orders are offered apart, so that dates and customers can cut the orders
before the lines meet them. Dimensions are flattened to the highest level asked for and no higher.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestar.functions import calendar, cents, city_name, ingest_date
from lodestar.operators.joins import lookup
from lodestar.plans.hierarchy import Hierarchy
from lodestar.plans.model import PlanError

_DATE = ("D_DATEKEY", "D_YEAR", "D_YEARMONTHNUM", "D_YEARMONTH", "D_WEEKNUMINYEAR")
#: Columns of LINEORDER that orders and parts hold.
FROM_ORDERS = {"LO_CUSTKEY", "LO_ORDERDATE", *_DATE}
FROM_PART = {"LO_SUPPLYCOST"}

#: Schemas by path and time of change: reading one from the files takes a job, every time.
_schemas: dict[tuple, StructType] = {}


class StarCatalog:
    def __init__(self, spark: SparkSession, base: str, hierarchy: Hierarchy | None = None):
        self.spark, self.base, self.hierarchy = spark, base.rstrip("/"), hierarchy or Hierarchy.load()

    def table(self, name: str) -> DataFrame:
        path = f"{self.base}/{name}.parquet"
        version = (path, self._changed(path))
        if None in version or version not in _schemas:
            _schemas[version] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_schemas[version]).parquet(path)

    def _changed(self, path: str) -> int | None:
        """When the files at a path were last changed; null where that cannot be told."""
        try:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(at).getModificationTime()
        except AttributeError:  # a session without a JVM at hand
            return None

    def lines(self, columns: set[str], order_key: bool = False) -> DataFrame:
        """The columns of LINEORDER that lines hold; with __order, the key of the line's order."""
        off, price = F.round(F.col("l_discount") * 100).cast("int"), cents(F.col("l_extendedprice"))
        made = {
            "__order": F.col("l_orderkey"),
            "LO_ORDERKEY": F.col("l_orderkey"),
            "LO_LINENUMBER": F.col("l_linenumber"),
            "LO_PARTKEY": F.col("l_partkey"),
            "LO_SUPPKEY": F.col("l_suppkey"),
            "LO_QUANTITY": F.round("l_quantity").cast("int"),
            "LO_DISCOUNT": off,
            "LO_EXTENDEDPRICE": price,
            "LO_REVENUE": F.floor(price * (100 - off) / 100).cast("long"),
        }
        return self.table("lineitem").select(*[c.alias(name) for name, c in made.items() if name in columns or (name == "__order" and order_key)])

    def orders(self, columns: set[str], between: list[tuple[date, date]] = ()) -> DataFrame:
        """(__key, ...): the columns of LINEORDER and the calendar that orders hold. between: spans
        [first, end) that the order date lies in, as comparisons that reach the scan."""
        df = self.table("orders")
        kind = dict(df.dtypes)["o_orderdate"]
        for first, end in between:
            df = df.filter((F.col("o_orderdate") >= F.lit(first.isoformat()).cast(kind)) & (F.col("o_orderdate") < F.lit(end.isoformat()).cast(kind)))
        day = F.col("o_orderdate")
        made = {"LO_CUSTKEY": F.col("o_custkey"), "LO_ORDERDATE": ingest_date(day)} | calendar(day)
        return df.select(F.col("o_orderkey").alias("__key"), *[c.alias(name) for name, c in made.items() if name in columns])

    def fact(self, columns: set[str] | None = None) -> DataFrame:
        """LINEORDER with the columns asked for (all of them by default)."""
        every = [c for c, a in self.hierarchy.attributes.items() if a.dimension == self.hierarchy.fact["table"]]
        columns = set(every) if columns is None else {self.hierarchy.resolve(c).name for c in columns}
        df = self.lines(columns | ({"LO_PARTKEY"} if columns & FROM_PART else set()), bool(columns & FROM_ORDERS))
        if columns & FROM_ORDERS:
            orders = self.orders(columns)
            df = lookup(df, orders, df["__order"] == orders["__key"])
        if columns & FROM_PART:
            part = self.dimension("PART", FROM_PART)
            df = lookup(df, part, df["LO_PARTKEY"] == part["P_PARTKEY"])
        return df.select(*[c for c in [*every, *_DATE] if c in columns])

    def small(self, name: str) -> bool:
        """Whether a dimension's base table, grown by four for the names that flattening adds, is
        within the session's limit for broadcasts. By the size of its files; unknown counts as no."""
        try:
            scan = self.table(name.lower())._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
            return 4 * int(str(scan)) <= self.spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        except AttributeError:  # a session without a JVM at hand
            return False

    def dimension(self, name: str, attributes: set[str] | None = None) -> DataFrame:
        """A dimension with its key and the attributes asked for (all of them by default). PART can
        give LO_SUPPLYCOST too, so that a query on both reads the table once."""
        h = self.hierarchy
        attributes = {a for a, x in h.attributes.items() if x.dimension == name} if attributes is None else attributes
        height = max([h.depth(a) for a in attributes], default=0)
        if name in ("CUSTOMER", "SUPPLIER"):
            p, base = name[0], self.table(name.lower())
            key, nation_key = F.col(f"{p.lower()}_{'cust' if p == 'C' else 'supp'}key"), f"{p.lower()}_nationkey"
            made = {f"{p}_{'CUST' if p == 'C' else 'SUPP'}KEY": key}
            if height >= 1:
                nation = self.table("nation")
                base = lookup(base, nation, base[nation_key] == nation["n_nationkey"], fixed=True)
                made |= {f"{p}_CITY": city_name(F.col("n_name"), key), f"{p}_NATION": F.col("n_name")}
            if height >= 3:
                region = self.table("region")
                base = lookup(base, region, base["n_regionkey"] == region["r_regionkey"], fixed=True)
                made[f"{p}_REGION"] = F.col("r_name")
        elif name == "PART":
            base = self.table("part")
            n = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
            mfgr = F.concat(F.lit("MFGR#"), (F.floor((n - 1) / 5) + 1).cast("string"))
            category = F.concat(mfgr, ((n - 1) % 5 + 1).cast("string"))
            brand = F.concat(category, ((F.col("p_size") - 1) % 40 + 1).cast("string"))
            cost = F.floor(6 * cents(F.col("p_retailprice")) / 10).cast("long")
            made = {"P_PARTKEY": F.col("p_partkey"), "P_MFGR": mfgr, "P_CATEGORY": category, "P_BRAND1": brand, "LO_SUPPLYCOST": cost}
        elif name == "DATE":
            base = self.table("orders").select("o_orderdate").distinct()
            made = calendar(F.col("o_orderdate"))
        else:
            raise PlanError(f"unknown dimension {name!r}")
        key, *_ = made
        return base.select(*[c.alias(a) for a, c in made.items() if a == key or a in attributes])

    def register(self, prefix: str = "") -> dict[str, DataFrame]:
        """Temporary views of the fact and the dimensions, for SQL."""
        frames = {"lineorder": self.fact()} | {d.lower(): self.dimension(d) for d in self.hierarchy.paths}
        for name, df in frames.items():
            df.createOrReplaceTempView(prefix + name)
        return frames
