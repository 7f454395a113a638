"""Column derivations shared by the sources: all JVM-side built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def brand_number(brand: Column) -> Column:
    """Numeric suffix of a brand name: ``MFGR#2221`` -> 2221; null without digits at the end."""
    digits = F.regexp_extract(brand, r"(\d+)$", 1)
    return F.when(digits != "", digits.cast("int"))


def cents(amount: Column) -> Column:
    """Money held as a double, as whole cents (rounded, so 2.999999 is 300)."""
    return F.round(amount * 100).cast("long")


def city_name(nation: Column, key: Column) -> Column:
    """Nine characters of the nation, padded, and one digit: ten cities a nation."""
    return F.concat(F.rpad(F.substring(nation, 1, 9), 9, " "), (key % 10).cast("string"))


def ingest_date(day: Column) -> Column:
    """A timestamp or date as the integer yyyymmdd."""
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def calendar(day: Column) -> dict[str, Column]:
    """Calendar levels of a day. Weeks start on 1 January and hold seven days."""
    return {
        "D_DATEKEY": ingest_date(day),
        "D_YEAR": F.year(day),
        "D_YEARMONTHNUM": (F.year(day) * 100 + F.month(day)).cast("int"),
        "D_YEARMONTH": F.date_format(day, "MMMyyyy"),
        "D_WEEKNUMINYEAR": (F.floor((F.dayofyear(day) - 1) / 7) + 1).cast("int"),
    }
