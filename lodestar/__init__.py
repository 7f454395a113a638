"""Lodestar: star-schema OLAP on PySpark.

A JSON query document is parsed into a plan, bound to a declared dimension
hierarchy and compiled into one lazy DataFrame; Catalyst does the rest.
"""

from lodestar.plans.compiler import compile_plan
from lodestar.plans.parser import parse_query
from lodestar.sources.catalog import StarCatalog

__all__ = ["StarCatalog", "compile_plan", "parse_query"]
