"""Connected components of an edge table by contraction, in DataFrame operations.

Each round every node takes the least of itself and its neighbours as parent, parents are looked up
twice more, and both ends of every edge are replaced by their parents; edges within a node go. The
rounds needed grow with the logarithm of the longest path. A node with very many edges is one row
in every aggregate, and in the joins the long side can be split, as both sides are read from files.

Cases: self loops and repeated edges are harmless; rows with a null end are dropped; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import saved


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b) -> (node, label) for every node with an edge to another; label is the least node."""
    ends = (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    left = saved(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(*ends).distinct(), "edges")
    out = None
    while not left.isEmpty():
        both = left.select(F.col("a").alias("u"), F.col("b").alias("v")).union(left.select("b", "a"))
        parent = saved(both.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("p")), "parents")
        for _ in range(2):
            up = parent.select(F.col("u").alias("w"), F.col("p").alias("pp"))
            parent = saved(parent.join(up, F.col("p") == F.col("w")).select("u", F.col("pp").alias("p")), "parents")
        if out is None:
            out = parent.select(F.col("u").alias("node"), F.col("p").alias("label"))
        else:  # roots that hang below others now
            out = saved(out.join(parent, F.col("label") == F.col("u"), "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
        pa, pb = (parent.select(F.col("u").alias(f"u{k}"), F.col("p").alias(f"p{k}")) for k in "ab")
        moved = left.join(pa, F.col("a") == F.col("ua")).select("pa", "b").join(pb, F.col("b") == F.col("ub")).select("pa", "pb").filter("pa != pb")
        left = saved(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    return left.select(F.col("a").alias("node"), F.col("b").alias("label")) if out is None else out
