"""Sinks: the console table, and files as an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame


def console(df: DataFrame, width: int = 20) -> str:
    """A header, the rows in columns of the given width and the row count. The result of a cube is
    small; rows are streamed partition by partition, not collected at once."""
    lines, n = ["".join(c.ljust(width) for c in df.columns)], 0
    for row in df.toLocalIterator():
        n += 1
        lines.append("".join(("" if v is None else str(v)).ljust(width) for v in row))
    return "\n".join([*lines, f"Total Rows: {n}"])


def save(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Extension: write the result as parquet, csv, json or orc."""
    df.write.mode("overwrite").format(kind).save(path)
