"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import fold

_KEY = ("doc_id", "text")


def picked_rows(docs: DataFrame, label: Column, most_rows: int, labels: DataFrame | None = None, each: bool = False, learnable: Column | None = None) -> DataFrame:
    """(__key, __label) of the labelled rows of least hash, at most most_rows of them.

    A row is known by the hash of its id, text and label, so rows that share an id are sampled each
    with a label of their own, and repeated rows count once. Null ids, texts and labels are left out
    before anything is chosen. labels: the table that has the label, by doc_id; the least of several.

    each: the hash counts as a place among the rows of its label, so labels have equal shares as far
    as they have rows, rare ones whole."""
    usable = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    usable = usable if learnable is None else usable & learnable
    if labels is None:
        keys = docs.filter(usable & label.isNotNull()).select(F.xxhash64(*_KEY, label).alias("__key"), label.alias("__label"))
    else:
        named = labels.filter(F.col("doc_id").isNotNull() & label.isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.min(label).alias("__label"))
        keys = docs.filter(usable).select("doc_id", F.xxhash64(*_KEY).alias("__text")).join(named, F.col("doc_id") == F.col("__id"))
        keys = keys.select(F.col("__text").alias("__key"), "__label")
    keys = keys.distinct()
    place = F.xxhash64("__key", F.lit(3))
    if each:
        # One row for each label.
        counts = keys.groupBy(F.col("__label").alias("__l")).agg(F.count("*").alias("__n"))
        keys = keys.join(counts, F.col("__label") == F.col("__l"))
        place = (place / F.lit(2.0**64) + 0.5) * F.col("__n")
    return keys.orderBy(place, "__key", "__label").limit(most_rows).select("__key", "__label")


def with_rows(docs: DataFrame, picked: DataFrame, *columns: Column, label: Column | None = None) -> DataFrame:
    """The rows that were picked, once each: __key, __label and the columns. label: as it was given
    where it is a column of docs. At most as many rows as were picked, which is what is broadcast."""
    key = F.xxhash64(*_KEY) if label is None else F.xxhash64(*_KEY, label)
    return docs.select(key.alias("__key"), *columns).join(F.broadcast(picked), "__key").dropDuplicates(["__key"])


def labelled_texts(docs: DataFrame, label: Column, most_rows: int, most_chars: int, labels: DataFrame | None = None, each: bool = False) -> list[tuple[str, object, int]]:
    """(text, label, dice) of at most most_rows learnable rows, of each text a window of at most
    most_chars characters from anywhere in it; so what reaches the driver is bounded by their product.

    Learnable: text and label are not null and the id is not in the held-out fold. dice is a hash of
    the row for splitting the sample. The rest is as in picked_rows()."""
    picked = picked_rows(docs, label, most_rows, labels, each, fold(F.col("doc_id")) != 2)
    start = (F.pmod(F.xxhash64("doc_id", F.lit(13)), F.greatest(F.lit(1), F.length("text") - most_chars + 1)) + 1).cast("int")
    window = F.substring(F.col("text"), start, F.lit(most_chars)).alias("__text")
    rows = with_rows(docs, picked, window, label=label if labels is None else None)
    rows = rows.select("__text", "__label", (F.abs(F.xxhash64("__key", F.lit(11)) % 1000003)).alias("d"), "__key").collect()
    return [(r[0], r[1], r[2]) for r in sorted(rows, key=lambda r: (r[2], r[3]))]
