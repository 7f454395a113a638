"""The corpus pipeline: stages that each read what the one before wrote.

quality rules -> line dedup -> n-gram Jaccard join -> mixing sources -> best-fit packing. Every
stage but the last returns the columns of ``documents``; the last returns the packed pieces.

Cases, for every stage: an empty table gives an empty result; columns besides those of ``documents``
are dropped, whatever their names; null languages pass through. Null and empty texts and texts
without words end at the quality rules (too short) and, where a stage is run by itself, pass line
dedup and the n-gram join as they are, are left out by mixing, and are packed as the separator alone.
Null ids are ids like any other: first in the order of lines, last among the rows of a group. Rows
that share an id are judged each by their own text; mixing takes rows that share an id and a source
together. Repeated rows each keep the same lines; the n-gram join leaves one of
them if they have words. The null
source is a source of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import apportionment, line_dedup, ngram_join, packing, quality_rules
from lodestar.llm.common import saved
from lodestar.llm.registry import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list keep.

    The list is learned from the labelled documents of the stage's own input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.judge(docs, quality_rules.fit(docs, labels)).filter("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier line; those that lose all their words go."""
    return line_dedup.dedup(docs.select(*COLUMNS))


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one of least id."""
    return ngram_join.keep_one(docs.select(*COLUMNS))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, to the nearest whole time: none, once or twice."""
    return apportionment.repeat(docs.select(*COLUMNS))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path()).drop("ids")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", join_stage),
    ("mixing sources to target weights", mix_stage),
    ("best-fit packing", pack_stage),
]

#: Learned rules and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. Each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = saved(docs, name.replace(" ", "-"))
    return docs
