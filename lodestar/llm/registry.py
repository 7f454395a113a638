"""The thin queries opN_<name> over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import apportionment, compression_quality, host_reputation, language_id, line_dedup, matroska, ngram_join, packing, quality_rules, sql, tool_calls
from lodestar.llm.host_reputation import UrlRule


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = [UrlRule("block", "net/"), UrlRule("allow", "example.net/en/"), UrlRule("block", "example.com/de/"), UrlRule("allow", "org/fr/")]


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label of the document whose number its url carries."""
    pages = host_reputation.parsed(table(spark, sf_dir, "pages").select("page_id", "url"))
    number = F.expr("try_cast(nullif(regexp_extract(path, '/([0-9]+)', 1), '') AS bigint)")
    labels = table(spark, sf_dir, "labels").filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    outcomes = pages.select("host", number.alias("number")).join(labels, F.col("number") == F.col("doc_id")).select("host", "good")
    return host_reputation.judge(pages.select("page_id", "url"), outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "n_outcomes")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digest(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document its lines with words and the numbers of those that go."""
    docs = table(spark, sf_dir, "documents")
    found = line_dedup.removals(docs).select(F.col("doc_id").alias("__d"), F.col("key").alias("__k"), "n_lines", "removed")
    out = line_dedup.keyed(docs.select("doc_id", "text")).join(found, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__k")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select("doc_id", F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), F.array_join(removed, ",").alias("removed"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs.select("doc_id", "text"), rules).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "rule")


TOOLS = {"reply": tool_calls.Tool({"text": tool_calls.Parameter("string", True, least=50, most=400), "turn": tool_calls.Parameter("integer", True, least=0)})}


def op6_link_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table holds no tool calls of its own: each user turn calls ``reply``, which the next
    assistant turn answers."""
    linked = tool_calls.link(tool_calls.turns_as_calls(table(spark, sf_dir, "conversations")), TOOLS)
    return linked.withColumn("errors", F.array_join("errors", "; "))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


def op8_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return compression_quality.score(docs, compression_quality.fit(docs, table(spark, sf_dir, "labels")))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apportionment.mix(apportionment.sized(table(spark, sf_dir, "documents")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


OPERATORS = (op1_url_reputation, op2_ngram_join, op3_media_columns, op4_line_dedup, op5_quality_rules, op6_link_tool_calls, op7_pack_documents, op8_compression_quality, op9_mix_sources, op10_language_id)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_reputation": sql.OP1, "op2_ngram_join": sql.OP2, "op4_line_dedup": sql.OP4, "op6_link_tool_calls": sql.OP6, "op9_mix_sources": sql.OP9}
