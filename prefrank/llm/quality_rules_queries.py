"""Query of the line-first quality rules over ``documents``."""

from pyspark.sql import DataFrame, SparkSession

from prefrank.llm.quality_rules import apply_rules


def op10_line_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return apply_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
