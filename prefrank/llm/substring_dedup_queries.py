"""Query of the substring deduplication over ``documents``."""

from pyspark.sql import DataFrame, SparkSession

from prefrank.llm.substring_dedup import repeated_passages


def op2_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
