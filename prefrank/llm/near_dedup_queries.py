"""Query of the near-duplicate operator over ``documents``."""

from pyspark.sql import DataFrame, SparkSession

from prefrank.llm.near_dedup import near_duplicates


def op4_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "class_size", "is_first")
