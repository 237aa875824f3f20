"""Query of the decontamination operator: ``documents`` against ``benchmark``."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefrank.llm.decontamination import find_contamination


def op7_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_contamination(docs, items).select("doc_id", F.inline("leaks"))
