"""Query of the quality classifier over ``documents``."""

from pyspark.sql import DataFrame, SparkSession

from prefrank.llm.labelled import held_out
from prefrank.llm.quality_model import score_quality, train_quality


def op6_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
