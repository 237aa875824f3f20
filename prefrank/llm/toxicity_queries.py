"""Query of the toxicity operator over ``documents``."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefrank.llm.labelled import held_out
from prefrank.llm.toxicity import score_toxicity, train_toxicity


def op1_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted",
                         F.size("sentences").alias("n_sentences"))
