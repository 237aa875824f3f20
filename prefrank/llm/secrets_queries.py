"""Query of the secret scan over ``documents``."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefrank.llm.secrets import scan_secrets


def op9_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs).select("doc_id", "secrets")
    kinds = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    written = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", kinds("assign").alias("n_assign"), kinds("access").alias("n_access"), kinds("hex").alias("n_hex"),
        F.sha2(written(F.filter("secrets", lambda s: s["kind"] != "entropy")), 256).alias("base_sha256"),
        written(F.col("secrets")).alias("spans"))
