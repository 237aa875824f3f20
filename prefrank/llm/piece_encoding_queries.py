"""Query of sentence-piece encoding and decoding over ``documents``."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefrank.llm.piece_encoding import encode_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op11_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # Ids go back through the model where they are made: they need not travel twice.
    coded = encode_pieces(docs, MODEL, decoded="decoded")
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
