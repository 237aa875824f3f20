"""Query of the packing operator over ``documents``."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from prefrank.llm.packing import CAPACITY, pack
from prefrank.llm.tokens import token_pieces

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def packed(docs: DataFrame) -> DataFrame:
    pieces = token_pieces(docs.select("doc_id", "text"), TOKENIZER, capacity=CAPACITY, keep_ids=False)
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
