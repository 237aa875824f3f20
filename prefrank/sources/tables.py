"""Parquet tables: preference triples, cache, run history, feedback."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from prefrank.operators import dataset
from prefrank.schemas import CACHE_ENTRY, RUN_HISTORY, TRAINING_HISTORY


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; one that does not exist is none to delete."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def read_preferences(spark: SparkSession, path: str, max_rows: int | None = None,
                     order: str | None = None,
                     observation: Observation | None = None) -> DataFrame:
    """Cleaned and label-encoded preference triples.

    Only the columns in use are read. ``max_rows`` limits before null rows are
    dropped, 0 gives an empty table, None reads everything.
    """
    return dataset.clean_preferences(spark.read.parquet(path), max_rows, order, observation)


def read_for_validation(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Raw triples for the quality report; 0 or None reads everything."""
    df = spark.read.parquet(path)
    return df.limit(max_rows) if max_rows else df


def warn_if_dropped(observation: Observation, split: str = "train") -> int:
    """Warn about dropped rows once an action has filled the observation."""
    dropped = int(observation.get["dropped"])
    if dropped:
        warnings.warn(f"[{split}] dropped {dropped} rows with null text fields", stacklevel=2)
    return dropped


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The result cache; partitioned by day so that expiry prunes whole folders."""
    schema = StructType([*CACHE_ENTRY.fields, StructField("day", DateType())])
    return spark.read.schema(schema).parquet(path)


def append_cache(entries: DataFrame, path: str) -> None:
    """Append cache entries; a failed write never fails the scoring that produced them."""
    try:
        (entries.withColumn("day", F.to_date("written_at"))
         .write.mode("append").partitionBy("day").parquet(path))
    except Exception as error:  # noqa: BLE001 - the cache is optional by contract
        warnings.warn(f"cache write skipped: {error}", stacklevel=2)


def append_history(rows: DataFrame, path: str) -> None:
    """Append per-epoch metrics of a run."""
    rows.select(*RUN_HISTORY.fieldNames()).write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_HISTORY).parquet(path)


def read_training_history(spark: SparkSession, path: str) -> DataFrame:
    """Per-epoch losses and metrics of training runs, a folder for each run and epoch."""
    return spark.read.schema(TRAINING_HISTORY).parquet(path).select(*TRAINING_HISTORY.fieldNames())
