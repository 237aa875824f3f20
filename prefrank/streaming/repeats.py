"""Requests that are not answered by an earlier one of their key within its time to live.

A micro-batch is sorted by key and time, spilling where it has to, and folded in that order: a task
holds one batch of rows and the last kept time of one key, however many rows the key has. The last
kept times are a small table, written anew with every micro-batch and forgotten after their expiry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from prefrank import fixed_values as fixed
from prefrank.sources.tables import remove

_LAST = "_last_micros"


def _fold(ttl: int):
    """Rows sorted by key and time to the chosen ones: each at least ``ttl`` microseconds after the one before.

    A key with a last kept time begins with a row that holds nothing else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.array(batch.column("_key").to_pylist(), object)
            times = batch.column("_micros").fill_null(0).to_numpy()
            known = batch.column(_LAST)
            change = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            chosen = []
            for begin, end in zip(change[:-1], change[1:]):
                if keys[begin] != current:
                    current, last = keys[begin], known[begin].as_py()
                    begin += last is not None
                at = begin if last is None else begin + int(np.searchsorted(times[begin:end], last + ttl))
                while at < end:
                    chosen.append(at)
                    last = int(times[at])
                    at = begin + int(np.searchsorted(times[begin:end], last + ttl))
            if chosen:
                yield batch.take(pa.array(chosen))

    return run


def choose(rows: DataFrame, last: DataFrame, key: str, timestamp: str, ttl: int = fixed.CACHE_TTL_SECONDS) -> DataFrame:
    """Rows of one micro-batch that are kept, given the last kept time of each key (``_key``, ``_last_micros``).

    Of rows with equal key and time one is kept. Rows without a key or a time answer nothing and are all kept.
    """
    columns = rows.columns
    placed = rows.withColumns({"_key": F.col(key).cast("string"), "_micros": F.unix_micros(F.col(timestamp).cast("timestamp")),
                               _LAST: F.lit(None).cast("long")})
    loose = F.col("_key").isNull() | F.col("_micros").isNull()
    # Equal requests collapse before the rows of a key meet; its last kept time sorts before them.
    once = placed.where(~loose).dropDuplicates(["_key", "_micros"])
    sorted_ = once.unionByName(last, allowMissingColumns=True).repartition("_key").sortWithinPartitions(
        "_key", F.col("_micros").asc_nulls_first())
    kept = sorted_.mapInArrow(_fold(ttl * 1_000_000), sorted_.schema)
    return kept.select(*columns).union(placed.where(loose).select(*columns))


def start_suppressing(df: DataFrame, key: str, timestamp: str, path: str, checkpoint: str,
                      ttl: int = fixed.CACHE_TTL_SECONDS) -> StreamingQuery:
    """Store the kept rows of a stream below ``path/rows`` and the last kept times below ``path/last``.

    The rows do not depend on the cut into micro-batches as long as no row comes later than the last kept one of its key.
    A replayed micro-batch overwrites its folders. Times whose expiry lies a time to live behind the newest one are forgotten.
    """
    spark = df.sparkSession
    state = f"_key string, {_LAST} bigint"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/input")
        rows = spark.read.schema(df.schema).parquet(f"{path}/input")
        last = spark.read.schema(state).parquet(f"{path}/last/{number - 1}") if number else spark.createDataFrame([], state)
        choose(rows, last, key, timestamp, ttl).write.mode("overwrite").parquet(f"{path}/rows/batch_id={number}")
        kept = spark.read.schema(df.schema).parquet(f"{path}/rows/batch_id={number}").where(
            F.col(key).isNotNull() & F.col(timestamp).isNotNull()).select(
            F.col(key).cast("string").alias("_key"), F.unix_micros(F.col(timestamp).cast("timestamp")).alias(_LAST))
        merged = last.union(kept).groupBy("_key").agg(F.max(_LAST).alias(_LAST))
        newest = merged.agg(F.max(_LAST)).first()[0]
        if newest is not None:
            merged = merged.where(F.col(_LAST) >= newest - 2 * ttl * 1_000_000)
        merged.write.mode("overwrite").parquet(f"{path}/last/{number}")
        remove(spark, f"{path}/last/{number - 2}")

    return (df.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(write).start())


def read_kept(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Kept rows of :func:`start_suppressing`."""
    return spark.read.schema(schema).parquet(f"{path}/rows").select(*schema.fieldNames())
