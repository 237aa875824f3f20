"""Open results of streaming aggregates as a versioned table.

An update-mode stream writes the rows that a micro-batch changed, below the number of that
micro-batch; a replayed micro-batch overwrites its folder. Readers take the newest row of each
key. The state of closed windows is dropped by the watermark, and what is written grows with the
changed rows, not with all windows ever seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from prefrank.sources.tables import path_exists, remove

_FOLDED = "folded"


def start_updating(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write the changed rows of every micro-batch of an aggregate below ``path``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _batches(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, path) of the version folders, which are few after :func:`fold_versions`."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in store.listStatus(place)] if store.exists(place) else []
    return sorted((int(n.partition("=")[2]), f"{path}/{n}") for n in names if n.startswith("batch_id="))


def _folds(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Finished folds: one covers all batches up to its number."""
    place = f"{path}-{_FOLDED}"
    return [(n, p) for n, p in _batches(spark, place) if path_exists(spark, f"{p}/_SUCCESS")]


def latest_rows(spark: SparkSession, path: str, schema: StructType | str, *keys: str) -> DataFrame:
    """Newest row of each key of :func:`start_updating`; an empty table before the first micro-batch."""
    folds = _folds(spark, path)
    done, base = folds[-1] if folds else (-1, None)
    parts = [(n, p) for n, p in _batches(spark, path) if n > done] + ([(done, base)] if base else [])
    if not parts:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[p for _, p in parts]).withColumn(
        "_version", F.regexp_extract(F.col("_metadata.file_path"), r"batch_id=(\d+)/[^/]*$", 1).cast("long"))
    others = [c for c in rows.columns if c not in (*keys, "_version")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "_version").alias("_row"))
    return newest.select(*keys, "_row.*").select(*[c for c in rows.columns if c != "_version"])


def fold_versions(spark: SparkSession, path: str, schema: StructType | str, *keys: str) -> int:
    """Fold the versions written so far into one row per key; returns the number of the last folded batch.

    Readers take a fold once it is complete and the batches after it, so they may go on meanwhile. Batch
    folders below an older fold are deleted: a reader that listed them before has one fold's time to finish.
    """
    batches, folds = _batches(spark, path), _folds(spark, path)
    last = batches[-1][0] if batches else -1
    if batches and (not folds or folds[-1][0] < last):
        latest_rows(spark, path, schema, *keys).write.mode("overwrite").parquet(f"{path}-{_FOLDED}/batch_id={last}")
        older = folds[-1][0] if folds else -1
        for number, place in [*[b for b in batches if b[0] <= older], *folds[:-1]]:
            remove(spark, place)
    return last
