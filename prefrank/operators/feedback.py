"""Realised accuracy: predictions matched with the feedback that follows them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from prefrank.session import scratch_path

_RESOLVED, _OPEN, _TAIL = 0, 1, 2


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of the sorted rows: feedback with the last prediction of its key in the range.

    Feedback that its range alone cannot resolve is open: it has the range's first key, and no prediction came before
    it. The last row tells the range's last key and that key's last prediction. What is held is one batch and one prediction.
    """
    first = key = carried = None
    seen, last = False, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = np.array(batch.column("_key").to_pylist(), object)
        asked = batch.column("_ask").to_numpy().astype(bool)
        if first is None:
            first = keys[0]
        if key is None or keys[0] != key:
            carried, seen = None, False
        run = np.zeros(n, np.int64)
        starts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        run[starts] = starts
        run = np.maximum.accumulate(run)
        made = np.maximum.accumulate(np.where(asked, -1, np.arange(n)))
        made = np.where(made >= run, made, -1)
        # Past the batch's rows stands the prediction that an earlier batch left to the first run.
        if carried is not None:
            made = np.where((made < 0) & (run == 0), n, made)
        times, payloads = batch.column("_ts"), batch.column("_payload")
        if carried is not None:
            times, payloads = pa.concat_arrays([times, carried[0]]), pa.concat_arrays([payloads, carried[1]])
        rows = np.flatnonzero(asked)
        if len(rows):
            index = pa.array(made[rows], pa.int64(), mask=made[rows] < 0)
            open_ = (made[rows] < 0) & (keys[rows] == first)
            yield _result(batch, rows, np.where(open_, _OPEN, _RESOLVED), times.take(index), payloads.take(index))
        key, seen = keys[-1], made[-1] >= 0
        carried = (times.slice(made[-1], 1).take(pa.array([0])), payloads.slice(made[-1], 1).take(pa.array([0]))) if seen else None
        last = batch.slice(n - 1, 1)
    if last is not None:
        none = pa.array([None], pa.int64())
        found = carried or (last.column("_ts").take(none), last.column("_payload").take(none))
        yield _result(last, np.array([0]), np.array([_TAIL]), *found)


def _result(batch: pa.RecordBatch, rows: np.ndarray, kind: np.ndarray, times: pa.Array, payloads: pa.Array) -> pa.RecordBatch:
    index = pa.array(rows)
    return pa.record_batch(
        [batch.column("_part").take(index), pa.array(kind, pa.int32()), batch.column("_key").take(index), times, payloads,
         batch.column("_row").take(index)], names=["_part", "_kind", "_key", "_made_at", "_found", "_row"])


def latest_before(predictions: DataFrame, feedback: DataFrame, key: str, timestamp: str,
                  payload: str, tie_breaker: str, partitions: int | None = None) -> DataFrame:
    """Give every feedback row the last prediction of its key at or before its time.

    Both inputs share ``key`` and ``timestamp``; ``payload`` comes from the prediction and
    is null without an earlier one; each feedback row yields exactly one row. Of predictions at one time that with the
    largest ``tie_breaker`` counts. Feedback without a key or a time has no prediction and is not shuffled.

    Both inputs are dealt once, by ranges of key and time, so a key with very many rows takes many ranges, even where all
    of them have one time. A range is merged in order; what it leaves open takes the last prediction of the
    ranges before it, from a table with one row for each range. The merged rows are stored in the shared folder.
    """
    spark = predictions.sparkSession
    known = F.col(key).isNotNull() & F.col(timestamp).isNotNull()
    row = F.struct(*[F.col(c) for c in feedback.columns])
    asked = feedback.where(known).select(
        F.col(key).alias("_key"), F.col(timestamp).alias("_ts"), F.lit(1).alias("_ask"), row.alias("_row"),
        F.xxhash64(F.to_json(row)).alias("_spread"))
    offered = predictions.where(known).select(
        F.col(key).alias("_key"), F.col(timestamp).alias("_ts"), F.lit(0).alias("_ask"), F.col(tie_breaker).alias("_tie"),
        F.col(payload).alias("_payload"), F.lit(0).cast("long").alias("_spread"))
    rows = offered.unionByName(asked, allowMissingColumns=True)
    ranges = ["_key", "_ts", "_ask", "_tie", "_spread"]
    dealt = rows.repartitionByRange(*([partitions] if partitions else []), *ranges).sortWithinPartitions(
        *ranges[:-1], "_payload").withColumn("_part", F.spark_partition_id().cast("long"))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = StructType([
        StructField("_part", LongType()), StructField("_kind", IntegerType()), StructField("_key", kinds["_key"]),
        StructField("_made_at", kinds["_ts"]), StructField("_found", kinds["_payload"]), StructField("_row", kinds["_row"])])
    place = scratch_path(spark, "matches")
    dealt.mapInArrow(_merge, schema).write.parquet(place)
    stored = spark.read.schema(schema).parquet(place)
    # One row for each range: the last prediction of its last key, of this range or of those before it.
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    tails = stored.where(F.col("_kind") == _TAIL).select("_part", "_key", F.last(
        F.when(F.col("_made_at").isNotNull(), F.struct("_made_at", "_found")), ignorenulls=True).over(before).alias("_left"))
    # An open row has its range's first key: the range before it that ends with this key has its prediction.
    ended = Window.partitionBy("_key").orderBy("_part")
    spans = tails.withColumn("_until", F.lead("_part").over(ended)).select(
        F.col("_key").alias("_tail_key"), "_left", F.col("_part").alias("_from"), "_until")
    answers = stored.where(F.col("_kind") != _TAIL)
    settled = answers.where(F.col("_kind") == _RESOLVED).select("_row", "_made_at", "_found")
    left_open = answers.where(F.col("_kind") == _OPEN)
    joined = left_open.join(
        F.broadcast(spans), (F.col("_key") == F.col("_tail_key")) & (F.col("_part") > F.col("_from"))
        & (F.col("_until").isNull() | (F.col("_part") <= F.col("_until"))), "left").select(
        "_row", F.col("_left._made_at").alias("_made_at"), F.col("_left._found").alias("_found"))
    matched = settled.union(joined).select("_row.*", "_made_at", "_found")
    unknown = feedback.where(~known).select(
        "*", F.lit(None).cast(kinds["_ts"]).alias("_made_at"), F.lit(None).cast(kinds["_payload"]).alias("_found"))
    return matched.union(unknown).withColumns({payload: F.col("_found"), "predicted_at": F.col("_made_at")}).drop("_found", "_made_at")


def realised_accuracy(matched: DataFrame, predicted: str, actual: str, by=()) -> DataFrame:
    """Feedback rows, rows with a prediction, share of predictions that came true."""
    return matched.groupBy(*by).agg(
        F.count("*").alias("feedback"),
        F.count(predicted).alias("matched"),
        F.avg((F.col(predicted) == F.col(actual)).cast("double")).alias("accuracy"))
