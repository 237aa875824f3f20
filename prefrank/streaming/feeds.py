"""Structured Streaming forms of the operators.

Every function maps a streaming DataFrame to a streaming DataFrame (and works on a
batch one); ``start`` attaches a Parquet sink with its checkpoint below a shared
folder. State is bounded by watermarks, but for the aggregates of `start_replacing`:
complete mode keeps every window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from prefrank import fixed_values as fixed
from prefrank.functions.privacy import MAIN, Dialect, has_pii, redact, redacted_types
from prefrank.operators import contracts
from prefrank.plans.scoring import score_and_store
from prefrank.schemas import FEEDBACK
from prefrank.sources.reports import parse_feedback


def read_table(spark: SparkSession, path: str, schema: StructType | str,
               max_files: int | None = None) -> DataFrame:
    """Parquet folder as a stream; ``max_files`` bounds one micro-batch."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def read_json_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Text files with one JSON event per line, in a ``value`` column."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path)


def start(df: DataFrame, path: str, checkpoint: str, available_now: bool = True,
          partition_by=()) -> StreamingQuery:
    """Append a stream to Parquet; with ``available_now`` it ends after the present input."""
    writer = df.writeStream.format("parquet").outputMode("append").partitionBy(*partition_by)
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_replacing(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Complete-mode aggregates: every micro-batch writes its own folder below ``path``.

    A replayed micro-batch overwrites its folder, so restarts stay exact; readers take
    the highest batch.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (df.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(write).start())


def latest_batch(spark: SparkSession, path: str) -> DataFrame:
    """Newest result of :func:`start_replacing`."""
    df = spark.read.parquet(path)
    return df.where(F.col("batch_id") == df.agg(F.max("batch_id")).scalar()).drop("batch_id")


def feedback_events(raw: DataFrame) -> DataFrame:
    """Parsed and checked feedback with an ``errors`` column; empty means acceptable."""
    return contracts.check_feedback(contracts.with_feedback_defaults(parse_feedback(raw)))


def ingest_feedback(raw: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append feedback in one pass, acceptable and broken events in folders of their own.

    See :func:`read_feedback`.
    """
    checked = feedback_events(raw).withColumn("accepted", F.size("errors") == 0)
    return start(checked, path, checkpoint, partition_by=["accepted"])


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Stored feedback with its ``errors`` and the partition column ``accepted``."""
    schema = StructType([*FEEDBACK.fields, StructField("errors", ArrayType(StringType())),
                         StructField("accepted", BooleanType())])
    return spark.read.schema(schema).parquet(path)


def redact_messages(df: DataFrame, text: str, dialect: Dialect = MAIN) -> DataFrame:
    """Redact before storage; keeps which types were seen and whether anything is left."""
    return (df.withColumn("pii_types", redacted_types(text, dialect))
            .withColumn(text, redact(text, dialect))
            .withColumn("leak", has_pii(text, dialect)))


def suppress_repeats(df: DataFrame, key: str, timestamp: str,
                     ttl: int = fixed.CACHE_TTL_SECONDS) -> DataFrame:
    """Requests of a key that are not answered by an earlier one within its time to live.

    A request is kept, and answers others, if it comes ``ttl`` seconds or more after the last
    kept one of its key; of equal times one is kept. State is the last kept time of a key,
    forgotten when the watermark passes its expiry: what comes later would be kept anyway.
    So the rows kept do not depend on how the input was cut into micro-batches, as long as
    rows are at most ``ttl`` seconds late. One key's rows of one micro-batch are held in
    memory together; bound micro-batches with ``max_files``.
    """
    micros = ttl * 1_000_000

    def keep(_, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames), ignore_index=True)
        times = rows[timestamp].astype("datetime64[us]").astype("int64").to_numpy()
        order = np.argsort(times, kind="stable")
        ordered, chosen = times[order], []
        at = int(np.searchsorted(ordered, state.get[0] + micros)) if state.exists else 0
        while at < len(ordered):
            chosen.append(order[at])
            at = int(np.searchsorted(ordered, ordered[at] + micros))
        if chosen:
            state.update((int(times[chosen[-1]]),))
        if state.exists:
            state.setTimeoutTimestamp(max(state.get[0] // 1000 + ttl * 1000, state.getCurrentWatermarkMs() + 1))
        yield rows.iloc[chosen]

    timed = df.where(F.col(timestamp).isNotNull()).withWatermark(timestamp, f"{ttl} seconds")
    return timed.groupBy(key).applyInPandasWithState(
        keep, df.schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def match_feedback(predictions: DataFrame, feedback: DataFrame, key: str, made_at: str,
                   given_at: str, within: str = "24 hours", how: str = "inner") -> DataFrame:
    """Join predictions with the feedback given within a time span after them.

    ``key`` should identify one request (the contract's conversation id). Both sides are
    watermarked and time-bounded, so state is dropped once no partner can arrive.
    """
    left = predictions.withWatermark(made_at, within)
    right = feedback.withColumnRenamed(key, "_key").withWatermark(given_at, within)
    timely = (F.col(given_at) >= F.col(made_at)) & (
        F.col(given_at) <= F.col(made_at) + F.expr(f"INTERVAL {within}"))
    return left.join(right, (F.col(key) == F.col("_key")) & timely, how).drop("_key")


def score_stream(requests: DataFrame, scorer, outcome_path: str, cache_path: str,
                 checkpoint: str) -> StreamingQuery:
    """Score every micro-batch against the cache and extend it.

    A replayed micro-batch overwrites its own outcome folder.
    """
    def score(batch: DataFrame, batch_id: int) -> None:
        score_and_store(batch, scorer, F.current_timestamp(), f"{outcome_path}/batch_id={batch_id}", cache_path)

    return (requests.writeStream.option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(score).start())


def tumbling_counts(df: DataFrame, timestamp: str, *labels: str, window: str = "1 hour",
                    lateness: str = "1 hour") -> DataFrame:
    """Counter by label and tumbling window."""
    return (df.withWatermark(timestamp, lateness)
            .groupBy(F.window(timestamp, window), *labels).agg(F.count("*").alias("n"))
            .select(F.col("window.start").alias("window_start"), *labels, "n"))


def sliding_latency(df: DataFrame, timestamp: str, milliseconds: str, window: str = "1 hour",
                    slide: str = "15 minutes", lateness: str = "1 hour",
                    targets=fixed.LATENCY_TARGETS_MS) -> DataFrame:
    """Approximate latency percentiles per sliding window with the limit flag."""
    shares = [share for share, _ in targets]
    stats = (df.withWatermark(timestamp, lateness)
             .groupBy(F.window(timestamp, window, slide))
             .agg(F.percentile_approx(milliseconds, shares).alias("q"), F.count("*").alias("n")))
    return stats.select(
        F.col("window.start").alias("window_start"), "n",
        *[F.col("q")[i].alias(f"p{round(100 * share)}_ms") for i, share in enumerate(shares)],
        (F.col("q")[len(shares) - 1] > targets[-1][1]).alias("over_limit"))


def binned_counts(df: DataFrame, timestamp: str, value: str, edges, window: str = "1 day",
                  lateness: str = "1 hour") -> DataFrame:
    """Counts per window and fixed bin, the streaming half of the drift score."""
    cuts = F.array(*[F.lit(float(e)) for e in edges])
    v = F.col(value)
    return (df.withWatermark(timestamp, lateness)
            .withColumn("bin", F.size(F.filter(cuts, lambda e: e < v)))
            .groupBy(F.window(timestamp, window), "bin").agg(F.count("*").alias("n"))
            .select(F.col("window.start").alias("window_start"), "bin", "n"))


def windowed_stability(counts: DataFrame, baseline_shares, floor: float = 1e-6,
                       threshold: float = fixed.PSI_THRESHOLD) -> DataFrame:
    """Drift score per window from :func:`binned_counts` output, a bounded table."""
    bins = len(baseline_shares)
    by_bin = [F.coalesce(F.sum(F.when(F.col("bin") == i, F.col("n"))), F.lit(0)).alias(f"b{i}")
              for i in range(bins)]
    wide = counts.groupBy("window_start").agg(*by_bin, F.sum("n").alias("n"))
    psi = F.lit(0.0)
    for i, share in enumerate(baseline_shares):
        p = F.lit(max(float(share), floor))
        q = F.greatest(F.col(f"b{i}") / F.col("n"), F.lit(floor))
        psi = psi + (q - p) * F.log(q / p)
    return wide.select("window_start", "n", psi.alias("psi"), (psi > threshold).alias("drifted"))


def sessions(df: DataFrame, key: str, timestamp: str, gap: str = "30 minutes",
             lateness: str = "1 hour") -> DataFrame:
    """Turn count and span of each conversation session."""
    return (df.withWatermark(timestamp, lateness)
            .groupBy(F.session_window(timestamp, gap), key).agg(F.count("*").alias("turns"))
            .select(key, F.col("session_window.start").alias("session_start"),
                    F.col("session_window.end").alias("session_end"), "turns"))


def rows_dropped_late(query: StreamingQuery) -> int:
    """Rows the watermark has dropped over the recorded progress of a query."""
    return sum(int(operator["numRowsDroppedByWatermark"] or 0)
               for progress in query.recentProgress
               for operator in progress["stateOperators"])
