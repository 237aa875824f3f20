"""Sliding latency percentiles from panes.

A pane is as long as the slide. It holds a quantile sketch of its rows, and a window is the
merge of its panes: a row is counted once, not once for each window that covers it.

The exact form keeps the counts of each value of a pane instead. Counts of micro-batches add up, so
that stream needs no state and drops no late row.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prefrank import fixed_values as fixed
from prefrank.operators.ordering import bucket_offsets, with_bucket
from prefrank.session import scratch_path

PANE_SCHEMA = "pane_start timestamp, sketch binary, n bigint"
COUNT_SCHEMA = "pane_start timestamp, value double, n bigint"
#: Size of a sketch: ranks of a merged window are off by 1.33 % of its rows at most in 99 of 100 cases.
SKETCH_SIZE = 200
RANK_ERROR = 0.0133


def latency_panes(df: DataFrame, timestamp: str, milliseconds: str, slide: str = "15 minutes",
                  lateness: str = "1 hour", size: int = SKETCH_SIZE) -> DataFrame:
    """Sketch and row count per pane; rows without a value are not counted.

    For streams in update mode, see `versions`; a batch table gives the same panes.
    """
    value = F.col(milliseconds).cast("double")
    return (df.where(value.isNotNull()).withWatermark(timestamp, lateness).groupBy(F.window(timestamp, slide))
            .agg(F.kll_sketch_agg_double(value, F.lit(size)).alias("sketch"), F.count("*").alias("n"))
            .select(F.col("window.start").alias("pane_start"), "sketch", "n"))


def _window_starts(window: str, slide: str) -> Column:
    """Starts of the windows that cover a pane."""
    seconds = [F.unix_seconds(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {span}")) for span in (window, slide)]
    return F.transform(F.sequence(F.lit(0), (seconds[0] / seconds[1]).cast("int") - 1),
                       lambda i: F.timestamp_seconds(F.unix_seconds("pane_start") - i * seconds[1]))


def sliding_percentiles(panes: DataFrame, window: str = "1 hour", slide: str = "15 minutes",
                        targets=fixed.LATENCY_TARGETS_MS, size: int = SKETCH_SIZE) -> DataFrame:
    """Row count, percentiles and limit flag per sliding window, from its panes.

    ``window`` is a multiple of ``slide``. Only sketches are copied into windows, and a pane of a
    few kilobytes stands for all its rows.
    """
    merged = panes.select(F.explode(_window_starts(window, slide)).alias("window_start"), "sketch", "n").groupBy("window_start").agg(
        F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"), F.sum("n").alias("n"))
    shares = [share for share, _ in targets]
    found = [F.kll_sketch_get_quantile_double("sketch", F.lit(share)) for share in shares]
    return merged.select("window_start", "n", *[q.alias(f"p{round(100 * s)}_ms") for s, q in zip(shares, found)],
                         (found[-1] > targets[-1][1]).alias("over_limit"))


def start_counting(df: DataFrame, timestamp: str, milliseconds: str, path: str, checkpoint: str,
                   slide: str = "15 minutes", available_now: bool = True) -> StreamingQuery:
    """Write how often each value occurs in each pane of a micro-batch; a replayed one overwrites its folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(F.window(timestamp, slide)["start"].alias("pane_start"),
                               F.col(milliseconds).cast("double").alias("value")).agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts written by :func:`start_counting`: pane_start, value, n; a key has a row for each micro-batch it is in."""
    return spark.read.schema(COUNT_SCHEMA).parquet(path)


def exact_percentiles(counts: DataFrame, window: str = "1 hour", slide: str = "15 minutes",
                      targets=fixed.LATENCY_TARGETS_MS, buckets: int | None = None) -> DataFrame:
    """As :func:`sliding_percentiles`, from counts of values; a percentile is the least value with its share of rows up to it.

    Rows without a value count in ``n`` only. Values are cut into buckets, and only those that hold a wanted
    rank are sorted, each on its own: a busy window is no single task.
    """
    spark = counts.sparkSession
    place = scratch_path(spark, "pane-counts")
    counts.groupBy("pane_start", "value").agg(F.sum("n").alias("n")).write.parquet(place)
    stored = spark.read.schema(COUNT_SCHEMA).parquet(place)
    starts = F.explode(_window_starts(window, slide)).alias("window_start")
    shares = [share for share, _ in targets]
    names = [f"p{round(100 * share)}_ms" for share in shares]

    rows = with_bucket(stored.where(F.col("value").isNotNull()), "value", buckets).select(starts, "bucket", "value", "n")
    sizes = bucket_offsets(rows.groupBy("window_start", "bucket").agg(F.sum("n").alias("size")), ["window_start"], "size", "before")
    totals = sizes.groupBy("window_start").agg(F.sum("size").alias("total"))
    # Decimal shares: 0.95 of 20 rows is the 19th one whatever its double is.
    ranks = F.array(*[F.struct(F.lit(i).alias("share"), F.greatest(F.ceil(F.lit(Decimal(str(share))) * F.col("total")).cast("long"),
                                                                  F.lit(1).cast("long")).alias("rank")) for i, share in enumerate(shares)])
    held = F.filter("ranks", lambda r: (r["rank"] > F.col("before")) & (r["rank"] <= F.col("before") + F.col("size")))
    wanted = sizes.join(totals.withColumn("ranks", ranks), "window_start").select(
        "window_start", "bucket", "before", held.alias("ranks")).where(F.size("ranks") > 0)
    inside = Window.partitionBy("window_start", "bucket").orderBy("value")
    upto = F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    summed = rows.join(wanted, ["window_start", "bucket"]).groupBy("window_start", "bucket", "value").agg(
        F.sum("n").alias("n"), F.first("before").alias("before"), F.first("ranks").alias("ranks"))
    placed = summed.withColumn("below", F.col("before") + F.coalesce(upto, F.lit(0)))
    at = placed.select("window_start", "value", "below", "n", F.inline("ranks")).where(
        (F.col("rank") > F.col("below")) & (F.col("rank") <= F.col("below") + F.col("n")))
    found = at.groupBy("window_start").agg(
        *[F.max(F.when(F.col("share") == i, F.col("value"))).alias(name) for i, name in enumerate(names)])
    every = stored.select(starts, "n").groupBy("window_start").agg(F.sum("n").alias("n"))
    return every.join(found, "window_start", "left").select(
        "window_start", "n", *names, (F.col(names[-1]) > targets[-1][1]).alias("over_limit"))
