"""Training-run history: early stopping and checkpoint choice.

A run has one row per epoch, so the per-run windows stay small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefrank import fixed_values as fixed


def running_best(history: DataFrame, run: str = "run_id", epoch: str = "epoch",
                 metric: str = "val_auc") -> DataFrame:
    """Best metric so far (starting at 0), improvement flag, epochs without improvement."""
    ordered = Window.partitionBy(run).orderBy(epoch)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    value = F.coalesce(F.col(metric), F.lit(0.0))
    best_before = F.greatest(F.coalesce(F.max(value).over(before), F.lit(0.0)), F.lit(0.0))
    marked = (history.withColumn("_n", F.row_number().over(ordered))
              .withColumn("improved", value > best_before)
              .withColumn("best_so_far", F.greatest(best_before, value)))
    last_gain = F.max(F.when(F.col("improved"), F.col("_n"))).over(so_far)
    return marked.withColumn(
        "no_improve_count", (F.col("_n") - F.coalesce(last_gain, F.lit(0))).cast("int")).drop("_n")


def early_stopping(history: DataFrame, patience: int = fixed.PATIENCE, run: str = "run_id",
                   epoch: str = "epoch", metric: str = "val_auc") -> DataFrame:
    """Epochs that run before and at the stop, with ``stop_epoch`` and ``best_epoch``.

    A run without any validation metric never stops.
    """
    everything = Window.partitionBy(run)
    ranked = running_best(history, run, epoch, metric)
    validated = F.max(F.col(metric).isNotNull()).over(everything)
    stop = F.min(F.when(F.col("no_improve_count") >= patience, F.col(epoch))).over(everything)
    ran = (ranked.withColumn("stop_epoch", F.when(validated, stop))
           .where(F.col("stop_epoch").isNull() | (F.col(epoch) <= F.col("stop_epoch"))))
    best = F.max(F.when(F.col("improved"), F.col(epoch))).over(everything)
    return ran.withColumn("best_epoch", best)


def top_checkpoints(history: DataFrame, keep: int = fixed.KEEP_CHECKPOINTS, run: str = "run_id",
                    epoch: str = "epoch", metric: str = "val_auc") -> DataFrame:
    """The best ``keep`` epochs of every run, the earlier one on ties."""
    order = Window.partitionBy(run).orderBy(F.desc(metric), epoch)
    return history.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
