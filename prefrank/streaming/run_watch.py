"""Early-stopping decisions of training runs, kept up to date by a stream over their history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from prefrank import fixed_values as fixed
from prefrank.schemas import TRAINING_HISTORY
from prefrank.streaming.versions import latest_rows, start_updating

DECISION = "run_id string, epochs int, last_epoch int, best_auc double, best_epoch int, no_improve_count int, stop_epoch int"


def read_new_epochs(spark: SparkSession, path: str) -> DataFrame:
    """History rows below ``path`` as a stream, in any folders; rows that were there are not read again."""
    names = TRAINING_HISTORY.fieldNames()
    return spark.readStream.schema(TRAINING_HISTORY).option("recursiveFileLookup", True).parquet(path).select(*names)


def decisions(history: DataFrame, patience: int = fixed.PATIENCE) -> DataFrame:
    """Changed decisions of a stream of epochs: one row for each run of a micro-batch.

    The best AUC starts at 0 and only a larger one counts; ``stop_epoch`` is the first epoch with ``patience``
    epochs in a row without a better one, and later epochs change nothing any more. A run's state is these few numbers. Epochs
    of a run arrive in order or within one micro-batch; an epoch that was seen already (or a lower one) is passed
    over. A run without any validation has no decision to stop.
    """
    names = [part.split()[0] for part in DECISION.split(", ")]

    def decide(key, frames, state: GroupState):
        import pandas as pd

        count, last, best, best_epoch, stalled, stop, validated = state.get if state.exists else (0, -1, 0.0, -1, 0, -1, False)
        rows = sorted((int(e), None if pd.isna(a) else float(a)) for f in frames for e, a in zip(f["epoch"], f["val_auc"]))
        for epoch, auc in rows:
            if epoch <= last or stop >= 0 and validated:
                continue
            count, last, validated = count + 1, epoch, validated or auc is not None
            if (auc or 0.0) > best:
                best, best_epoch, stalled = auc, epoch, 0
            else:
                stalled += 1
                stop = epoch if stop < 0 and stalled >= patience else stop
        state.update((count, last, best, best_epoch, stalled, stop, validated))
        none = [None if n < 0 else n for n in (best_epoch, stop if validated else -1)]
        yield pd.DataFrame([(key[0], count, last, best, none[0], stalled, none[1])], columns=names).astype(
            {"best_epoch": "Int32", "stop_epoch": "Int32"})

    return history.select("run_id", "epoch", "val_auc").groupBy("run_id").applyInPandasWithState(
        decide, DECISION, "count int, last int, best double, best_epoch int, stalled int, stop int, validated boolean",
        "update", GroupStateTimeout.NoTimeout)


def start_watching(spark: SparkSession, history: str, path: str, checkpoint: str,
                   patience: int = fixed.PATIENCE) -> StreamingQuery:
    """Write the decisions that new history rows change below ``path``; ends when the present rows are used up."""
    return start_updating(decisions(read_new_epochs(spark, history), patience), path, checkpoint)


def current_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Newest decision of each run."""
    return latest_rows(spark, path, DECISION, "run_id")


def running(found: DataFrame) -> DataFrame:
    """Runs that have not been told to stop."""
    return found.where(F.col("stop_epoch").isNull())
