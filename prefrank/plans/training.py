"""Training of the preference classifier with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefrank import fixed_values as fixed
from prefrank.operators import metrics
from prefrank.plans.scoring import prepare
from prefrank.session import reliable_checkpoint


def smoothed_rows(df: DataFrame, label: str = "label", smoothing: float = fixed.LABEL_SMOOTHING,
                  classes: int = fixed.NUM_CLASSES) -> DataFrame:
    """One weighted row per class, so that weighted log-loss equals the smoothed loss."""
    low, high = smoothing / classes, 1.0 - smoothing + smoothing / classes
    targets = F.array(*[
        F.struct(F.lit(float(c)).alias("target"),
                 F.when(F.col(label) == c, high).otherwise(low).alias("weight"))
        for c in range(classes)])
    return df.select("*", F.inline(targets)).where(F.col("weight") > 0)


def training_rows(triples: DataFrame, embedding: str | None = None) -> DataFrame:
    """Labelled, redacted triples as (label, features); the embedding leads when given."""
    ready = prepare(metrics.labelled(triples)).where(~F.col("rejected"))
    parts = F.col("x_aux").cast("array<double>")
    if embedding:
        parts = F.concat(F.col(embedding).cast("array<double>"), parts)
    return ready.select("label", array_to_vector(parts).alias("features"))


def fit(triples: DataFrame, embedding: str | None = None, smoothing: float = fixed.LABEL_SMOOTHING,
        max_iter: int = 30, reg_param: float = 0.01, depth: int = 2, materialize: bool = True):
    """Fit scaler and multinomial regression; gradients sum over the executors by tree aggregation.

    The feature rows are stored in the shared folder first (``materialize``), so that the
    passes of the fit do not touch the texts again. Returns the fitted model, saved and loaded with ``model.write()`` and ``PipelineModel.load``.
    """
    rows = training_rows(triples, embedding)
    rows = smoothed_rows(reliable_checkpoint(rows) if materialize else rows, smoothing=smoothing)
    classifier = LogisticRegression(
        featuresCol="scaled", labelCol="target", weightCol="weight", probabilityCol="probability",
        family="multinomial", maxIter=max_iter, regParam=reg_param, aggregationDepth=depth)
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    return Pipeline(stages=[scaler, classifier]).fit(rows)


def predict(model, triples: DataFrame, embedding: str | None = None) -> DataFrame:
    """(label, probabilities) of labelled triples under a fitted model."""
    scored = model.transform(training_rows(triples, embedding))
    return scored.select("label", vector_to_array("probability").alias("probabilities"))


def loss_history(model, run_id: str) -> DataFrame:
    """Objective per iteration of a fitted model as run-history rows."""
    from pyspark.sql import SparkSession

    history = model.stages[-1].summary.objectiveHistory
    rows = [(run_id, i, float(value)) for i, value in enumerate(history)]
    return SparkSession.active().createDataFrame(rows, "run_id string, epoch int, loss double")
