"""Evaluation: scored table to metrics, gate and report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefrank import fixed_values as fixed
from prefrank.operators import metrics
from prefrank.plans.scoring import Scorer, score_triples
from prefrank.session import reliable_checkpoint
from prefrank.sources.reports import write_json


class GateFailed(RuntimeError):
    """A metric misses a threshold that must hold."""


def evaluate(triples: DataFrame, scorer: Scorer, by=(), materialize: bool = True, **options) -> DataFrame:
    """Score labelled triples and return the metric bundle with calibration error.

    Unlabelled rows are left out before scoring. The metrics read the predictions twice;
    ``materialize`` stores them (a label and three numbers per row) in the shared folder
    first, so that texts are redacted, featurised and scored once. ``options`` go to
    :func:`metrics.evaluation_metrics`.
    """
    scored = score_triples(metrics.labelled(triples), scorer).select(*by, "label", "probabilities")
    if materialize:
        scored = reliable_checkpoint(scored)
    return metrics.evaluation_metrics(scored, by, **options)


def gate_and_report(result: DataFrame, path: str | None = None, rules=fixed.EVALUATION_GATE, by=()) -> DataFrame:
    """Apply the gate, then write the report; a failed rule raises before anything is written.

    ``by`` names the group columns of ``result``; the gate and the error carry them. ``result``
    has a row for each group, and so does the error.
    """
    gate = metrics.acceptance_gate(result, rules, by)
    failed = [r.asDict() for r in gate.where(F.col("status") == "fail").collect()]
    if failed:
        raise GateFailed(f"acceptance gate failed: {failed}")
    if path:
        write_json(result, path)
    return gate
