"""Quality report of a preference table in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefrank.operators import dataset
from prefrank.schemas import TEXT_COLUMNS

FORM = ("check", "subject", "metric", "value", "status")


def _entry(check: str, subject, metric: str, value, status):
    return F.struct(F.lit(check).alias("check"), subject.alias("subject"), F.lit(metric).alias("metric"),
                    value.cast("double").alias("value"), status.alias("status"))


def _pii_entries(subject, checked):
    status = F.when(F.col("with_pii") > 0, "WARN").otherwise("OK")
    return [_entry("pii", subject, "checked", checked, status),
            _entry("pii", subject, "with_pii", F.col("with_pii"), status)]


def _rows(df: DataFrame, check: str, subject: str, metrics: dict, status) -> DataFrame:
    """Unpivot metric columns into report rows."""
    return df.select(F.inline(F.array(*[
        _entry(check, F.col(subject), name, column, status) for name, column in metrics.items()])))


def validation_report(df: DataFrame, pii_sample: int | None = None) -> DataFrame:
    """Row count, nulls, label distribution, personal data, text lengths.

    Counts of rows, nulls and personal data share one pass; label and length groups
    take one each. Raises ``KeyError`` when a required column is missing.
    """
    dataset.require_columns(df)
    table = F.lit("table")
    warn = lambda bad: F.when(bad, "WARN").otherwise("OK")
    nulls = {c: F.count_if(F.col(c).isNull()).alias(c) for c in TEXT_COLUMNS}
    counts = [F.count("*").alias("rows"), *nulls.values()]
    if pii_sample is None:
        counts.append(F.count_if(dataset.any_pii(TEXT_COLUMNS)).alias("with_pii"))
    one_pass = df.agg(*counts)
    entries = [_entry("rows", table, "rows", F.col("rows"), F.lit("INFO"))]
    entries += [_entry("nulls", F.lit(c), "nulls", F.col(c), warn(F.col(c) > 0)) for c in TEXT_COLUMNS]
    if pii_sample is None:
        entries += _pii_entries(table, F.col("rows"))
        parts = []
    else:
        pii = dataset.pii_rows(df, sample=pii_sample)
        parts = [pii.select(F.inline(F.array(*_pii_entries(table, F.col("checked")))))]
    parts = [one_pass.select(F.inline(F.array(*entries)))] + parts
    parts += [
        _rows(dataset.label_distribution(df), "labels", "winner",
              {"count": F.col("count"), "pct": F.col("pct")}, warn(F.col("underrepresented"))),
        _rows(dataset.length_stats(df, TEXT_COLUMNS), "length", "column", {
            "min": F.col("min_chars"), "mean": F.col("mean_chars"),
            "p95": F.col("p95_chars"), "max": F.col("max_chars")}, F.lit("INFO")),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report.select(*FORM)
