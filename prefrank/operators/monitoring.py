"""Operational counters, latency reports, drift and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefrank import fixed_values as fixed
from prefrank.functions.privacy import MAIN, Dialect, has_pii, redacted_types
from prefrank.operators.ordering import count_below, exact_quantiles
from prefrank.session import computed_once


def label_counts(df: DataFrame, *labels: str) -> DataFrame:
    """Counter by labels."""
    return df.groupBy(*labels).agg(F.count("*").alias("n"))


def pii_event_counts(df: DataFrame, text: str, dialect: Dialect = MAIN, by=()) -> DataFrame:
    """Messages changed by each redaction step."""
    # Pinned: the filter that comes with explode() would evaluate every pattern a second time.
    changed = computed_once(df.select(*by, redacted_types(text, dialect).alias("types")), "types")
    return (changed.select(*by, F.explode("types").alias("pii_type"))
            .groupBy(*by, "pii_type").agg(F.count("*").alias("n")))


def pii_leaks(df: DataFrame, text: str) -> DataFrame:
    """Outputs, and outputs that still hold personal data."""
    return df.agg(F.count("*").alias("outputs"), F.count_if(has_pii(text)).alias("leaks"))


def latency_histogram(df: DataFrame, seconds: str, bounds=fixed.REQUEST_LATENCY_BOUNDS,
                      by=()) -> DataFrame:
    """Cumulative bucket counts per bound and +Inf, with sum and count of the series."""
    value = F.col(seconds)
    limits = [*bounds, float("inf")]
    wide = df.where(value.isNotNull()).groupBy(*by).agg(
        *[F.count_if(value <= b).alias(f"le{i}") for i, b in enumerate(limits)],
        F.sum(value).alias("latency_sum"), F.count("*").alias("latency_count"))
    rows = F.array(*[
        F.struct(F.lit("+Inf" if b == float("inf") else str(b)).alias("le"),
                 F.col(f"le{i}").alias("bucket_count")) for i, b in enumerate(limits)])
    return wide.select(*by, "latency_sum", "latency_count", F.inline(rows))


def latency_percentiles(df: DataFrame, milliseconds: str, targets=fixed.LATENCY_TARGETS_MS,
                        by=(), exact: bool = True) -> DataFrame:
    """Percentiles against their targets; ``exact=False`` uses mergeable sketches."""
    shares = [share for share, _ in targets]
    if exact:
        rows = exact_quantiles(df, milliseconds, shares, by)
    else:
        sketch = F.percentile_approx(milliseconds, shares)
        pairs = F.arrays_zip(F.array(*[F.lit(s) for s in shares]).alias("share"),
                             F.col("_q").alias("quantile"))
        rows = df.groupBy(*by).agg(sketch.alias("_q")).select(*by, F.inline(pairs))
    limits = F.create_map(*[F.lit(x) for pair in targets for x in pair])
    limit = F.element_at(limits, F.col("share"))
    return rows.select(*by, "share", F.col("quantile").alias("latency_ms"),
                       limit.alias("target_ms"), (F.col("quantile") > limit).alias("breached"))


def limit_breaches(df: DataFrame, milliseconds: str, limit: float = fixed.LATENCY_LIMIT_MS,
                   by=()) -> DataFrame:
    """Requests, and requests slower than the limit."""
    return df.groupBy(*by).agg(F.count("*").alias("requests"),
                               F.count_if(F.col(milliseconds) > limit).alias("breaches"))


def cache_stats(df: DataFrame, flag: str = "from_cache") -> DataFrame:
    """Hits and misses."""
    return df.agg(F.count_if(F.col(flag)).alias("hits"), F.count_if(~F.col(flag)).alias("misses"))


def population_stability(baseline: DataFrame, current: DataFrame, value: str, bins: int = 10,
                         floor: float = 1e-6, threshold: float = fixed.PSI_THRESHOLD,
                         exact: bool = True) -> DataFrame:
    """Population stability index of ``current`` against the baseline's quantile bins.

    ``exact=False`` takes the bin edges from a mergeable sketch, which saves the shuffle of
    the baseline's distinct values. Both sides reduce to at most ``bins`` counts. Shares are floored so that an empty
    bin stays finite. One row: psi, drifted.
    """
    shares = [i / bins for i in range(1, bins)]
    if exact:
        edges = exact_quantiles(baseline, value, shares).agg(F.sort_array(F.collect_list("quantile")))
    else:
        edges = baseline.agg(F.percentile_approx(F.col(value).cast("double"), shares))
    packed = edges.scalar()
    tagged = (baseline.select(F.col(value).alias("v"), F.lit(True).alias("base"))
              .unionByName(current.select(F.col(value).alias("v"), F.lit(False).alias("base")))
              .where(F.col("v").isNotNull()))
    placed = tagged.withColumn("_edges", packed).select(
        "base", count_below("_edges", F.col("v"), bins).alias("bin"))
    counts = placed.groupBy("bin").agg(F.count_if("base").alias("b"), F.count_if(~F.col("base")).alias("c"))
    wide = counts.agg(
        F.sum("b").alias("b"), F.sum("c").alias("c"),
        *[F.coalesce(F.sum(F.when(F.col("bin") == i, F.col(side))), F.lit(0)).alias(f"{side}{i}")
          for i in range(bins) for side in "bc"])
    psi = F.lit(0.0)
    for i in range(bins):
        p = F.greatest(F.try_divide(f"b{i}", "b"), F.lit(floor))
        q = F.greatest(F.try_divide(f"c{i}", "c"), F.lit(floor))
        psi = psi + (q - p) * F.log(q / p)
    return wide.select(psi.alias("psi")).select("psi", (F.col("psi") > threshold).alias("drifted"))


def alert_rules(spark) -> DataFrame:
    return spark.createDataFrame(
        list(fixed.ALERT_RULES),
        "alert string, metric string, threshold double, severity string, action string")


def alerts(metrics: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Rules whose metric (metric, value) lies above the threshold."""
    rules = alert_rules(metrics.sparkSession) if rules is None else rules
    return (metrics.join(rules, "metric").where(F.col("value") > F.col("threshold"))
            .select("alert", "metric", "value", "threshold", "severity", "action"))


def within_retention(df: DataFrame, timestamp: str, now: Column | None = None,
                     days: int = fixed.RETENTION_DAYS) -> DataFrame:
    """Rows young enough to keep; the bound is a constant, so scans can prune on it."""
    now = F.current_timestamp() if now is None else now
    return df.where(F.col(timestamp) >= now - F.expr(f"INTERVAL {int(days)} DAYS"))


def with_consent(df: DataFrame, consent: DataFrame, key: str) -> DataFrame:
    """Rows whose subject has consented; repeated consents collapse before the join."""
    return df.join(consent.select(key).distinct(), key, "left_semi")


def without_consent(df: DataFrame, consent: DataFrame, key: str) -> DataFrame:
    """Rows whose subject has not."""
    return df.join(consent.select(key).distinct(), key, "left_anti")


def traffic_split(key, fraction: float) -> Column:
    """'challenger' for a fixed share of keys, else 'champion'; a key never changes side."""
    if not 0.0 <= fraction <= 0.5:
        raise ValueError("challenger fraction must be in [0, 0.5]")
    key = F.col(key) if isinstance(key, str) else key
    # The leading 28 bits of the digest, uniform in [0, 2^28).
    bucket = F.conv(F.substring(F.md5(key.cast("string")), 1, 7), 16, 10).cast("long")
    return F.when(bucket < int(fraction * 2**28), "challenger").otherwise("champion")


def turn_counts(df: DataFrame, conversation: str) -> DataFrame:
    """Turns per conversation."""
    return df.groupBy(conversation).agg(F.count("*").alias("turns"))
