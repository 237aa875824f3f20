"""Checks of requests, feedback events, batches and results.

A check adds an ``errors`` array instead of failing the job: one bad row must not
stop a table. ``valid`` and ``rejected`` split the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefrank import fixed_values as fixed
from prefrank.functions import scoring
from prefrank.functions.privacy import is_blank
from prefrank.schemas import TEXT_COLUMNS


def _errors(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, F.lit(reason)) for bad, reason in checks]))


def _request_checks(row) -> list[tuple[Column, str]]:
    checks = []
    for name in TEXT_COLUMNS:
        text = row(name)
        checks += [
            (text.isNull(), f"{name}: missing"),
            (F.length(text) > fixed.MAX_TEXT_CHARS, f"{name}: too long"),
            (is_blank(text), f"{name}: blank"),
        ]
    segment = row("merchant_segment")
    return checks + [
        (segment.isNotNull() & ~segment.isin(*fixed.SEGMENTS), "merchant_segment: unknown"),
        (F.length(row("conversation_id")) > fixed.MAX_ID_CHARS, "conversation_id: too long"),
    ]


def check_requests(df: DataFrame) -> DataFrame:
    """Text length and content, segment spelling, id length."""
    return df.withColumn("errors", _errors(*_request_checks(F.col)))


def check_batches(df: DataFrame, items: str = "items") -> DataFrame:
    """1 to 32 items per batch, each a valid request."""
    size = F.coalesce(F.size(items), F.lit(0))
    item_errors = F.flatten(F.transform(
        F.coalesce(F.col(items), F.array().cast(df.schema[items].dataType)),
        lambda item: _errors(*_request_checks(lambda name: item[name]))))
    return df.withColumn("errors", F.concat(_errors(
        (size < 1, "items: empty"), (size > fixed.MAX_BATCH_ITEMS, "items: too many")), item_errors))


def with_feedback_defaults(df: DataFrame) -> DataFrame:
    return df.withColumn("channel", F.coalesce("channel", F.lit(fixed.DEFAULT_CHANNEL)))


def check_feedback(df: DataFrame) -> DataFrame:
    """Id length, winner, satisfaction range and channel of feedback events."""
    low, high = fixed.SATISFACTION_RANGE
    length = F.length("conversation_id")
    score, channel, actual = F.col("satisfaction_score"), F.col("channel"), F.col("actual_winner")
    return df.withColumn("errors", _errors(
        (F.col("conversation_id").isNull() | (length < 1), "conversation_id: missing"),
        (length > fixed.MAX_ID_CHARS, "conversation_id: too long"),
        (actual.isNull() | ~actual.isin(*fixed.WINNERS), "actual_winner: unknown"),
        (~score.between(low, high), "satisfaction_score: out of range"),
        (channel.isNotNull() & ~channel.isin(*fixed.FEEDBACK_CHANNELS), "channel: unknown"),
    ))


def check_results(df: DataFrame, probabilities: str = "probabilities",
                  winner: str = "winner") -> DataFrame:
    """Probabilities in range with sum 1, winner known."""
    return df.withColumn("errors", _errors(
        (~scoring.valid_probabilities(probabilities), "probabilities: invalid"),
        (F.col(winner).isNull() | ~F.col(winner).isin(*fixed.WINNERS), "winner: unknown"),
    ))


def valid(df: DataFrame) -> DataFrame:
    return df.where(F.size("errors") == 0).drop("errors")


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.size("errors") > 0)


def score_range_alerts(df: DataFrame, score: str) -> DataFrame:
    """Rows and rows whose score leaves [0, 1]."""
    return df.agg(F.count("*").alias("rows"),
                  F.count_if(~F.col(score).between(0.0, 1.0)).alias("out_of_range"))
