"""Cleaning and quality reports of preference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from prefrank import fixed_values as fixed
from prefrank.functions.privacy import _col, has_pii
from prefrank.operators.ordering import permuted, with_positions
from prefrank.schemas import REQUIRED_PREFERENCE_COLUMNS, TEXT_COLUMNS


def missing_columns(df: DataFrame, required=REQUIRED_PREFERENCE_COLUMNS) -> list[str]:
    """Required names the table lacks."""
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required=REQUIRED_PREFERENCE_COLUMNS) -> DataFrame:
    """The table itself; raises ``KeyError`` naming what is missing, before any job runs."""
    missing = missing_columns(df, required)
    if missing:
        raise KeyError(f"missing required columns: {missing}")
    return df


def normalize_segment(segment, policy: str = "default") -> Column:
    """Segment by one of three policies.

    ``default``: upper-case, unknown or null becomes the default segment.
    ``reject``: upper-case, null becomes the default segment, unknown becomes null.
    ``exact``: only the exact spelling counts, null becomes the default segment.
    """
    raw = _col(segment).cast("string")
    upper = F.upper(raw)
    default = F.lit(fixed.DEFAULT_SEGMENT)
    if policy == "default":
        return F.when(upper.isin(*fixed.SEGMENTS), upper).otherwise(default)
    if policy == "reject":
        return F.when(raw.isNull(), default).when(upper.isin(*fixed.SEGMENTS), upper)
    if policy == "exact":
        return F.when(raw.isNull(), default).when(raw.isin(*fixed.SEGMENTS), raw)
    raise ValueError(f"unknown segment policy: {policy}")


def encode_label(winner) -> Column:
    """Class index of the winner text; null when unknown."""
    mapping = F.create_map(*[F.lit(x) for pair in fixed.LABELS.items() for x in pair])
    return F.try_element_at(mapping, F.lower(_col(winner).cast("string")))


def feedback_winner_to_training(winner) -> Column:
    """'A', 'B', 'tie' of a feedback event as training winner text."""
    mapping = F.create_map(*[F.lit(x) for p in fixed.FEEDBACK_TO_TRAINING.items() for x in p])
    return F.try_element_at(mapping, _col(winner))


def head(df: DataFrame, max_rows: int | None, order: str | None = None) -> DataFrame:
    """First ``max_rows`` rows; ``order`` makes the choice repeatable. None keeps all."""
    if max_rows is None:
        return df
    return (df.orderBy(order) if order else df).limit(max_rows)


def clean_preferences(df: DataFrame, max_rows: int | None = None, order: str | None = None,
                      observation: Observation | None = None) -> DataFrame:
    """Required columns, row limit, null-text removal, coercion, segment and label.

    With an ``observation`` the counts ``rows`` and ``dropped`` come as by-products of
    whatever action runs next.
    """
    require_columns(df)
    rows = head(df, max_rows, order)
    texts = [F.col(c).isNull() for c in TEXT_COLUMNS]
    incomplete = texts[0] | texts[1] | texts[2]
    if observation is not None:
        rows = rows.observe(observation, F.count("*").alias("rows"),
                            F.count_if(incomplete).alias("dropped"))
    segment = F.col("merchant_segment") if "merchant_segment" in df.columns else F.lit(None)
    return rows.na.drop(subset=list(TEXT_COLUMNS)).select(
        F.col("conversation_id").cast("string").alias("conversation_id"),
        *[F.col(c).cast("string").alias(c) for c in TEXT_COLUMNS],
        normalize_segment(segment).alias("segment"),
        encode_label("winner").alias("label"),
    )


def row_counts(df: DataFrame) -> DataFrame:
    """Rows read, rows dropped for null texts, rows kept."""
    complete = F.col("prompt").isNotNull() & F.col("response_a").isNotNull() & F.col("response_b").isNotNull()
    return df.agg(F.count("*").alias("rows"), F.count_if(~complete).alias("dropped"),
                  F.count_if(complete).alias("kept"))


def shuffle_rows(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Repeatable random order for an epoch."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def epoch_order(df: DataFrame, key: str, seed: int, out: str = "position") -> DataFrame:
    """Rows with their place in the repeatable order of an epoch; ``key`` is unique.

    The place is that of a keyed permutation of the positions in the order of ``key``: another epoch is another seed, and
    rows need not be sorted again for it.
    """
    placed, total = with_positions(df, key, out="_position")
    return placed.select(*df.columns, permuted("_position", total, seed).alias(out))


def label_distribution(df: DataFrame, winner: str = "winner") -> DataFrame:
    """Count and share of all rows per winner text, with an imbalance flag.

    Rows without a winner form no group but count in the divisor.
    """
    counts = df.groupBy(F.col(winner).alias("winner")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    share = F.col("count") / total
    return (counts.where(F.col("winner").isNotNull())
            .select("winner", "count", (100 * share).alias("pct"),
                    (share < fixed.IMBALANCE_SHARE).alias("underrepresented")))


def by_frequency(distribution: DataFrame) -> DataFrame:
    """Most frequent winner first."""
    return distribution.orderBy(F.desc("count"), "winner")


def null_report(df: DataFrame, columns=TEXT_COLUMNS) -> DataFrame:
    """One row per column: number of nulls, from a single pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns])))


def length_stats(df: DataFrame, columns=TEXT_COLUMNS, share: float = 0.95) -> DataFrame:
    """Minimum, mean, p95 and maximum character length per column.

    Lengths collapse to (column, length, count) first, so the exact percentile is
    taken over at most as many rows as there are distinct lengths.
    """
    lengths = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.length(c).cast("long").alias("length"))
        for c in columns])))
    counts = (lengths.where(F.col("length").isNotNull())
              .groupBy("column", "length").agg(F.count("*").alias("n")))
    return counts.groupBy("column").agg(
        F.min("length").alias("min_chars"),
        (F.sum(F.col("length") * F.col("n")) / F.sum("n")).alias("mean_chars"),
        F.percentile("length", share, F.col("n")).alias("p95_chars"),
        F.max("length").alias("max_chars"),
    )


def any_pii(columns=TEXT_COLUMNS) -> Column:
    """True when any of the text columns holds personal data."""
    found = None
    for column in columns:
        hit = has_pii(F.col(column).cast("string"))
        found = hit if found is None else found | hit
    return found


def pii_rows(df: DataFrame, columns=TEXT_COLUMNS, sample: int | None = None,
             key: str = "conversation_id", seed: int = 42) -> DataFrame:
    """Rows checked and rows with personal data in any of the texts.

    All rows are checked by default; ``sample`` takes that many in hash order.
    """
    if sample is not None:
        df = df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(sample)
    return df.agg(F.count("*").alias("checked"), F.count_if(any_pii(columns)).alias("with_pii"))


class PiiFound(RuntimeError):
    """Personal data in a table that must be free of it."""


def pii_gate(df: DataFrame, columns=TEXT_COLUMNS) -> DataFrame:
    """The table itself; raises ``PiiFound`` when a text still holds personal data."""
    if not df.where(any_pii(columns)).isEmpty():
        raise PiiFound("personal data found; redact the table before training")
    return df
