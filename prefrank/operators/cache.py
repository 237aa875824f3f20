"""Result cache kept as an append-only table of (key, value, written_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefrank import fixed_values as fixed
from prefrank.schemas import RESULT


def live_entries(cache: DataFrame, now: Column, ttl: int = fixed.CACHE_TTL_SECONDS) -> DataFrame:
    """Latest readable entry per key that has not expired.

    The age filter reaches the scan; entries of one key meet as partial maxima, so a
    key written very often costs no more than any other. Malformed values are misses.
    """
    oldest = now - F.expr(f"INTERVAL {int(ttl)} SECONDS")
    fresh = cache.where((F.col("written_at") > oldest) & (F.col("written_at") <= now))
    if "day" in cache.columns:
        # Partition folders of other days are never opened.
        fresh = fresh.where(F.col("day").between(F.to_date(oldest), F.to_date(now)))
    latest = fresh.groupBy("key").agg(F.max_by("value", "written_at").alias("value"))
    parsed = latest.select("key", F.from_json("value", RESULT).alias("cached"))
    return parsed.where(F.col("cached.winner").isNotNull())


def with_cached(requests: DataFrame, cache: DataFrame, now: Column,
                ttl: int = fixed.CACHE_TTL_SECONDS) -> DataFrame:
    """Left join on ``key``: struct ``cached`` (null on a miss) and flag ``from_cache``.

    The cache side holds one row per key, so a frequent request key multiplies nothing
    and adaptive execution can split its partition.
    """
    joined = requests.join(live_entries(cache, now, ttl), "key", "left")
    return joined.withColumn("from_cache", F.col("cached").isNotNull())


def misses(requests: DataFrame, cache: DataFrame, now: Column,
           ttl: int = fixed.CACHE_TTL_SECONDS) -> DataFrame:
    """Requests without a live entry."""
    return requests.join(live_entries(cache, now, ttl), "key", "left_anti")


def entries(results: DataFrame, now: Column) -> DataFrame:
    """Rows to append for freshly scored results, one per key."""
    fresh = results.where(~F.col("from_cache"))
    one = fresh.groupBy("key").agg(F.first(F.struct(*RESULT.fieldNames())).alias("value"))
    return one.select("key", F.to_json("value").alias("value"), now.alias("written_at"))
