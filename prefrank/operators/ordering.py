"""Ordered computations over whole tables without a one-task window.

A window without a partition key, or with a hot one, sends its rows to one task.
The helpers here cut the ordered domain at approximate quantiles first, so that a
task holds about ``1 / buckets`` of the distinct ordered values whatever the keys
look like; totals of the buckets then link the pieces exactly. The cut points only
balance the work: results do not depend on where they fall.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from prefrank.session import computed_once, scratch_path

#: Pieces an ordered domain is cut into at least; more where the session has more shuffle partitions.
BUCKETS = 256


def pieces(df: DataFrame, buckets: int | None) -> int:
    """``buckets``, or four for each shuffle partition of the session, `BUCKETS` at least."""
    return buckets or max(BUCKETS, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cut_points(df: DataFrame, order: str, buckets: int | None = None, also=()) -> Column:
    """Approximate quantiles of ``order`` as a scalar-subquery column of doubles.

    ``also`` are aggregates evaluated alongside, so that this branch reads the same
    columns as the main one and Spark reuses the exchange below both.
    """
    buckets = pieces(df, buckets)
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    edges = F.percentile_approx(F.col(order).cast("double"), shares, F.lit(8 * buckets))
    known = F.coalesce(F.array_distinct(edges), F.array().cast("array<double>"))
    return df.agg(F.struct(known.alias("edges"),
                           *[a.alias(f"also{i}") for i, a in enumerate(also)])).scalar()["edges"]


def count_below(edges: str, value: Column, most: int) -> Column:
    """How many of the sorted ``edges`` lie below ``value``, by binary search.

    ``most`` bounds the number of edges. Positions past the end read as null and count
    as not below.
    """
    steps = [1 << i for i in range(max(most, 1).bit_length())][::-1]
    sorted_edges = F.col(edges)
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, step: F.when(F.get(sorted_edges, at + step - 1) < value, at + step).otherwise(at))


def with_bucket(df: DataFrame, order: str, buckets: int | None = None, out: str = "bucket",
                also=()) -> DataFrame:
    """Add the number of cut points below ``order``; equal values share a bucket."""
    value = F.col(order).cast("double")
    buckets = pieces(df, buckets)
    placed = (df.withColumn("_edges", cut_points(df, order, buckets, also))
              .withColumn(out, count_below("_edges", value, buckets)).drop("_edges"))
    return computed_once(placed, out)


def bucket_offsets(totals: DataFrame, keys: list[str], amount: str, out: str,
                   bucket: str = "bucket") -> DataFrame:
    """Running total of ``amount`` over earlier buckets; at most ``buckets`` rows per key."""
    earlier = (Window.partitionBy(*keys).orderBy(bucket)
               .rowsBetween(Window.unboundedPreceding, -1))
    return totals.withColumn(out, F.coalesce(F.sum(amount).over(earlier), F.lit(0)))


def with_position(df: DataFrame, order: str, out: str = "position",
                  buckets: int | None = None) -> DataFrame:
    """Add the global 0-based position by a unique numeric column ``order``.

    A task sorts about ``1 / buckets`` of the rows.
    """
    placed = with_bucket(df, order, buckets)
    totals = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    # One row per bucket, so one task for the running total.
    offsets = bucket_offsets(totals.withColumn("all", F.lit(0)), ["all"], "n", "offset")
    inside = Window.partitionBy("bucket").orderBy(order)
    # Bounded by the number of buckets, whatever the table size.
    offsets = F.broadcast(offsets.select("bucket", "offset"))
    return (placed.join(offsets, "bucket")
            .withColumn(out, F.col("offset") + F.row_number().over(inside) - 1)
            .drop("bucket", "offset"))


def chunk(df: DataFrame, order: str, size: int, out: str = "chunk",
          buckets: int | None = None) -> DataFrame:
    """Number fixed-size chunks of rows in global order."""
    return (with_position(df, order, "_position", buckets)
            .withColumn(out, F.floor(F.col("_position") / size))
            .drop("_position"))


#: Bits that one pass of the quantile selection settles; four passes settle a double.
DIGIT = 16


def _order_key(value: Column) -> Column:
    """Whole number that sorts as the double does; -0.0 is 0.0 and NaN comes last."""

    def keys(values: pa.Array) -> pa.Array:
        x = values.to_numpy(zero_copy_only=False) + 0.0
        bits = np.where(np.isnan(x), np.nan, x).view(np.int64)
        return pa.array(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))

    return F.arrow_udf(keys, LongType())(value)


def _value_of(key: Column) -> Column:
    def values(keys: pa.Array) -> pa.Array:
        bits = keys.to_numpy()
        return pa.array(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).view(np.float64))

    return F.arrow_udf(values, DoubleType())(key)


def exact_quantiles(df: DataFrame, value: str, shares, by=()) -> DataFrame:
    """Linearly interpolated quantiles, exact at any size: keys, ``share`` and ``quantile``.

    A value is a whole number of four digits of 16 bits that sorts as it does. Each of four passes counts the values by one
    digit more, and only below the digits that hold a wanted rank: nothing is sorted, and what is shuffled
    is at most 65,536 counts for each group and wanted rank, whatever the number of different values. The
    table is read four times, two columns of it. ``by`` should name few groups; null is a group of its own.
    """
    spark, by = df.sparkSession, list(by)
    place = scratch_path(spark, "quantiles")
    names = [f"_by{i}" for i in range(len(by))]
    keyed = df.where(F.col(value).isNotNull()).select(
        *[F.col(c).alias(n) for c, n in zip(by, names)], _order_key(F.col(value).cast("double")).alias("_key"))

    def saved(table: DataFrame, name: str) -> DataFrame:
        table.write.parquet(f"{place}/{name}")
        return spark.read.schema(table.schema).parquet(f"{place}/{name}")

    def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
        """Join on keys that may be null."""
        marked = right.select(*[F.col(c).alias(f"{c}_") if c in keys else F.col(c) for c in right.columns])
        same = F.lit(True)
        for c in keys:
            same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
        both = left.join(F.broadcast(marked) if not by else marked, same, how)
        return both if how == "left_semi" else both.drop(*[f"{c}_" for c in keys])

    wanted = None
    for turn, shift in enumerate(range(64 - DIGIT, -1, -DIGIT)):
        rows, group = keyed, list(names)
        if wanted is None:
            rows = rows.withColumn("_above", F.lit(0).cast("long"))
        else:
            rows = rows.withColumn("_above", F.shiftright("_key", shift + DIGIT))
            rows = joined(rows, wanted.select(*names, "_above").distinct(), [*names, "_above"], "left_semi")
        counted = rows.groupBy(*names, "_above", F.shiftright("_key", shift).alias("_digits")).agg(F.count("*").alias("_n"))
        order = Window.partitionBy(*names, "_above").orderBy("_digits")
        counts = saved(counted, f"counts-{turn}").withColumn("_before", F.coalesce(F.sum("_n").over(
            order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        if wanted is None:
            rank = F.col("share") * (F.col("_total") - 1)
            totals = counts.groupBy(*names).agg(F.sum("_n").alias("_total")).select(
                *names, "_total", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
            wanted = totals.select(*names, "share", (rank - F.floor(rank)).alias("_part"), F.inline(F.array(
                F.struct(F.lit(False).alias("_high"), F.floor(rank).alias("_rank")),
                F.struct(F.lit(True).alias("_high"), F.ceil(rank).alias("_rank"))))).withColumn("_above", F.lit(0).cast("long"))
        inside = (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n"))
        found = joined(counts, wanted, [*names, "_above"]).where(inside)
        wanted = saved(found.select(*names, "share", "_part", "_high", (F.col("_rank") - F.col("_before")).alias("_rank"),
                                    F.col("_digits").alias("_above")), f"wanted-{turn}")
    ends = wanted.groupBy(*names, "share", "_part").agg(
        F.max(F.when(~F.col("_high"), F.col("_above"))).alias("_low"), F.max(F.when(F.col("_high"), F.col("_above"))).alias("_top"))
    low, top = _value_of(F.col("_low")), _value_of(F.col("_top"))
    return ends.select(*[F.col(n).alias(c) for n, c in zip(names, by)], "share",
                       F.when(F.col("_part") == 0, low).otherwise(low + (top - low) * F.col("_part")).alias("quantile"))


def with_positions(df: DataFrame, *order: str, out: str = "position", partitions: int | None = None) -> tuple[DataFrame, int]:
    """Rows with their global 0-based position in the order of some columns, and how many rows there are.

    Rows are dealt by ranges of the order, sorted in their range and stored with their place in it; a running
    total over the ranges, one row each, gives the positions. The order may be of any type; equal rows take
    neighbouring positions in any order. The table is read twice, the first time for the bounds of the ranges.
    """
    spark = df.sparkSession
    place = scratch_path(spark, "positions")
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    # The id counts the rows of a task in its lower 33 bits, in their order.
    ranged.select("*", F.spark_partition_id().cast("long").alias("_part"), F.monotonically_increasing_id().bitwiseAND(
        F.lit((1 << 33) - 1)).alias("_at")).write.parquet(place)
    names = StructType([*df.schema.fields, StructField("_part", LongType()), StructField("_at", LongType())])
    stored = spark.read.schema(names).parquet(place)
    sizes = stored.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    # One row for each partition that was written.
    found = stored.join(F.broadcast(starts), "_part")
    return found.select(*df.columns, (F.col("_start") + F.col("_at")).alias(out)), total


#: Rounds of a permutation, and the prime moduli of its round function (squares stay below 2**63).
ROUNDS = 4
PRIMES = (2147483647, 2147483629)


def round_constants(seed: int) -> list[tuple[int, int]]:
    """(factor, summand) of each round."""
    found, state = [], seed & ((1 << 64) - 1)
    for _ in range(ROUNDS):
        pair = []
        for _ in range(2):
            state = (state * 6364136223846793005 + 1442695040888963407) & ((1 << 64) - 1)
            pair.append((state >> 33) % (PRIMES[0] - 1) + 1)
        found.append((pair[0], pair[1]))
    return found


def sides(n: int) -> tuple[int, int]:
    """Width and height of the smallest near-square that holds ``n`` places."""
    width = math.isqrt(max(n - 1, 0)) + 1
    return width, -(-max(n, 1) // width)


def permuted(position, n: int, seed: int) -> Column:
    """Place of a position of ``0 .. n-1`` in a repeatable permutation keyed by ``seed``.

    A Feistel network over the two halves of a position; what it sends to the few places of its near-square
    past ``n`` goes through it again until it is back. No rows move and no permutation is stored.
    """
    width, height = sides(n)
    constants = round_constants(seed)

    def mixed(x, factor, summand):
        first = (x * factor + summand) % PRIMES[0]
        return (first * first) % PRIMES[1]

    def once(value):
        left, right = F.floor(value / height).cast("long"), value % height
        for turn, (factor, summand) in enumerate(constants):
            if turn % 2:
                right = (right + mixed(left, factor, summand)) % height
            else:
                left = (left + mixed(right, factor, summand)) % width
            pair = F.struct(left.alias("l"), right.alias("r"))
            left, right = pair["l"], pair["r"]
        return left * height + right

    start = F.col(position) if isinstance(position, str) else position
    turns = F.sequence(F.lit(1), F.lit(64))
    return F.aggregate(turns, F.lit(-1).cast("long"), lambda value, turn: F.when(
        (value >= 0) & (value < n), value).otherwise(once(F.when(turn == 1, start.cast("long")).otherwise(value))))
