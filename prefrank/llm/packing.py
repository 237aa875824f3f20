"""Best-fit packing of pieces into sequences, with large-item matching.

All that decides a packing is how many pieces there are of each length, at most ``capacity``
numbers however large the corpus. The driver packs these counts: pieces above a third of a
sequence are matched first, the longest with the longest partner that fits beside it; shorter
ones then go, longest first, into the smallest gap that holds them. The outcome is a list of
runs: "the pieces of length L with ranks a..b go to sequences s.. at offset o". Spark numbers
the pieces of each length and looks up their runs.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefrank.llm.scratch import Scratch, tidy

CAPACITY = 4096
#: Pieces of one length are numbered in so many independent parts.
PARTS = 1024


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first sequence, offset) that place ``counts[length]`` pieces each."""
    left = {n: c for n, c in counts.items() if c}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError(f"lengths must be 1..{capacity}")
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # free ids of a sequence -> (first sequence, how many)
    sizes: list[int] = []  # the keys of gaps in order
    sequences = 0

    def free(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, many))

    def place(length: int, first: int, many: int, offset: int) -> None:
        runs.append((length, used[length], used[length] + many, first, offset))
        used[length] += many
        left[length] -= many

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        length = large[-1]
        i = bisect_left(large, capacity - length + 1) - 1
        partner = large[i] if i >= 0 else 0
        many = left[length] // 2 if partner == length else min(left[length], left.get(partner, 0))
        if partner == length and not many:  # one piece of this length is left: look below it
            partner = large[i - 1] if i else 0
            many = min(left[length], left.get(partner, 0))
        many = many or left[length]
        place(length, sequences, many, 0)
        if partner:
            place(partner, sequences, many, length)
        free(capacity - length - partner, sequences, many)
        sequences += many
        large = [n for n in large if left[n]]

    def fill(length: int, gap: int, first: int, many: int) -> None:
        """Put pieces into ``many`` sequences with ``gap``, as many into each as fit."""
        each = min(gap // length, left[length])
        full = min(many, left[length] // each)
        for k in range(each):
            place(length, first, full, capacity - gap + k * length)
        free(gap - each * length, first, full)
        some = 0
        if full < many and left[length]:
            some = left[length]  # fewer than fill one more sequence
            for k in range(some):
                place(length, first + full, 1, capacity - gap + k * length)
            free(gap - some * length, first + full, 1)
        free(gap, first + full + (some > 0), many - full - (some > 0))

    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            i = bisect_left(sizes, length)
            if i < len(sizes):
                gap = sizes.pop(i)
                for first, many in gaps.pop(gap):
                    if left[length]:
                        fill(length, gap, first, many)
                    else:
                        free(gap, first, many)
            else:
                many = -(-left[length] // (capacity // length))
                fill(length, capacity, sequences, many)
                sequences += many
    return runs


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, parts: int = PARTS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: gapless places in sequences of ``capacity``.

    Every row is placed, repeated rows too. A length that is null or outside 1..capacity is an
    error. Columns named like the added ones are replaced; an empty table gives an empty result.
    """
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    rows = scratch.save(
        tidy(pieces, "sequence_id", "offset", "_part").withColumn("_part", (F.rand(11) * parts).cast("int")), "pieces")
    counts = scratch.save(rows.groupBy(F.col(length).cast("bigint").alias("_length"), "_part").agg(
        F.count("*").alias("_n")), "counts")
    totals = {r[0]: r[1] for r in counts.groupBy("_length").agg(F.sum("_n")).limit(capacity + 1).collect()}
    if None in totals:
        raise ValueError("lengths must not be null")
    runs = spark.createDataFrame(
        plan_runs(totals, capacity), "_length long, _first long, _end long, _sequence long, offset long")
    before = Window.partitionBy("_length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("_length", "_part").orderBy(F.lit(0))
    ranked = rows.withColumn("_length", F.col(length).cast("bigint")).withColumn(
        "_own", F.row_number().over(own) - 1).join(bases, ["_length", "_part"]).withColumn(
        "_rank", F.col("_base") + F.col("_own"))
    # The runs are bounded by the capacity, not by the corpus.
    placed = ranked.join(F.broadcast(runs), "_length").where("_rank >= _first and _rank < _end")
    return placed.select(*[c for c in rows.columns if c != "_part"],
                         (F.col("_sequence") + F.col("_rank") - F.col("_first")).alias("sequence_id"), "offset")
