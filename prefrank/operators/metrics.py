"""Evaluation of predictions: (label, probabilities) rows in, metric rows out.

Every operator takes ``by`` columns (segment, model, epoch); none means one row
for the whole table. Averages and bins use map-side partial aggregation; the
ordered parts (AUC, NDCG) collapse equal scores first and never rank raw rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, StructField, StructType

from prefrank import fixed_values as fixed
from prefrank.functions import scoring
from prefrank.operators.ordering import bucket_offsets, pieces


def labelled(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows that carry a label."""
    return df.where(F.col(label).isNotNull())


def _terms(df: DataFrame, by) -> DataFrame:
    """Per-row inputs of all averaged metrics."""
    p = F.col("probabilities")
    total = p[0] + p[1] + p[2]
    return labelled(df).select(
        *by, F.array_max(p).alias("confidence"),
        (scoring.argmax(p) == F.col("label")).cast("double").alias("correct"),
        scoring.row_log_loss(p, "label").alias("loss"),
        # Tolerance of a row counting as a distribution in the AUC.
        (F.abs(1 - total) > 1e-8 + 1e-5 * F.abs(total)).alias("off"),
    )


def _averages(df: DataFrame, by, n_bins: int = 10) -> DataFrame:
    """Every averaged metric from one pass: sums per confidence bin, then over the bins."""
    rows = _terms(df, by).withColumn("bin", _bin_index(F.col("confidence"), n_bins))
    bins = rows.groupBy(*by, "bin").agg(
        F.count("*").alias("n"), F.bool_or("off").alias("off"),
        *[F.sum(c).alias(c) for c in ("correct", "loss", "confidence")])
    mean = lambda c: F.coalesce(F.try_divide(F.sum(c), F.sum("n")), F.lit(0.0))
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("correct") - F.col("confidence"))).otherwise(0.0)
    return bins.groupBy(*by).agg(
        mean(F.col("correct")).alias("accuracy"), mean(F.col("loss")).alias("log_loss"),
        mean(F.col("confidence")).alias("preference_score_mean"), mean(gap).alias("ece"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.bool_or("off"), F.lit(False)).alias("off"))


def point_metrics(df: DataFrame, by=()) -> DataFrame:
    """Accuracy, log-loss, mean confidence and row count."""
    return _averages(df, by).drop("ece", "off")


#: Rows of predictions that a task sorts at once, and scores for each point that the cut points are taken from.
CHUNK_ROWS = 400_000
SCORES_PER_POINT = 256


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK_ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _scores(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, class and score of every probability; null comes first in the order."""
    lists = table["probabilities"].combine_chunks()
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    scores = lists.flatten().cast(pa.float64()).fill_null(-math.inf).to_numpy(zero_copy_only=False)
    return row, np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row], scores


def _cut_points(df: DataFrame, buckets: int) -> np.ndarray:
    """Approximate quantiles of all scores, from evenly spaced ones of every sorted chunk; they only balance the work."""
    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches):
            scores = np.sort(_scores(table)[2])
            step = max(1, min(SCORES_PER_POINT, len(scores) // 1024))
            yield pa.record_batch([pa.array(scores[step // 2::step])], ["score"])

    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    edges = df.select("probabilities").mapInArrow(points, "score double").agg(
        F.percentile_approx("score", shares, F.lit(8 * buckets))).first()[0]
    return np.unique(np.array(edges or [], float))


def _groups(table: pa.Table, by: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the group of each row, and a row of each group."""
    group, first = np.zeros(table.num_rows, np.int64), np.zeros(1, np.int64)
    for c in by:
        values = table[c].combine_chunks().dictionary_encode(null_encoding="encode")
        code = group * len(values.dictionary) + values.indices.to_numpy(zero_copy_only=False)
        _, first, group = np.unique(code, return_index=True, return_inverse=True)
    return group, first


def _sorted_scores(by: list[str], edges: np.ndarray, schema: pa.Schema):
    """Different scores and their counts, in order, of each group, class, side and bucket of a chunk."""
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches):
            row, of, scores = _scores(table)
            if not len(row):
                continue
            group, first = _groups(table, by)
            classes = int(of.max()) + 1
            label = table["label"].cast(pa.int64()).to_numpy()
            code = (group[row] * classes + of) * 2 + (label[row] == of)
            if code.max() < 1 << 15:
                code = code.astype(np.int16)  # sorted by digits
            order = np.argsort(code, kind="stable")
            code, scores = code[order], scores[order]
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            codes, buckets, found, counts = [], [], [], []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(code)]):
                values, n = np.unique(scores[a:b], return_counts=True)
                # Edges below a value are its bucket, so equal scores share one.
                ends = np.r_[0, np.searchsorted(values, edges, side="right"), len(values)]
                for k in np.flatnonzero(np.diff(ends)).tolist():
                    codes.append(int(code[a]))
                    buckets.append(k)
                    found.append(values[ends[k]:ends[k + 1]].tobytes())
                    counts.append(n[ends[k]:ends[k + 1]].astype(np.int64).tobytes())
            codes = np.array(codes)
            keys = table.select(by).take(pa.array(first[codes // (2 * classes)])).columns if by else []
            yield from pa.Table.from_arrays(
                [*keys, pa.array(codes // 2 % classes, pa.int32()), pa.array(buckets, pa.int32()), pa.array(codes % 2 == 1),
                 pa.array(found, pa.binary()), pa.array(counts, pa.binary())], schema=schema).to_batches()

    return sort


def _bucket_pairs(table: pa.Table) -> pa.Table:
    """Positives times negatives below them inside one bucket, ties for a half, and how many there are of each."""
    positive = table["positive"].to_numpy()
    scores, counts = table["scores"].to_pylist(), table["counts"].to_pylist()
    (high, n_high), (low, n_low) = (
        [np.frombuffer(b"".join([x for x, p in zip(column, positive) if p == side]), kind)
         for column, kind in ((scores, np.float64), (counts, np.int64))] for side in (True, False))
    order = np.argsort(low, kind="stable")
    low, below = low[order], np.r_[0, np.cumsum(n_low[order])]
    # Negatives up to the score and below it: half of their sum counts a tie for a half.
    twice = below[np.searchsorted(low, high, "left")] + below[np.searchsorted(low, high, "right")]
    columns = {"pairs": np.dot(n_high.astype(float), twice / 2), "pos": float(n_high.sum()), "neg": float(n_low.sum())}
    keys = table.slice(0, 1).drop_columns(["positive", "scores", "counts"])
    for name, value in columns.items():
        keys = keys.append_column(name, pa.array([float(value)]))
    return keys


def auc_by_class(df: DataFrame, by=(), buckets: int | None = None) -> DataFrame:
    """One-vs-rest area under the ROC curve of every class.

    Pairs are counted as positives times negatives below plus half the ties. Tasks sort their scores and
    collapse equal ones; what is shuffled, once, is a sorted run for each bucket of the score range. A bucket is
    ranked on its own and the negatives of the buckets below are added from the bucket totals. The table is read
    twice, the first time, at the call, for the cut points. ``auc`` is null when a class has no positives or no negatives.
    """
    by = list(by)
    keys = by + ["class"]
    rows = labelled(df).select(*by, "label", F.col("probabilities").cast("array<double>").alias("probabilities"))
    edges = _cut_points(rows, pieces(df, buckets))
    sides = StructType([*[rows.schema[c] for c in by], StructField("class", IntegerType()), StructField("bucket", IntegerType()),
                        StructField("positive", BooleanType()), StructField("scores", BinaryType()), StructField("counts", BinaryType())])
    totals = StructType([*sides.fields[:-3], *[StructField(c, DoubleType()) for c in ("pairs", "pos", "neg")]])
    sorted_ = rows.mapInArrow(_sorted_scores(by, edges, to_arrow_schema(sides)), sides)
    counted = sorted_.groupBy(*keys, "bucket").applyInArrow(_bucket_pairs, totals)
    linked = bucket_offsets(counted, keys, "neg", "neg_below")
    return linked.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("pairs") + F.col("pos") * F.col("neg_below")),
                     F.sum("pos") * F.sum("neg")).alias("auc"),
        F.sum("pos").cast("long").alias("positives"),
        F.sum("neg").cast("long").alias("negatives"),
    )


def _mean_auc(df: DataFrame, by, buckets: int | None) -> DataFrame:
    """Mean of the class AUCs, 0 when a class has no label."""
    mean = F.when(F.count("auc") == fixed.NUM_CLASSES, F.avg("auc")).otherwise(0.0)
    return auc_by_class(df, by, buckets).groupBy(*by).agg(mean.alias("auc"))


def _side_by_side(left: DataFrame, right: DataFrame, by) -> DataFrame:
    """Join two result tables that hold one row per group."""
    keys = list(by)
    if keys:
        return left.join(right, keys)
    # One row each: the right one comes in as scalar subqueries, no join needed.
    return left.withColumns({c: right.select(c).scalar() for c in right.columns})


def evaluation_metrics(df: DataFrame, by=(), n_bins: int = 10, buckets: int | None = None) -> DataFrame:
    """Accuracy, macro AUC, log-loss, mean confidence, calibration error and row count.

    Zeros for an empty table. The AUC is 0 when a class has no label or a row does not
    sum to 1.
    """
    both = _side_by_side(_averages(df, by, n_bins), _mean_auc(df, by, buckets), by)
    auc = F.when(F.col("off"), 0.0).otherwise(F.coalesce("auc", F.lit(0.0)))
    return both.withColumn("auc", auc).select(
        *by, "accuracy", "auc", "log_loss", "preference_score_mean", "ece", "n")


def classification_metrics(df: DataFrame, by=(), buckets: int | None = None) -> DataFrame:
    """The bundle without calibration error."""
    return evaluation_metrics(df, by, buckets=buckets).drop("ece")


def _bin_index(confidence: Column, n_bins: int) -> Column:
    """Index of the half-open bin [i/n, (i+1)/n); null for 1.0 and above."""
    width = 1.0 / n_bins
    edges = [i * width for i in range(n_bins)] + [1.0]
    above = sum(((confidence >= e).cast("int") for e in edges[1:]), F.lit(0))
    return F.when((confidence >= 0) & (confidence < edges[-1]), above)


def calibration_bins(df: DataFrame, by=(), n_bins: int = 10) -> DataFrame:
    """Count, accuracy and mean confidence per confidence bin."""
    rows = _terms(df, by).withColumn("bin", _bin_index(F.col("confidence"), n_bins))
    return rows.groupBy(*by, "bin").agg(
        F.count("*").alias("n"), F.avg("correct").alias("accuracy"),
        F.avg("confidence").alias("confidence"))


def expected_calibration_error(df: DataFrame, by=(), n_bins: int = 10) -> DataFrame:
    """Count-weighted gap between accuracy and confidence over the bins."""
    return _averages(df, by, n_bins).select(*by, "ece")


def _discounted_gain(df: DataFrame, query: str, order: str, gain: str, k: int, out: str) -> DataFrame:
    """Discounted gain of the first ``k`` ranks, ties sharing their mean gain.

    Rows collapse to (query, score); a tied group covers at least one rank, so the
    best ``k`` groups of a query always reach rank ``k``. The row_number filter lets
    Spark cut to ``k`` groups per query before the shuffle.
    """
    groups = df.groupBy(query, order).agg(F.count("*").alias("n"), F.sum(gain).alias("gain"))
    best = Window.partitionBy(query).orderBy(F.desc(order))
    top = groups.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    start = F.coalesce(
        F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Sum of the discounts 1/log2(rank + 1) up to each rank, 0 past rank k.
    steps = [0.0]
    for rank in range(1, k + 1):
        steps.append(steps[-1] + 1.0 / math.log2(rank + 1))
    table = F.array(*[F.lit(s) for s in steps])
    top = top.withColumn("first", start)
    upto = lambda c: F.element_at(table, (F.least(c, F.lit(k)) + 1).cast("int"))
    discount = upto(F.col("first") + F.col("n")) - upto(F.col("first"))
    return top.groupBy(query).agg(F.sum(F.col("gain") / F.col("n") * discount).alias(out))


def ndcg(df: DataFrame, query: str = "query_id", relevance: str = "relevance",
         score: str = "score", k: int = 10) -> DataFrame:
    """NDCG@k per query: gain in score order over gain in relevance order."""
    rows = df.select(query, F.col(relevance).cast("double").alias("relevance"),
                     F.col(score).cast("double").alias("score"))
    actual = _discounted_gain(rows, query, "score", "relevance", k, "dcg")
    ideal = _discounted_gain(rows, query, "relevance", "relevance", k, "ideal")
    ratio = F.when(F.col("ideal") == 0, 0.0).otherwise(F.col("dcg") / F.col("ideal"))
    return actual.join(ideal, query).select(query, ratio.alias("ndcg"))


def with_losses(df: DataFrame, smoothing: float = fixed.LABEL_SMOOTHING,
                margin: float = fixed.RANKING_MARGIN) -> DataFrame:
    """Add the row losses ``cls_term`` and ``rank_term`` (null for ties)."""
    return labelled(df).withColumns({
        "cls_term": scoring.smoothed_cross_entropy("logits", "label", smoothing),
        "rank_term": scoring.margin_ranking("probabilities", "label", margin),
    })


def combined_loss(df: DataFrame, by=(), cls_weight: float = fixed.CLASSIFICATION_WEIGHT,
                  smoothing: float = fixed.LABEL_SMOOTHING,
                  margin: float = fixed.RANKING_MARGIN) -> DataFrame:
    """Mean classification loss, mean ranking loss over non-ties, and their blend."""
    losses = with_losses(df, smoothing, margin).groupBy(*by).agg(
        F.avg("cls_term").alias("cls_loss"),
        F.coalesce(F.avg("rank_term"), F.lit(0.0)).alias("rank_loss"))
    total = cls_weight * F.col("cls_loss") + (1.0 - cls_weight) * F.col("rank_loss")
    return losses.select(*by, total.alias("loss"), "cls_loss", "rank_loss")


def epoch_losses(df: DataFrame, epoch: str = "epoch", batch: str = "batch", **loss) -> DataFrame:
    """Epoch loss as the mean of its batch means."""
    return combined_loss(df, [epoch, batch], **loss).groupBy(epoch).agg(
        *[F.avg(c).alias(c) for c in ("loss", "cls_loss", "rank_loss")])


def acceptance_gate(metrics: DataFrame, rules=fixed.EVALUATION_GATE, by=()) -> DataFrame:
    """One row per rule: metric, value, threshold, status ('ok', or the rule's severity)."""
    by = list(by)

    def status(metric, comparison, threshold, severity):
        value = F.col(metric)
        passed = {"min": value >= threshold, "max": value <= threshold,
                  "below": value < threshold}[comparison]
        return F.struct(F.lit(metric).alias("metric"), value.cast("double").alias("value"),
                        F.lit(float(threshold)).alias("threshold"),
                        F.when(passed, "ok").otherwise(severity).alias("status"))

    return metrics.select(*by, F.inline(F.array(*[status(*r) for r in rules])))
