"""Probabilities, winners, fusion-head logits and per-row losses."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefrank import fixed_values as fixed
from prefrank.functions.privacy import _col


def _entries(array, size: int = fixed.NUM_CLASSES) -> list[Column]:
    """The entries of a short array as plain columns.

    Spelled out instead of a lambda: this compiles into the surrounding code, and a
    lambda would evaluate shared parts such as the maximum again for every entry.
    """
    array = _col(array)
    return [F.get(array, F.lit(i)) for i in range(size)]


def _total(columns) -> Column:
    return reduce(lambda x, y: x + y, columns)


def softmax(logits) -> Column:
    """Numerically stable softmax of the class logits."""
    values = _entries(logits)
    peak = F.greatest(*values)
    exps = [F.exp(x - peak) for x in values]
    total = _total(exps)
    return F.array(*[e / total for e in exps])


def argmax(probabilities) -> Column:
    """Index of the largest entry, the first one on ties."""
    p = _col(probabilities)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def winner(probabilities) -> Column:
    """'A', 'B' or 'tie'."""
    return F.element_at(F.array(*[F.lit(w) for w in fixed.WINNERS]), argmax(probabilities) + 1)


def winner_text(winner_column, response_a, response_b) -> Column:
    """The preferred text; null on a tie."""
    w = _col(winner_column)
    return F.when(w == "A", _col(response_a)).when(w == "B", _col(response_b))


def valid_probabilities(probabilities) -> Column:
    """All entries in [0, 1] and the sum within tolerance of 1."""
    p = _col(probabilities)
    values = _entries(p)
    in_range = reduce(lambda x, y: x & y, [v.between(0.0, 1.0) for v in values])
    return F.coalesce(
        in_range & (F.size(p) == fixed.NUM_CLASSES)
        & (F.abs(_total(values) - 1) < fixed.PROBABILITY_SUM_TOLERANCE),
        F.lit(False),
    )


@dataclass(frozen=True)
class FusionHead:
    """Weights of the late-fusion head.

    ``projection`` is aux x aux, ``classifier`` is classes x (embedding + aux).
    """

    projection: list
    projection_bias: list
    classifier: list
    classifier_bias: list
    aux_dim: int = field(init=False)
    embedding_dim: int = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "aux_dim", len(self.projection))
        object.__setattr__(self, "embedding_dim", len(self.classifier[0]) - len(self.projection))


def _literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _dot(weights: Column, values: Column, start) -> Column:
    products = F.zip_with(weights, values, lambda w, v: w * v)
    return F.aggregate(products, start, lambda s, v: s + v)


def fusion_logits(head: FusionHead, embedding=None, aux=None) -> Column:
    """classifier(concat(embedding, relu(projection(aux)))).

    A missing aux vector counts as zeros behind the projection.
    """
    logits = [F.lit(float(b)) for b in head.classifier_bias]
    if embedding is not None and head.embedding_dim:
        vector = _col(embedding)
        logits = [
            _dot(_literal(row[:head.embedding_dim]), vector, start)
            for row, start in zip(head.classifier, logits)
        ]
    if aux is not None:
        vector = _col(aux)
        hidden = F.array(*[
            F.greatest(_dot(_literal(row), vector, F.lit(float(bias))), F.lit(0.0))
            for row, bias in zip(head.projection, head.projection_bias)
        ])
        # One lambda evaluation of the hidden layer serves all three classes.
        tails = F.array(*[_literal(row[head.embedding_dim:]) for row in head.classifier])
        starts = F.array(*logits)
        return F.transform(
            F.array(hidden),
            lambda h: F.zip_with(tails, starts, lambda w, s: _dot(w, h, s)),
        )[0]
    return F.array(*logits)


def smoothed_cross_entropy(logits, label, smoothing: float = fixed.LABEL_SMOOTHING,
                           classes: int = fixed.NUM_CLASSES) -> Column:
    """Row loss against a smoothed one-hot target."""
    values, label = _entries(logits, classes), _col(label)
    peak = F.greatest(*values)
    log_total = peak + F.log(_total([F.exp(x - peak) for x in values]))
    low, high = smoothing / classes, 1.0 - smoothing + smoothing / classes
    return _total([F.when(label == i, high).otherwise(low) * (log_total - x)
                   for i, x in enumerate(values)])


def margin_ranking(probabilities, label, margin: float = fixed.RANKING_MARGIN) -> Column:
    """Row loss of A against B; null for ties, which averages then skip."""
    p, label = _col(probabilities), _col(label)
    sign = F.when(label == 0, 1.0).otherwise(-1.0)
    return F.when(label != 2, F.greatest(F.lit(0.0), -sign * (p[0] - p[1]) + margin))


def row_log_loss(probabilities, label, eps: float = 2.220446049250313e-16) -> Column:
    """Multiclass log-loss of one row, clipped and renormalised."""
    clipped = [F.least(F.greatest(v, F.lit(eps)), F.lit(1.0 - eps)) for v in _entries(probabilities)]
    hit = F.get(F.array(*clipped), _col(label))
    return -F.log(hit / _total(clipped))
