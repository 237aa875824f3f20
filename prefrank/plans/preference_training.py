"""Training of a fusion head on the combined preference loss.

The objective of a batch is ``w * mean smoothed cross-entropy + (1 - w) * mean margin ranking``,
the second mean over the rows that are no ties. Every evaluation is one pass: each partition sums the
loss and the gradient of its rows in numpy, partial sums meet in a tree, and the driver holds
parameters alone. Rows are stored once as narrow vectors, split into the mini-batches of an epoch.

Two ways to fit: `train` runs epochs of mini-batch steps (decoupled weight decay, warm-up and
cosine schedule, clipped gradients) with validation, early stopping and resumable checkpoints;
`minimize` takes the whole table for every step and converges (quasi-Newton with line search).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefrank import fixed_values as fixed
from prefrank.functions.scoring import FusionHead, fusion_logits, softmax
from prefrank.operators import dataset, metrics, runs
from prefrank.plans.scoring import TEXT_COLUMNS, prepare
from prefrank.schemas import TRAINING_HISTORY
from prefrank.session import reliable_checkpoint, scratch_path
from prefrank.sources.reports import load_rules, write_settings
from prefrank.sources.tables import path_exists, read_training_history

#: Partial sums that meet in one task.
FAN_IN = 32


@dataclass(frozen=True)
class Objective:
    """Weights of the loss; ``l2`` is added to the weights but not to the biases."""

    cls_weight: float = fixed.CLASSIFICATION_WEIGHT
    smoothing: float = fixed.LABEL_SMOOTHING
    margin: float = fixed.RANKING_MARGIN
    l2: float = 0.0


@dataclass(frozen=True)
class Schedule:
    """How an epoch run goes."""

    epochs: int = fixed.EPOCHS
    steps: int = 8
    learning_rate: float = 1e-2
    warmup: float = fixed.WARMUP_SHARE
    weight_decay: float = fixed.WEIGHT_DECAY
    clip: float = 1.0
    patience: int = fixed.PATIENCE
    seed: int = 42

    def rate(self, step: int) -> float:
        """Linear warm-up, then half a cosine down to 0 over all steps."""
        total = self.epochs * self.steps
        warm = int(self.warmup * total)
        if step < warm:
            return self.learning_rate * step / warm
        return self.learning_rate * 0.5 * (1.0 + math.cos(math.pi * (step - warm) / max(1, total - warm)))


class Shape:
    """Places of a head's parameters in one vector."""

    def __init__(self, embedding_dim: int, aux_dim: int, classes: int = fixed.NUM_CLASSES):
        self.embedding_dim, self.aux_dim, self.classes = embedding_dim, aux_dim, classes
        width = embedding_dim + aux_dim
        self.parts = [(aux_dim, aux_dim), (aux_dim,), (classes, width), (classes,)]
        self.size = sum(math.prod(p) for p in self.parts)
        self.decays = np.concatenate([np.full(math.prod(p), float(len(p) == 2)) for p in self.parts])

    def split(self, vector: np.ndarray) -> list[np.ndarray]:
        """Projection, its bias, classifier, its bias; views of the vector."""
        found, at = [], 0
        for part in self.parts:
            n = math.prod(part)
            found.append(vector[at:at + n].reshape(part))
            at += n
        return found

    def start(self, seed: int) -> np.ndarray:
        """Uniform weights within one over the root of the inputs, as linear layers usually begin."""
        rng = np.random.default_rng(seed)
        widths = (self.aux_dim, self.aux_dim, self.embedding_dim + self.aux_dim, self.embedding_dim + self.aux_dim)
        return np.concatenate([rng.uniform(-1, 1, math.prod(p)) / math.sqrt(max(w, 1)) for p, w in zip(self.parts, widths)])

    def head(self, vector: np.ndarray, mean: np.ndarray | None = None, deviation: np.ndarray | None = None) -> FusionHead:
        """The head of a vector; inputs that were standardised for it are folded into its weights."""
        projection, bias, classifier, offset = (p.copy() for p in self.split(vector))
        if mean is not None:
            e = self.embedding_dim
            classifier[:, :e] /= deviation[:e]
            offset -= classifier[:, :e] @ mean[:e]
            projection /= deviation[e:]
            bias -= projection @ mean[e:]
        return FusionHead(projection.tolist(), bias.tolist(), classifier.tolist(), offset.tolist())

    def vector(self, head: FusionHead) -> np.ndarray:
        return np.concatenate([np.asarray(p, float).ravel() for p in (
            head.projection, head.projection_bias, head.classifier, head.classifier_bias)])


def forward(shape: Shape, vector: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hidden layer, logits, probabilities) of rows of inputs (embedding, then auxiliary)."""
    projection, bias, classifier, offset = shape.split(vector)
    hidden = np.maximum(x[:, shape.embedding_dim:] @ projection.T + bias, 0.0)
    logits = np.hstack([x[:, :shape.embedding_dim], hidden]) @ classifier.T + offset
    powers = np.exp(logits - logits.max(1, keepdims=True))
    return hidden, logits, powers / powers.sum(1, keepdims=True)


def batch_sums(shape: Shape, vector: np.ndarray, x: np.ndarray, label: np.ndarray, smoothing: float,
               margin: float) -> np.ndarray:
    """Sums over rows: rows, non-ties, both losses, and the gradient of each (two vectors of the shape's size)."""
    hidden, logits, p = forward(shape, vector, x)
    target = np.full(p.shape, smoothing / shape.classes)
    target[np.arange(len(x)), label] += 1.0 - smoothing
    peak = logits.max(1, keepdims=True)
    log_p = logits - peak - np.log(np.exp(logits - peak).sum(1, keepdims=True))
    decided = label != 2
    sign = np.where(label == 0, 1.0, -1.0)
    short = np.where(decided, margin - sign * (p[:, 0] - p[:, 1]), 0.0)
    push = np.where(short > 0, -sign, 0.0)
    # Through the softmax: p_k * (d_k - sum_j p_j d_j) with d = (push, -push, 0).
    inner = push * (p[:, 0] - p[:, 1])
    ranked = -p * inner[:, None]
    ranked[:, 0] += p[:, 0] * push
    ranked[:, 1] -= p[:, 1] * push
    e, (projection, _, classifier, _) = shape.embedding_dim, shape.split(vector)
    wide = np.hstack([x[:, :e], hidden])
    sums = [np.array([len(x), decided.sum(), -(target * log_p).sum(), np.maximum(short, 0.0).sum()])]
    for d in (p - target, ranked):
        back = (d @ classifier[:, e:]) * (hidden > 0)
        sums += [(back.T @ x[:, e:]).ravel(), back.sum(0), (d.T @ wide).ravel(), d.sum(0)]
    return np.concatenate(sums)


def combine(shape: Shape, sums: np.ndarray, vector: np.ndarray, objective: Objective) -> tuple[dict, np.ndarray]:
    """(losses, gradient of the objective) from the sums of a batch; without non-ties the ranking part is 0."""
    rows, decided = max(sums[0], 1.0), max(sums[1], 1.0)
    weights = shape.decays * vector
    losses = {"cls_loss": float(sums[2] / rows), "rank_loss": float(sums[3] / decided)}
    a, b = objective.cls_weight, 1.0 - objective.cls_weight
    losses["loss"] = a * losses["cls_loss"] + b * losses["rank_loss"]
    classes, ranks = sums[4:4 + shape.size], sums[4 + shape.size:]
    gradient = a * classes / rows + b * ranks / decided + objective.l2 * weights
    losses["penalised"] = losses["loss"] + 0.5 * objective.l2 * float(weights @ vector)
    return losses, gradient


def _rows(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return x, batch.column("label").to_numpy().astype(np.int64)


def _pass(rows: DataFrame, width: int, part: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum of ``part(x, label)`` over all rows: within partitions, then in a tree of `FAN_IN` sums a task."""

    def summed(values: Callable[[pa.RecordBatch], np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros(size), False
            for batch in batches:
                if batch.num_rows:
                    total += values(batch)
                    seen = True
            if seen:
                yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

        return run

    merge = summed(lambda batch: batch.column("sums").flatten().to_numpy().reshape(-1, size).sum(0))
    partial = rows.select("x", "label").mapInArrow(
        summed(lambda batch: part(*_rows(batch, width))), "sums array<double>")
    pieces = rows.rdd.getNumPartitions()
    while pieces > FAN_IN:
        pieces = -(-pieces // FAN_IN)
        partial = partial.repartition(pieces).mapInArrow(merge, "sums array<double>")
    return np.sum([np.zeros(size), *(np.array(r["sums"]) for r in partial.collect())], axis=0)


class TrainingRows:
    """Stored rows (label, x as doubles) of labelled triples, with the moments of their inputs.

    ``step`` numbers the mini-batch that a row belongs to; a row's place depends on its key and the seed only.
    """

    def __init__(self, spark: SparkSession, path: str, shape: Shape):
        self.spark, self.path, self.shape = spark, path, shape
        self.width = shape.embedding_dim + shape.aux_dim
        self._moments: tuple[np.ndarray, np.ndarray] | None = None

    def rows(self, step: int | None = None) -> DataFrame:
        table = self.spark.read.schema("label int, x array<double>, step int").parquet(self.path)
        return table if step is None else table.where(F.col("step") == step)

    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation of every input; 1 for inputs that never change."""
        if self._moments is None:
            def total(x, _):
                return np.concatenate([[len(x)], x.sum(0)])

            def spread(mean):
                return lambda x, _: ((x - mean) ** 2).sum(0)

            sums = _pass(self.rows(), self.width, total, self.width + 1)
            if not sums[0]:
                raise ValueError("no labelled rows to train on")
            mean = sums[1:] / sums[0]
            deviation = np.sqrt(_pass(self.rows(), self.width, spread(mean), self.width) / sums[0])
            self._moments = mean, np.where(deviation > 1e-12, deviation, 1.0)
        return self._moments

    def sums(self, vector: np.ndarray, objective: Objective, step: int | None = None) -> np.ndarray:
        shape, (mean, deviation) = self.shape, self.moments()
        smoothing, margin = objective.smoothing, objective.margin

        def part(x: np.ndarray, label: np.ndarray) -> np.ndarray:
            return batch_sums(shape, vector, (x - mean) / deviation, label, smoothing, margin)

        return _pass(self.rows(step), self.width, part, 4 + 2 * shape.size)


def training_rows(triples: DataFrame, path: str | None = None, embedding: str | None = None, hidden: bool = True,
                  key: str = "conversation_id", steps: int = 1, seed: int = 42, check_pii: bool = False) -> TrainingRows:
    """Store labelled, redacted triples as training rows.

    Unlabelled rows and rows that are blank after redaction are left out, as in evaluation; so are rows
    without an embedding, when one is asked for. With ``hidden`` the auxiliary features go through the head's
    hidden layer, otherwise they lead to the classes directly (the loss without ranking is then convex).
    ``check_pii`` refuses a table with personal data (`PiiFound`) where it would be redacted.
    """
    spark = triples.sparkSession
    path = path or scratch_path(spark, "training-rows")
    if check_pii:
        triples = dataset.pii_gate(triples, TEXT_COLUMNS)
    ready = prepare(metrics.labelled(triples)).where(~F.col("rejected"))
    x = F.col("x_aux").cast("array<double>")
    if embedding:
        ready = ready.where(F.col(embedding).isNotNull())
        x = F.concat(F.col(embedding).cast("array<double>"), x)
    step = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(steps)).cast("int")
    # Rows of one step share files of a good size, so that a step reads its own files only.
    vectors = ready.select(F.col("label").cast("int").alias("label"), x.alias("x"), step.alias("step"))
    vectors.hint("rebalance", "step").write.mode("overwrite").partitionBy("step").parquet(path)
    first = spark.read.schema("label int, x array<double>, step int").parquet(path).select(F.size("x").alias("n")).first()
    width = first["n"] if first else fixed.AUX_DIM
    aux = fixed.AUX_DIM if hidden else 0
    return TrainingRows(spark, path, Shape(width - aux, aux))


def objective_value(rows: TrainingRows, head: FusionHead, objective: Objective = Objective()) -> dict:
    """Losses of a head over all stored rows."""
    plain = TrainingRows(rows.spark, rows.path, rows.shape)
    plain._moments = np.zeros(rows.width), np.ones(rows.width)
    vector = rows.shape.vector(head)
    return combine(rows.shape, plain.sums(vector, objective), vector, objective)[0]


def minimize(rows: TrainingRows, objective: Objective = Objective(), max_iter: int = 60, tolerance: float = 1e-6,
             memory: int = 10, seed: int = 42) -> tuple[FusionHead, list[dict]]:
    """Head at a minimum over all rows, and the losses of every accepted step.

    Limited-memory quasi-Newton steps, each tried at full length first and halved until the
    objective falls enough. Ends when no entry of the gradient exceeds ``tolerance``.
    """
    shape = rows.shape
    vector = shape.start(seed) if shape.aux_dim else np.zeros(shape.size)

    def value(at: np.ndarray) -> tuple[dict, np.ndarray]:
        return combine(shape, rows.sums(at, objective), at, objective)

    losses, gradient = value(vector)
    history, pairs = [losses], []
    for _ in range(max_iter):
        if np.abs(gradient).max() <= tolerance:
            break
        direction, scales = -gradient, []
        for s, y in reversed(pairs):
            scales.append((s @ direction) / (s @ y))
            direction = direction - scales[-1] * y
        if pairs:
            s, y = pairs[-1]
            direction = direction * (s @ y) / (y @ y)
        for (s, y), scale in zip(pairs, reversed(scales)):
            direction = direction + s * (scale - (y @ direction) / (s @ y))
        slope = float(gradient @ direction)
        length = 1.0 if pairs else min(1.0, 1.0 / np.abs(gradient).sum())
        for _ in range(20):
            step = length * direction
            tried, steeper = value(vector + step)
            if tried["penalised"] <= losses["penalised"] + 1e-4 * length * slope:
                break
            length /= 2
        else:
            break
        if step @ (steeper - gradient) > 1e-12:
            pairs = [*pairs, (step, steeper - gradient)][-memory:]
        vector, losses, gradient = vector + step, tried, steeper
        history.append(losses)
    return shape.head(vector, *rows.moments()), history


def predict(head: FusionHead, triples: DataFrame, embedding: str | None = None) -> DataFrame:
    """(label, probabilities) of labelled triples under a head, with the auxiliary features where it takes them."""
    ready = prepare(metrics.labelled(triples)).where(~F.col("rejected"))
    vector = F.col("x_aux").cast("array<double>")
    if head.aux_dim:
        logits = fusion_logits(head, embedding and F.col(embedding).cast("array<double>"), vector)
    else:
        parts = F.concat(F.col(embedding).cast("array<double>"), vector) if embedding else vector
        logits = fusion_logits(head, parts)
    return ready.select("label", softmax(logits).alias("probabilities"))


def predict_rows(head: FusionHead, rows: TrainingRows) -> DataFrame:
    """(label, probabilities) of stored rows: validation without reading texts again."""
    shape, width = rows.shape, rows.width
    vector = shape.vector(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, label = _rows(batch, width)
            p = forward(shape, vector, x)[2]
            yield pa.record_batch([pa.array(label, pa.int32()), pa.FixedSizeListArray.from_arrays(
                pa.array(p.ravel()), shape.classes).cast(pa.list_(pa.float64()))], names=["label", "probabilities"])

    return rows.rows().select("x", "label").mapInArrow(run, "label int, probabilities array<double>")


@dataclass
class Checkpoint:
    """What a run goes on from: parameters, moments of the optimiser, steps taken, epochs done."""

    vector: np.ndarray
    first: np.ndarray
    second: np.ndarray
    step: int = 0
    epochs: int = 0

    def save(self, spark: SparkSession, path: str) -> None:
        state = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()}
        write_settings(spark, state, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Checkpoint:
        state = load_rules(spark, path)
        return cls(*(np.array(state[k]) for k in ("vector", "first", "second")), state["step"], state["epochs"])


def _step(at: Checkpoint, gradient: np.ndarray, schedule: Schedule) -> None:
    """One update: clipped gradient, running moments, weight decay apart from them."""
    norm = float(np.linalg.norm(gradient))
    gradient = gradient * min(1.0, schedule.clip / (norm + 1e-6))
    rate = schedule.rate(at.step)
    at.step += 1
    at.first = 0.9 * at.first + 0.1 * gradient
    at.second = 0.999 * at.second + 0.001 * gradient ** 2
    root = np.sqrt(at.second / (1 - 0.999 ** at.step)) + 1e-8
    at.vector = at.vector * (1 - rate * schedule.weight_decay)
    at.vector = at.vector - rate * (at.first / (1 - 0.9 ** at.step)) / root


def train(rows: TrainingRows, path: str, run_id: str, held_out: TrainingRows | None = None,
          objective: Objective = Objective(), schedule: Schedule = Schedule()) -> FusionHead:
    """Run epochs of mini-batch steps; returns the best head, or the last one without rows held out.

    Every epoch is validated on ``held_out``. Below ``path``:
    the history of all runs, one row per epoch with the epoch's losses (mean of its steps' means) and
    the validation metrics; and for each run a checkpoint per epoch. Early stopping reads the history. A run
    that was broken off goes on after the last epoch of its history when it is called again, an epoch in
    between is repeated and overwrites what it left: the result is that of an unbroken run.
    """
    spark, shape = rows.spark, rows.shape
    mean, deviation = rows.moments()
    place, history = f"{path}/{run_id}", f"{path}/history"
    past = run_history(spark, path, run_id)
    done = past.agg(F.max("epoch")).first()[0] if past is not None else None
    if done is None:
        at = Checkpoint(shape.start(schedule.seed), np.zeros(shape.size), np.zeros(shape.size))
    else:
        at = Checkpoint.load(spark, f"{place}/epoch-{done:04d}")
    while at.epochs < schedule.epochs and not (past is not None and held_out is not None and _stopped(past, schedule)):
        means = []
        for k in np.random.default_rng([schedule.seed, at.epochs]).permutation(schedule.steps).tolist():
            sums = rows.sums(at.vector, objective, k)
            if sums[0]:
                losses, gradient = combine(shape, sums, at.vector, objective)
                _step(at, gradient, schedule)
                means.append(losses)
        if not means:
            raise ValueError("no labelled rows to train on")
        epoch, at.epochs = at.epochs, at.epochs + 1
        at.save(spark, f"{place}/epoch-{epoch:04d}")
        measured = {}
        if held_out is not None:
            scored = reliable_checkpoint(predict_rows(shape.head(at.vector, mean, deviation), held_out))
            measured = metrics.evaluation_metrics(scored).first().asDict()
        losses = [float(np.mean([m[k] for m in means])) for k in ("loss", "cls_loss", "rank_loss")]
        row = (run_id, epoch, *(measured.get(k) for k in ("auc", "accuracy", "log_loss")), *losses)
        spark.createDataFrame([row], TRAINING_HISTORY).coalesce(1).write.mode("overwrite").parquet(
            f"{history}/run={run_id}/at={epoch}")
        past = run_history(spark, path, run_id)
    best = None
    if held_out is not None:
        best = runs.early_stopping(past, schedule.patience).agg(F.max("best_epoch")).first()[0]
    chosen = Checkpoint.load(spark, f"{place}/epoch-{at.epochs - 1 if best is None else best:04d}")
    return shape.head(chosen.vector, mean, deviation)


def run_history(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame | None:
    """History rows of `train` below ``path``, of one run or of all; None before the first."""
    place = f"{path}/history" if run_id is None else f"{path}/history/run={run_id}"
    if not path_exists(spark, place):
        return None
    return read_training_history(spark, place)


def _stopped(history: DataFrame, schedule: Schedule) -> bool:
    return not runs.early_stopping(history, schedule.patience).where("stop_epoch is not null").isEmpty()
