"""Toxicity by multiple-instance learning: sentences are scored, documents carry the labels.

A sentence has probability p = sigmoid(bias + weights of its features), a document the
noisy-or 1 - prod(1 - p) of its sentences. Weights are learned from document labels through
the noisy-or, so no sentence label is needed, and the sentences that make a document toxic
can be pointed out. Features are words and word beginnings. A sentence without any known
feature is no evidence and has probability 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefrank.llm.labelled import training_rows
from prefrank.llm.scratch import Scratch, small_batches, tidy
from prefrank.llm.words import Words, mix, slices

#: Bounds of the fit: documents learned from, and features kept of those they hold.
MAX_DOCUMENTS = 20_000
MAX_FEATURES = 4096
#: A feature is kept when so many toxic documents hold it and its excess is so many standard errors.
LEAST_DOCUMENTS = 4
LEAST_Z = 6.0
PREFIXES = (4, 5, 6, 7, 8, 9)
TOXIC_FROM = 0.7
#: Counts of features that a task holds before it hands them on, and of one batch of them.
GATHERED = 500_000
HANDED_ON = 1 << 16

_U = np.uint64
_ENDS = np.zeros(256, bool)
_ENDS[np.frombuffer(b".!?\n", np.uint8)] = True
_TABLE = 1 << 18


class Sentences:
    """Features of a batch: ``feature`` with the word ``at`` which it is, and the sentence of each word."""

    def __init__(self, part: pa.Array):
        self.words = words = Words(part)
        breaks = np.cumsum(_ENDS[words.data]) if len(words.data) else np.zeros(0, np.int64)
        # Words with no sentence end and no text end between them share a sentence.
        mark = breaks[words.first] if len(words.first) else np.zeros(0, np.int64)
        new = np.r_[True, (mark[1:] != mark[:-1]) | (words.doc[1:] != words.doc[:-1])] if len(mark) else np.zeros(0, bool)
        self.sentence = np.cumsum(new) - 1
        self.begin = np.flatnonzero(new)  # first word of each sentence
        self.doc = words.doc[self.begin]
        feature, at = [words.hash], [np.arange(len(words.hash))]
        for size in PREFIXES:
            longer, code = words.prefix(size)
            feature.append(mix(code ^ _U(size)))
            at.append(np.flatnonzero(longer))
        self.feature, self.at = np.concatenate(feature), np.concatenate(at)


def _distinct(group: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((feature, group))
    group, feature = group[order], feature[order]
    new = np.r_[True, (group[1:] != group[:-1]) | (feature[1:] != feature[:-1])] if len(group) else np.zeros(0, bool)
    return group[new], feature[new]


def _document_counts(batches, gathered: int = GATHERED):
    """Feature, toxic documents with it, documents with it: sums over the documents of a task, as far as ``gathered`` rows hold them."""
    held, size = [], 0

    def merged() -> list[np.ndarray]:
        keys, *sums = (np.concatenate(column) for column in zip(*held))
        held.clear()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return [keys[new], *(np.add.reduceat(column[order], new) for column in sums)]

    def rows(columns: list[np.ndarray]):
        for at in range(0, len(columns[0]), HANDED_ON):
            keys, toxic, n = (column[at:at + HANDED_ON] for column in columns)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(toxic.astype(np.int64)), pa.array(n.astype(np.int64))],
                ["feature", "toxic", "n"])

    for batch in batches:
        table, y = batch.column("text"), batch.column("y").to_numpy()
        at = 0
        for part in slices(table):
            found = Sentences(part)
            doc, feature = _distinct(found.words.doc[found.at], found.feature)
            order = np.argsort(feature, kind="stable")
            feature, label = feature[order], y[at:at + len(part)][doc[order]]
            at += len(part)
            if not len(feature):
                continue
            new = np.flatnonzero(np.r_[True, feature[1:] != feature[:-1]])
            n = np.diff(np.r_[new, len(feature)]).astype(np.int32)
            held.append([feature[new], np.add.reduceat(label, new, dtype=np.int32), n])
            size += len(new)
            if size > gathered:
                held.append(merged())
                size = len(held[0][0])
                if size > gathered // 2:
                    yield from rows(held.pop())
                    size = 0
    if held:
        yield from rows(merged())


@dataclass
class Lexicon:
    """Known features in an open table: ``keys[h mod size]`` is the feature whose value stands there."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, features: np.ndarray, values: np.ndarray) -> Lexicon:
        keys, held = np.zeros(_TABLE, _U), np.zeros(_TABLE, values.dtype)
        order = np.argsort(np.abs(values), kind="stable")  # of two in one place the stronger stays
        at = (features[order] % _U(_TABLE)).astype(np.int64)
        keys[at], held[at] = features[order], values[order]
        return cls(keys, held)

    def find(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which features are known, and their values."""
        at = features & _U(_TABLE - 1)
        known = np.flatnonzero(self.keys[at] == features)
        return known, self.values[at[known]]


@dataclass
class ToxicityModel:
    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self):
        lexicon = Lexicon.of(self.features, self.weights)

        def score(part: pa.Array):
            """Sentences of a batch and the probability of each."""
            found = Sentences(part)
            known, weight = lexicon.find(found.feature)
            sentence = found.sentence[found.at[known]]
            total = np.bincount(sentence, weights=weight, minlength=len(found.begin))
            seen = np.bincount(sentence, minlength=len(found.begin)) > 0
            return found, np.where(seen, 1 / (1 + np.exp(-np.clip(self.bias + total, -30, 30))), 0.0)

        return score


def _encoded(features: np.ndarray):
    def run(batches):
        lexicon = Lexicon.of(features, np.arange(1, len(features) + 1))
        for batch in batches:
            table, y, at = batch.column("text"), batch.column("y").to_pylist(), 0
            for part in slices(table):
                found = Sentences(part)
                known, ids = lexicon.find(found.feature)
                sentence, ids = found.sentence[found.at[known]], ids - 1
                order = np.argsort(sentence, kind="stable")
                sentence, ids = sentence[order], ids[order]
                doc = found.doc[sentence]
                cuts = np.searchsorted(doc, np.arange(len(part) + 1))
                yield pa.RecordBatch.from_arrays([
                    pa.array(y[at:at + len(part)], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(sentence.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32)))],
                    ["y", "sentence", "id"])
                at += len(part)

    return run


def fit_noisy_or(y: np.ndarray, doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray, features: int,
                 steps: int = 300, rate: float = 0.1, decay: float = 1e-3,
                 positive: float = 2.0) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the noisy-or likelihood of ``y``, by Adam over all rows.

    A toxic document counts ``positive`` times, ``decay`` pulls weights to 0.

    ``doc``, ``sentence``, ``feature``: one entry for each known feature of each sentence.
    """
    w, b = np.zeros(features), -3.0
    keys, of = np.unique(np.stack([doc, sentence]), axis=1, return_inverse=True)
    bag, many = keys[0], keys.shape[1]
    m, v = np.zeros(features + 1), np.zeros(features + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(of, weights=w[feature], minlength=many)
        p = 1 / (1 + np.exp(-z))
        total = np.bincount(bag, weights=np.logaddexp(0, z), minlength=len(y))  # -log of the noisy-or's complement
        pull = np.where(y == 1, -positive / np.expm1(np.maximum(total, 1e-9)), 1.0)
        slope = pull[bag] * p / max(1, len(y))
        grad = np.r_[np.bincount(feature, weights=slope[of], minlength=features) + decay * w, slope.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_documents: int = MAX_DOCUMENTS,
                   max_features: int = MAX_FEATURES) -> ToxicityModel:
    """Learn from at most about ``max_documents`` labelled documents; without labels every score is 0.

    Spark counts features and encodes the documents; the driver receives the encoded known
    features of the bounded sample only.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sample = Scratch(spark, "toxicity").save(training_rows(docs, labels, label, max_documents), "sample")
    n, toxic = sample.agg(F.count("*"), F.sum("y")).first()
    rate = (toxic or 0) / max(1, n)
    counts = sample.mapInArrow(_document_counts, "feature long, toxic long, n long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    z = (F.col("toxic") - rate * F.col("n")) / F.sqrt(rate * (1 - rate) * F.col("n") + 1e-9)
    best = counts.where(F.col("toxic") >= LEAST_DOCUMENTS).withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(
        F.desc("z"), "feature").limit(max_features).toArrow()
    features = best.column("feature").to_numpy().view(_U)
    if not len(features):
        return ToxicityModel(features, np.zeros(0), -30.0)
    rows = sample.mapInArrow(_encoded(features), "y int, sentence array<int>, id array<int>").toArrow()
    y = rows.column("y").to_numpy()
    sizes = np.array([len(x) for x in rows.column("id")])
    flat = lambda name: np.concatenate([np.asarray(x.values.slice(x.offsets[0].as_py(), x.offsets[-1].as_py() - x.offsets[0].as_py()))  # noqa: E731,E501
                                        for x in rows.column(name).chunks] or [np.zeros(0, np.int64)])
    doc = np.repeat(np.arange(len(y)), sizes)
    weights, bias = fit_noisy_or(y, doc, flat("sentence"), flat("id"), len(features))
    return ToxicityModel(features, weights, bias)


def _scores(model: ToxicityModel, least: float):
    kind = "score:double,sentences:array<struct<start:bigint,end:bigint,score:double>>"

    @F.arrow_udf(f"struct<{kind}>")
    def score(texts: pa.Array) -> pa.Array:
        scorer, values, spans = model.scorer(), [], []
        for part in slices(texts):
            found, p = scorer(part)
            values.append(1 - np.exp(np.bincount(
                found.doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(part))))
            own: list[list[dict]] = [[] for _ in range(len(part))]
            hits = np.flatnonzero(p >= least)
            if len(hits):
                words, chars = found.words, found.words.chars()
                ends = np.r_[found.begin[1:], len(words.hash)] - 1
                for d, a, b, value in zip(found.doc[hits], words.first[found.begin[hits]], words.last[ends[hits]], p[hits]):
                    base = chars[words.offsets[d]]
                    own[d].append({"start": int(chars[a] - base), "end": int(chars[b] - base), "score": float(value)})
            spans += own
        spans_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        flat = np.concatenate(values) if values else np.zeros(0)
        return pa.StructArray.from_arrays(
            [pa.array(np.clip(flat, 0.0, 1.0)), pa.array(spans, spans_kind)], names=["score", "sentences"])

    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", least: float = 0.5,
                   threshold: float = TOXIC_FROM) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` (1 from ``threshold``) and the offending ``sentences``.

    ``sentences``: code-point spans with their own probability, from ``least``. Null and empty
    texts score 0. Columns with the added names are replaced, others pass through.
    """
    small_batches(docs.sparkSession)
    rows = tidy(docs, "score", "predicted", "sentences")
    scored = rows.withColumn("_scored", _scores(model, least)(F.col(text)))
    return scored.select(*rows.columns, F.col("_scored.score").alias("score"),
                         (F.col("_scored.score") >= threshold).cast("int").alias("predicted"),
                         F.col("_scored.sentences").alias("sentences"))
