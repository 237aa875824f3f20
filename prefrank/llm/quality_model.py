"""Quality classifier: histogram gradient-boosted trees over statistics of a text.

Trees are grown level by level from histograms of binned statistics and kept as complete
binary trees in three arrays, so that a batch of documents walks all trees at once with one
numpy step for each level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefrank.llm.labelled import training_rows
from prefrank.llm.scratch import small_batches, tidy
from prefrank.llm.words import Words, slices

#: Bound of the fit: documents learned from.
MAX_DOCUMENTS = 60_000
GOOD_FROM = 0.5

STATISTICS = (
    "log_chars", "log_words", "word_length", "words_a_line", "log_lines", "space_share", "upper_share", "digit_share",
    "non_ascii_share", "symbol_share", "bang_share", "pipe_share", "stop_share", "comma_share", "other_share",
    "distinct_words", "same_as_previous", "top_word", "repeated_pairs", "repeated_five", "odd_ends", "upper_words",
    "short_lines", "ended_lines", "repeated_lines",
)

_GROUPS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&<>~^@_=+{}[]\\", "bang": b"!?",
    "pipe": b"|", "stop": b".", "comma": b",;:", "space": b" \t\r\n\x0b\x0c", "line": b"\n",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
}
_GROUP = np.full(256, len(_GROUPS) + 1, np.uint8)
for _i, _bytes in enumerate(_GROUPS.values()):
    _GROUP[list(_bytes)] = _i
_GROUP[ord("\n")] = list(_GROUPS).index("line")
_GROUP[0x80:] = len(_GROUPS)
_KIND = {name: i for i, name in enumerate([*_GROUPS, "wide", "other"])}


def _repeated(doc: np.ndarray, code: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: distinct codes, occurrences of codes that occur again, and the most frequent code's count."""
    order = np.lexsort((code, doc))
    doc, code = doc[order], code[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])]) if len(doc) else np.zeros(0, int)
    count, owner = np.diff(np.r_[new, len(doc)]), doc[new]
    top = np.zeros(docs, np.int64)
    np.maximum.at(top, owner, count)
    return (np.bincount(owner, minlength=docs),
            np.bincount(owner, weights=np.where(count > 1, count, 0), minlength=docs), top)


def statistics(part: pa.Array) -> np.ndarray:
    """(texts x STATISTICS) of a batch; shares of an empty text are 0."""
    words = Words(part)
    docs, data, offsets = words.docs, words.data, words.offsets
    size = np.diff(offsets)
    owner = np.repeat(np.arange(docs), size)
    kinds = np.bincount(owner * len(_KIND) + _GROUP[data], minlength=docs * len(_KIND)).reshape(docs, len(_KIND))
    chars = np.maximum(1, size)
    n = np.diff(words.bounds)
    many = np.maximum(1, n)
    per_char = lambda name: kinds[:, _KIND[name]] / chars

    distinct, _, top = _repeated(words.doc, words.hash, docs)
    same_doc = words.doc[1:] == words.doc[:-1] if len(words.doc) else np.zeros(0, bool)
    previous = np.bincount(words.doc[1:][same_doc & (words.hash[1:] == words.hash[:-1])], minlength=docs)
    at, pair = words.shingles(2)
    _, pairs, _ = _repeated(words.doc[at], pair, docs)
    at, five = words.shingles(5)
    _, fives, _ = _repeated(words.doc[at], five, docs)

    padded = np.r_[data, np.uint8(10)]
    following = _GROUP[padded[words.last]] if len(words.last) else np.zeros(0, np.uint8)
    odd = np.isin(following, [_KIND["symbol"], _KIND["bang"], _KIND["pipe"], _KIND["other"]])
    odd_ends = np.bincount(words.doc[odd], minlength=docs)
    caps = (_GROUP[data[words.first]] == _KIND["upper"]) & (_GROUP[data[words.last - 1]] == _KIND["upper"]) & (
        words.last - words.first > 1) if len(words.first) else np.zeros(0, bool)
    upper_words = np.bincount(words.doc[caps], minlength=docs)

    # Lines: newline bytes and the end of each text close one; lines without a word do not count.
    breaks = np.cumsum(data == 10) if len(data) else np.zeros(0, np.int64)
    mark = breaks[words.first] if len(words.first) else np.zeros(0, np.int64)
    new = np.flatnonzero(np.r_[True, (mark[1:] != mark[:-1]) | ~same_doc]) if len(mark) else np.zeros(0, np.int64)
    line_doc, line_words = words.doc[new], np.diff(np.r_[new, len(mark)])
    lines = np.bincount(line_doc, minlength=docs)
    last_word = np.r_[new[1:], len(mark)] - 1 if len(new) else new
    ended = np.isin(padded[words.last[last_word]], list(b".!?")) if len(new) else np.zeros(0, bool)
    code = np.add.reduceat(words.hash * (np.arange(len(mark)).astype(np.uint64) - np.repeat(
        new, line_words).astype(np.uint64) + np.uint64(1)), new) if len(new) else np.zeros(0, np.uint64)
    _, again, _ = _repeated(line_doc, code, docs)
    of_lines = lambda mask: np.bincount(line_doc[mask], minlength=docs) / np.maximum(1, lines)
    letters = np.bincount(words.doc, weights=words.last - words.first, minlength=docs)
    return np.stack([
        np.log1p(size), np.log1p(n), letters / many, n / np.maximum(1, lines), np.log1p(lines), per_char("space"),
        per_char("upper"), per_char("digit"), per_char("wide"), per_char("symbol"), per_char("bang"), per_char("pipe"),
        per_char("stop"), per_char("comma"), per_char("other"), distinct / many, previous / many, top / many,
        pairs / many, fives / many, odd_ends / many, upper_words / many, of_lines(line_words < 5), of_lines(ended),
        again / np.maximum(1, lines),
    ], axis=1)


@dataclass
class Trees:
    """Complete trees of one depth: ``feature`` and ``cut`` of inner nodes, ``value`` of leaves, one row a tree."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        if not len(self.feature):
            return np.full(len(x), 1 / (1 + np.exp(-self.bias)))
        trees, inner = self.feature.shape
        node = np.zeros((len(x), trees), np.int64)
        base, row = np.arange(trees) * inner, np.arange(len(x))[:, None]
        feature, cut = self.feature.ravel(), self.cut.ravel()
        for _ in range(int(np.log2(inner + 1))):
            at = base + node
            node = 2 * node + 1 + (x[row, feature[at]] > cut[at])
        leaf = node - inner + np.arange(trees) * self.value.shape[1]
        return 1 / (1 + np.exp(-(self.bias + self.value.ravel()[leaf].sum(1))))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
         least: int = 20, shrink: float = 1.0) -> Trees:
    """Boost logistic loss; a split needs ``least`` rows on both sides, a node without one sends all rows left."""
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    coded = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    columns = x.shape[1]
    mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    bias = float(np.log(mean / (1 - mean)))
    inner = 2 ** depth - 1
    feature = np.zeros((trees, inner), np.int64)
    cut = np.full((trees, inner), np.inf)
    value = np.zeros((trees, inner + 1))
    margin = np.full(len(y), bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, curve = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            place = (node - first) * bins
            g, h, n = (np.stack([np.bincount(place + coded[:, f], weights=w, minlength=width * bins).reshape(
                width, bins).cumsum(1) for f in range(columns)]) for w in (gradient, curve, None))
            gain = g ** 2 / (h + shrink) + (g[..., -1:] - g) ** 2 / (h[..., -1:] - h + shrink) - (
                g[..., -1:] ** 2 / (h[..., -1:] + shrink))
            gain[(n < least) | (n[..., -1:] - n < least)] = 0
            best = gain.transpose(1, 0, 2).reshape(width, -1)
            pick = best.argmax(1)
            good = best[np.arange(width), pick] > 1e-6
            f, b = pick // bins, pick % bins
            for k in np.flatnonzero(good):
                feature[t, first + k], cut[t, first + k] = f[k], edges[f[k]][b[k]]
            k = node - first
            node = 2 * node + 1 + (good[k] & (coded[np.arange(len(y)), f[k]] > b[k]))
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, weights=gradient, minlength=inner + 1) / (
            np.bincount(leaf, weights=curve, minlength=inner + 1) + shrink)
        margin += value[t][leaf]
    return Trees(feature, cut, value, bias)


def text_statistics():
    """The UDF, made when a session is there."""

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        rows = np.concatenate([np.zeros((0, len(STATISTICS))), *(statistics(part) for part in slices(texts))])
        offsets = np.arange(0, rows.size + 1, len(STATISTICS))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(rows.ravel()))

    return run


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_documents: int = MAX_DOCUMENTS) -> Trees:
    """Learn from at most about ``max_documents`` labelled documents; without labels every score is 0.5."""
    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, label, max_documents).select("y", text_statistics()("text").alias("x")).toArrow()
    y = rows.column("y").to_numpy().astype(float)
    none = np.zeros((0, 2 ** 1 - 1))
    if not len(y):
        return Trees(none.astype(int), none, none, 0.0)
    x = np.concatenate([np.asarray(chunk.flatten()) for chunk in rows.column("x").chunks]).reshape(len(y), -1)
    order = np.lexsort((*x.T, y))  # the same trees whatever order the rows came in
    return grow(x[order], y[order])


def score_quality(docs: DataFrame, model: Trees, text: str = "text", threshold: float = GOOD_FROM) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from ``threshold``).

    Null and empty texts are scored by their statistics, all 0. Columns with the added names are
    replaced, others pass through.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(model.score(statistics(part)) for part in slices(texts))]))

    rows = tidy(docs, "score", "predicted")
    scored = rows.withColumn("_score", score(F.col(text)))
    return scored.select(*rows.columns, F.col("_score").alias("score"),
                         (F.col("_score") >= threshold).cast("int").alias("predicted"))
