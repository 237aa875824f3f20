"""Exact similarity of texts by their five-word shingles, for pairs and for blocks of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from prefrank.llm.words import Words, slices

THRESHOLD = 0.8


def weighted_shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of each distinct shingle of each text, in this order."""
    at, shingle = words.shingles()
    doc = words.doc[at]
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])]) if len(doc) else at
    return doc[new], shingle[new], 1.0 + np.log(np.diff(np.r_[new, len(doc)]))


def bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct shingles and their weights, for each text."""
    out = []
    for part in slices(texts):
        doc, shingle, weight = weighted_shingles(Words(part))
        at = np.searchsorted(doc, np.arange(len(part) + 1))
        out += [(shingle[i:j], weight[i:j]) for i, j in zip(at, at[1:])]
    return out


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray],
                        i: np.ndarray, j: np.ndarray) -> float:
    """Sum over shared elements k of 1 / sum_l max(a_l / a_k, b_l / b_k); ``i``, ``j`` are their places."""
    x, y = a[1][i], b[1][j]
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    above = a[1].sum() - x.sum() + np.r_[np.cumsum(x[::-1])[::-1], 0.0]
    below = b[1].sum() - y.sum() + np.r_[0.0, np.cumsum(y)]
    at = np.searchsorted(ratio, ratio, side="left")
    return float((1.0 / (above[at] / x + below[at] / y)).sum())


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weighted: bool = True) -> float:
    """The larger of the exact probability Jaccard and the plain Jaccard of two bags; the plain one if not ``weighted``."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    i = np.flatnonzero(b[0][at] == a[0])
    if not len(i):
        return 0.0
    plain = len(i) / (len(a[0]) + len(b[0]) - len(i))
    if not weighted or a[1].max() == 1.0 == b[1].max():
        return plain  # equal weights: both measures are the same
    return max(plain, probability_jaccard(a, b, i, at[i]))


def alike(threshold: float = THRESHOLD, weighted: bool = True):
    """UDF: whether the exact similarity of two texts reaches ``threshold``."""

    @F.arrow_udf("boolean")
    def check(left: pa.Array, right: pa.Array) -> pa.Array:
        left = left.dictionary_encode()  # a leader meets many texts
        heads, at = bags(left.dictionary), left.indices.to_numpy()
        return pa.array([similarity(heads[i], b, weighted) >= threshold for i, b in zip(at, bags(right), strict=True)],
                        pa.bool_())

    return check


def linked(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]],
           threshold: float, weighted: bool = True) -> np.ndarray:
    """Which pairs of two lists of bags have a `similarity` of ``threshold`` or more, all at once."""
    sizes = [np.array([len(b[0]) for b in side]) for side in (left, right)]
    owner = np.concatenate([np.repeat(np.arange(len(s)) + i * len(sizes[0]), s) for i, s in enumerate(sizes)])
    shingle = np.concatenate([b[0] for b in [*left, *right]] or [np.zeros(0, np.uint64)])
    weight = np.concatenate([b[1] for b in [*left, *right]] or [np.zeros(0)])
    keys, column, count = np.unique(shingle, return_inverse=True, return_counts=True)
    shared = (count > 1)[column]  # a shingle of one text alone is in no intersection
    column = (np.cumsum(count > 1) - 1)[column[shared]]
    total = np.bincount(owner, weights=weight, minlength=len(left) + len(right))
    there = np.zeros((len(left) + len(right), int((count > 1).sum())), np.float32)
    heavy = there.copy()
    there[owner[shared], column], heavy[owner[shared], column] = 1, weight[shared]
    one, two = slice(0, len(left)), slice(len(left), None)
    both = there[one] @ there[two].T
    result = both >= threshold * (sizes[0][:, None] + sizes[1][None, :] - both) - 1e-6
    result &= both > 0
    if not weighted:
        return result
    # The probability Jaccard is at most the share of weight that either text has in common with the other.
    bound = np.minimum((heavy[one] @ there[two].T) / np.maximum(total[one], 1e-9)[:, None],
                       (there[one] @ heavy[two].T) / np.maximum(total[two], 1e-9)[None, :])
    for i, j in zip(*np.nonzero((bound >= threshold - 1e-6) & ~result)):
        result[i, j] = similarity(left[i], right[j]) >= threshold
    return result


def links_between(threshold: float = THRESHOLD, weighted: bool = True):
    """UDF: links (u, v), u < v, between texts of two blocks that are in different components.

    A block is three arrays: nodes, components, texts. Of the links found between the two
    blocks enough are returned to connect what they connect.
    """

    @F.arrow_udf("array<struct<u:binary,v:binary>>")
    def compare(nodes: pa.Array, comps: pa.Array, texts: pa.Array, others: pa.Array, their_comps: pa.Array,
                their_texts: pa.Array) -> pa.Array:
        out = []
        for i in range(len(nodes)):
            left, right = nodes[i].as_py(), others[i].as_py()
            ours, theirs = comps[i].as_py(), their_comps[i].as_py()
            found = linked(bags(texts[i].values), bags(their_texts[i].values), threshold, weighted)
            parent: dict[bytes, bytes] = {}

            def top(x: bytes) -> bytes:
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            edges = []
            for a, b in zip(*np.nonzero(found)):
                one, two = top(ours[a]), top(theirs[b])
                if one != two:
                    parent[one] = two
                    u, v = sorted((left[a], right[b]))
                    edges.append({"u": u, "v": v})
            out.append(edges)
        return pa.array(out, pa.list_(pa.struct([("u", pa.binary()), ("v", pa.binary())])))

    return compare
