"""Benchmark decontamination: every passage queries a BM25 index of the test items.

Items are cut into segments of up to a passage's length. The weight of a term in a segment is
its BM25 impact as a share of the segment's own score, so a passage's score is the share of
the segment's BM25 mass that it holds. Passages are overlapping windows over whole texts. All
segments that reach the threshold are found with block-max WAND: list maxima choose a pivot,
maxima of blocks of postings let it jump. Before that, maxima over a fixed number of segment
groups discard, in numpy, passages that cannot reach the threshold in any group. A retrieved
item counts when the text really holds its question and, near any part of it, its answer.

The index comes from tables that Spark computes. It is built in shards of bounded size, and
every text meets every shard.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefrank.llm.scratch import small_batches, tidy
from prefrank.llm.words import SHINGLE, Words, slices

PASSAGE = 64
STRIDE = PASSAGE // 2
K1, B = 1.2, 0.75
#: Share of a segment's own score that a passage must reach to be looked at.
LEAST_SCORE = 0.5
#: Shares of an item that the text must hold: 5-word shingles of the question, words of the answer.
LEAST_QUESTION = 0.6
LEAST_ANSWER = 0.8
POSTING_BLOCK = 8
GROUPS = 64
#: Characters of items in one shard of the index; a shard travels to every executor.
SHARD_CHARS = 4_000_000

_U = np.uint64
_EPS = 1e-9


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence of an item is its answer, what comes before its question.

    An item without five words before its last sentence is a question as a whole.
    """
    body = text.strip()
    ends = [m.end() for m in re.finditer(r"[.!?:]\s+|\n+", body)]
    if not ends or len(Words(pa.array([body[:ends[-1]]])).hash) < SHINGLE:
        return body, ""
    return body[:ends[-1]], body[ends[-1]:]


class Postings:
    """Segments that hold a term, in order, with impacts and maxima of blocks of them."""

    __slots__ = ("docs", "impacts", "block_last", "block_max", "top")

    def __init__(self, docs: np.ndarray, impacts: np.ndarray):
        self.docs, self.impacts = docs.tolist(), impacts.tolist()
        starts = range(0, len(docs), POSTING_BLOCK)
        self.block_last = [int(docs[min(i + POSTING_BLOCK, len(docs)) - 1]) for i in starts]
        self.block_max = [float(impacts[i:i + POSTING_BLOCK].max()) for i in starts]
        self.top = float(impacts.max())


def block_max_wand(lists: list[Postings], threshold: float) -> list[tuple[int, float]]:
    """All (segment, score) with a summed impact of ``threshold`` or more."""
    found, least = [], threshold - _EPS
    cursors = [[p.docs[0], 0, p] for p in lists]

    def advance(cursor: list, to: int) -> None:
        at = bisect_left(cursor[2].docs, to, cursor[1])
        cursor[1] = at
        cursor[0] = cursor[2].docs[at] if at < len(cursor[2].docs) else math.inf

    while True:
        cursors = sorted((c for c in cursors if c[0] < math.inf), key=lambda c: c[0])
        bound, pivot = 0.0, -1
        for k, cursor in enumerate(cursors):
            bound += cursor[2].top
            if bound >= least:
                pivot = k
                break
        if pivot < 0:
            return found
        doc = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
            pivot += 1
        bound, beyond = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else math.inf
        for cursor in cursors[:pivot + 1]:
            block = bisect_left(cursor[2].block_last, doc)
            if block < len(cursor[2].block_last):
                bound += cursor[2].block_max[block]
                beyond = min(beyond, cursor[2].block_last[block] + 1)
        if bound < least:
            if beyond == math.inf:
                return found
            for cursor in cursors[:pivot + 1]:
                advance(cursor, beyond)
        elif cursors[0][0] == doc:
            score = sum(c[2].impacts[c[1]] for c in cursors[:pivot + 1])
            if score >= least:
                found.append((doc, score))
            for cursor in cursors[:pivot + 1]:
                advance(cursor, doc + 1)
        else:
            for cursor in cursors[:pivot + 1]:
                if cursor[0] < doc:
                    advance(cursor, doc)


def _around(first: np.ndarray, end: np.ndarray, reach: int, size: int) -> np.ndarray:
    """Which of ``size`` places are at most ``reach`` away from one of the ranges."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, np.maximum(0, first - reach), 1)
    np.add.at(steps, np.minimum(size, end + reach), -1)
    return np.cumsum(steps[:-1]) > 0


class Shard:
    """Index of some items: postings of segments, group maxima, and what verification needs."""

    def __init__(self, ids: list, texts: list[str], term: np.ndarray, segment: np.ndarray, impact: np.ndarray,
                 owner: np.ndarray):
        """``term``, ``segment``, ``impact``: postings; ``owner``: the item of each segment."""
        self.ids, self.owner = ids, owner.tolist()
        self.parts = [tuple(Words(pa.array([side])) for side in question_and_answer(t)) for t in texts]
        self.parts = [(np.unique(q.shingles()[1]), np.unique(a.hash), len(a.hash)) for q, a in self.parts]
        self.terms, number = np.unique(term, return_inverse=True)
        order = np.lexsort((segment, number))
        number, segment, impact = number[order], segment[order], impact[order]
        cuts = np.searchsorted(number, np.arange(len(self.terms) + 1))
        self.postings = [Postings(segment[i:j], impact[i:j]) for i, j in zip(cuts, cuts[1:])]
        groups = min(GROUPS, max(1, len(owner)))
        self.maxima = np.zeros((len(self.terms) + 1, groups), np.float32)  # the last row is for unknown words
        np.maximum.at(self.maxima, (number, segment * groups // max(1, len(owner))), impact.astype(np.float32))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each word; unknown words have the number after the last."""
        if not len(self.terms):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, len(self.terms))

    def candidates(self, words: Words, least: float) -> dict[int, dict[int, tuple[float, int, int]]]:
        """text -> item -> (best score, first word, end word) of passages that reach ``least``."""
        found: dict[int, dict[int, tuple[float, int, int]]] = {}
        n, number = len(words.hash), self.numbers(words.hash)
        if not n or not len(self.terms):
            return found
        # Half passages: STRIDE words of one text, counted from its first word.
        begin = words.bounds[:-1][words.doc]
        half = (np.arange(n) - begin) // STRIDE
        first = np.flatnonzero((np.arange(n) - begin) % STRIDE == 0)
        known = np.flatnonzero(number < len(self.terms))
        # The same term earlier in the same text: a passage counts a term once.
        order = known[np.lexsort((known, number[known], words.doc[known]))]
        before = np.full(n, -1)
        same = (words.doc[order[1:]] == words.doc[order[:-1]]) & (number[order[1:]] == number[order[:-1]])
        before[order[1:][same]] = order[:-1][same]
        rank = np.cumsum((np.arange(n) - begin) % STRIDE == 0) - 1  # which half passage a word is in
        start = begin + half * STRIDE
        bounds = []
        for back in (0, STRIDE):  # as the first half of a passage, and as the second
            new = known[before[known] < start[known] - back]
            place = rank[new]
            total = np.zeros((len(first), self.maxima.shape[1]), np.float32)
            if len(new):
                heads = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                total[place[heads]] = np.add.reduceat(self.maxima[number[new]], heads, axis=0)
            bounds.append(total)
        doc = words.doc[first]
        upper = bounds[0].copy()
        follows = np.flatnonzero(doc[1:] == doc[:-1])
        upper[follows] += bounds[1][follows + 1]
        for k in np.flatnonzero(upper.max(1) >= least - 1e-4):
            end = min(first[k] + PASSAGE, words.bounds[doc[k] + 1])
            terms = np.unique(number[first[k]:end])
            for segment, score in block_max_wand([self.postings[t] for t in terms if t < len(self.terms)], least):
                own, item = found.setdefault(int(doc[k]), {}), self.owner[segment]
                if item not in own or score > own[item][0]:
                    own[item] = (score, int(first[k]), int(end))
        return found

    def verified(self, words: Words, least: float) -> dict[int, list[dict]]:
        out: dict[int, list[dict]] = {}
        found = self.candidates(words, least)
        if not found:
            return out
        at, shingle = words.shingles()
        cuts = np.searchsorted(words.doc[at], np.arange(words.docs + 1))
        chars = words.chars()
        for doc, items in found.items():
            shingles, place = shingle[cuts[doc]:cuts[doc + 1]], at[cuts[doc]:cuts[doc + 1]] - words.bounds[doc]
            vocabulary = words.hash[words.bounds[doc]:words.bounds[doc + 1]]
            for item, (score, first, end) in sorted(items.items()):
                question, answer, size = self.parts[item]
                there = np.isin(shingles, question)
                asked = float(np.isin(question, shingles[there]).mean()) if len(question) else 0.0
                if asked < LEAST_QUESTION:
                    continue
                # The best passage may lie in any part of a long item: the answer is sought around all of its question.
                reach = max(PASSAGE, size)
                near = vocabulary[_around(np.r_[place[there], first - words.bounds[doc]],
                                          np.r_[place[there] + SHINGLE, end - words.bounds[doc]], reach, len(vocabulary))]
                told = float(np.isin(answer, near).mean()) if len(answer) else 1.0
                if told >= LEAST_ANSWER:
                    base = chars[words.offsets[doc]]
                    out.setdefault(doc, []).append({
                        "item_id": self.ids[item], "score": score, "question_overlap": asked, "answer_overlap": told,
                        "start": int(chars[words.first[first]] - base), "end": int(chars[words.last[end - 1]] - base)})
        return out


def _segment_terms(batches):
    """(item, segment, term, tf, length) of items in segments of up to PASSAGE words."""
    for batch in batches:
        keys, at = batch.column("item").to_pylist(), 0
        for part in slices(batch.column("text")):
            words = Words(part)
            place = np.arange(len(words.hash)) - words.bounds[:-1][words.doc]
            count = np.diff(words.bounds)
            pieces = np.maximum(1, -(-count // PASSAGE))
            segment = place // np.maximum(1, -(-count // pieces))[words.doc]  # segments of one item are alike in length
            length = np.unique(np.stack([words.doc, segment]), axis=1, return_inverse=True, return_counts=True)
            own = length[2][length[1]]
            rows, tf = np.unique(np.stack([words.doc, segment, words.hash.view(np.int64), own]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[at + d] for d in rows[0]], batch.column("item").type), pa.array(rows[1]), pa.array(rows[2]),
                 pa.array(tf), pa.array(rows[3])], ["item", "segment", "term", "tf", "length"])
            at += len(part)


def build_index(items: DataFrame, id_column: str = "item_id", text: str = "text") -> list[Shard]:
    """Shards of the index over all items; term counts and lengths are taken over all of them.

    An item is an id with a text: different texts of one id, or of none, are items of their own; repeated rows are
    one. Items without a word are left out.
    """
    items = items.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    own = F.md5(F.concat_ws("\n", F.col("id").isNull().cast("string"), F.col("id").cast("string"), "text"))
    items = items.withColumn("item", own)
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_CHARS))
    shard = lambda: F.pmod(F.xxhash64("item"), F.lit(shards))
    terms = items.select("item", "text").mapInArrow(_segment_terms, "item string, segment long, term long, tf long, length long")
    pieces = terms.select("item", "segment", "length").distinct().agg(
        F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    idf = terms.groupBy("term").agg(F.count("*").alias("df")).select(
        "term", F.log(1 + (pieces["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    impact = F.col("idf") * F.col("tf") * (K1 + 1) / (
        F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(pieces["mean"] or 1))))
    weighted = terms.join(idf, "term").select("item", "segment", "length", "term", impact.alias("impact"))
    found = []
    for k in range(shards):
        rows = {r["item"]: (r["id"], r["text"]) for r in items.where(shard() == k).toLocalIterator()}
        weights = weighted.where(shard() == k).toArrow().to_pydict()
        # Segments in order of length: those of one group and block have impacts of one size.
        order = sorted(set(zip(weights["length"], weights["item"], weights["segment"])))
        if not order:
            continue
        number = {(item, segment): i for i, (_, item, segment) in enumerate(order)}
        names = sorted(rows, key=lambda item: (rows[item][0] is None, rows[item][0] or 0, rows[item][1]))
        place = {item: i for i, item in enumerate(names)}
        segment = np.array([number[pair] for pair in zip(weights["item"], weights["segment"])])
        impacts = np.array(weights["impact"])
        own = np.bincount(segment, weights=impacts, minlength=len(order))
        found.append(Shard([rows[i][0] for i in names], [rows[i][1] for i in names],
                           np.array(weights["term"], np.int64).view(_U), segment,
                           impacts / own[segment], np.array([place[item] for _, item, _ in order])))
    return found


def _matches(shard: Shard, kind: str, least: float):
    @F.arrow_udf(f"array<struct<item_id:{kind},score:double,question_overlap:double,answer_overlap:double,"
                 "start:bigint,end:bigint>>")
    def match(texts: pa.Array) -> pa.Array:
        rows: list[list[dict]] = []
        for part in slices(texts, 1 << 20):
            hits = shard.verified(Words(part), least)
            rows += [hits.get(i, []) for i in range(len(part))]
        item = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
        real, whole = pa.float64(), pa.int64()
        return pa.array(rows, pa.list_(pa.struct([
            ("item_id", item), ("score", real), ("question_overlap", real), ("answer_overlap", real),
            ("start", whole), ("end", whole)])))

    return match


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", id_column: str = "item_id",
                       item_text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` with ``leaks``: the items each text holds, by id, with scores and the best passage's span.

    Ids are integers or strings, null and repeated ones too; an id stands once for each of its texts that is
    held. Null and empty texts hold none; without items no text does. A
    column ``leaks`` is replaced, others pass through.
    """
    small_batches(docs.sparkSession)
    kind = items.schema[id_column].dataType.simpleString()
    found = [_matches(shard, kind, least)(F.col(text)) for shard in build_index(items, id_column, item_text)]
    none = F.lit(None).cast(f"array<struct<item_id:{kind},score:double,question_overlap:double,answer_overlap:double,"
                            "start:bigint,end:bigint>>")
    leaks = F.concat(*found) if len(found) > 1 else found[0] if found else F.coalesce(none, F.array())
    return tidy(docs, "leaks").withColumn("leaks", leaks)


def clean_of_items(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    return find_contamination(docs, items, **options).where(F.size("leaks") == 0).select(*docs.columns)
