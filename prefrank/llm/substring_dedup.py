"""Substring deduplication: repeated paragraphs and passages across documents.

A paragraph is a line of 20 words or more. MinHash bands over its five-word shingles bring
similar paragraphs together, exact Jaccard verifies them, and connected paragraphs form a
class. A passage that was pasted into the middle of a paragraph does not make the whole
paragraphs similar; therefore texts are also cut at content-defined points (winnowing, so
equal runs of words are cut alike wherever they stand) and blocks of 8 words or more that
are equal form classes too: any 51 equal words hold such a block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefrank.llm.links import bucket_components, shared_buckets
from prefrank.llm.scratch import Scratch, small_batches
from prefrank.llm.similarity import THRESHOLD
from prefrank.llm.url_filter import blocked_bloom, probe
from prefrank.llm.words import Words, mix, slices

RECALL = 0.995
HASHES = 30
PARAGRAPH_WORDS = 20
BLOCK_WORDS = 8
WINNOW = 16
_GRAM = 3

_U = np.uint64
_SEEDS = mix(np.arange(1, 129, dtype=_U) * _U(0x8CB92BA72F3D8DD7)) | _U(1)


def tune_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have, then the fewest bands, that find a pair at ``threshold`` with ``recall``."""
    for rows in range(hashes, 0, -1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))) if threshold < 1 else 1
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("no banding of so few hashes reaches the recall")


def _range_keys(words: Words, first: np.ndarray, end: np.ndarray, salt: int) -> pa.Array:
    """128-bit keys of the words in each range."""
    size = end - first
    starts = np.r_[0, np.cumsum(size)[:-1]]
    place = np.arange(size.sum()) - np.repeat(starts, size)
    code = words.hash[place + np.repeat(first, size)]
    place = (place + 1).astype(_U)
    one = np.add.reduceat(mix(code + place * _SEEDS[salt]), starts)
    two = np.add.reduceat(mix(code ^ mix(place * _SEEDS[salt + 2])), starts)
    raw = np.stack([mix(one), mix(two)], axis=1).astype("<u8").tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(first), [None, pa.py_buffer(raw)]).cast(pa.binary())


def _paragraphs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    lines = words.lines()
    long = np.diff(lines) >= PARAGRAPH_WORDS
    return lines[:-1][long], lines[1:][long]


def _sliding(values: np.ndarray, size: int, choose, fill) -> np.ndarray:
    """``choose`` over ``size`` values from each place on; ``size`` is a power of two."""
    width = 1
    while width < size:
        values = choose(values, np.r_[values[width:], np.full(min(width, len(values)), fill, values.dtype)])
        width *= 2
    return values


def _blocks(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges between neighbouring cut points; a cut is the least 3-gram of some window of `WINNOW`."""
    n = len(words.hash)
    none = np.zeros(0, np.int64)
    if n < WINNOW:
        return none, none
    end = words.bounds[1:][words.doc]
    h = mix(words.hash + np.r_[words.hash[1:], _U(0)] * _SEEDS[8] + np.r_[words.hash[2:], np.zeros(2, _U)] * _SEEDS[9]) | _U(1)
    at = np.arange(n)
    h[at + _GRAM > end] = ~_U(0)
    low = _sliding(h, WINNOW, np.minimum, ~_U(0))
    low[at + WINNOW + _GRAM - 1 > end] = 0  # windows that leave the text
    high = _sliding(low[::-1], WINNOW, np.maximum, _U(0))[::-1]  # over the windows that hold a place
    cut = np.flatnonzero((high == h) & (at + _GRAM <= end))
    first, last = cut[:-1], cut[1:]
    good = (words.doc[first] == words.doc[last]) & (last - first >= BLOCK_WORDS) if len(first) else np.zeros(0, bool)
    return first[good], last[good]


def _minhashes(words: Words, first: np.ndarray, end: np.ndarray, hashes: int) -> np.ndarray:
    """(paragraphs x hashes) minima over the shingles inside each paragraph."""
    at, shingle = words.shingles(bounds=words.lines())
    lo, hi = np.searchsorted(at, first), np.searchsorted(at, end)
    picks = np.stack([lo, hi], axis=1).ravel()
    padded = np.r_[shingle, _U(0)]
    out = np.zeros((len(first), hashes), _U)
    for k in range(hashes if len(first) else 0):
        code = padded * _SEEDS[16 + k]
        out[:, k] = np.minimum.reduceat(code ^ (code >> _U(29)), picks)[::2]
    return out


def _units(bands: int, rows: int):
    kind = "paragraph:boolean,start:bigint,end:bigint,n_words:int,key:binary,bands:array<bigint>"

    @F.arrow_udf(f"array<struct<{kind}>>")
    def cut(texts: pa.Array) -> pa.Array:
        struct = pa.struct([("paragraph", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int32()),
                            ("key", pa.binary()), ("bands", pa.list_(pa.int64()))])
        parts = [pa.array([], pa.list_(struct))]
        for part in slices(texts):
            words = Words(part)
            chars = words.chars()
            lines, blocks = _paragraphs(words), _blocks(words)
            code = _minhashes(words, *lines, bands * rows).reshape(-1, bands, rows)
            key = np.broadcast_to(_SEEDS[100:100 + bands], code.shape[:2]).copy()
            for j in range(rows):
                key = mix(key * _SEEDS[15] + code[:, :, j])
            first, end = np.r_[lines[0], blocks[0]], np.r_[lines[1], blocks[1]]
            doc = words.doc[first]
            keys = [_range_keys(words, *ranges, salt) for salt, ranges in enumerate((lines, blocks)) if len(ranges[0])]
            counts = np.where(np.arange(len(first)) < len(lines[0]), bands, 0)
            banded = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()),
                                              pa.array(key.ravel().view(np.int64)))
            base = chars[words.offsets[doc]]
            order = np.argsort(doc, kind="stable")
            rows_ = pa.StructArray.from_arrays([
                pa.array(np.arange(len(first)) < len(lines[0])), pa.array(chars[words.first[first]] - base),
                pa.array(chars[words.last[end - 1]] - base), pa.array((end - first).astype(np.int32)),
                pa.concat_arrays([pa.array([], pa.binary()), *keys]), banded], fields=list(struct)).take(pa.array(order))
            offsets = np.searchsorted(doc[order], np.arange(words.docs + 1))
            parts.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows_))
        return pa.concat_arrays(parts)

    return cut


def _paragraph_texts():
    """The UDF, made when a session is there."""

    @F.arrow_udf("array<struct<key:binary,text:string>>")
    def run(texts: pa.Array) -> pa.Array:
        out: list[list[dict]] = []
        for part in slices(texts):
            words = Words(part)
            first, end = _paragraphs(words)
            own: list[list[dict]] = [[] for _ in range(words.docs)]
            keys = _range_keys(words, first, end, 0).to_pylist() if len(first) else []
            for d, key, a, b in zip(words.doc[first], keys, words.first[first], words.last[end - 1]):
                own[d].append({"key": key, "text": words.data[a:b].tobytes().decode()})
            out += own
        return pa.array(out, pa.list_(pa.struct([("key", pa.binary()), ("text", pa.string())])))

    return run


def _only(scratch: Scratch, rows: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """Rows whose ``key`` passes a bounded, broadcast Bloom filter of ``keys``; few others pass."""
    bloom, blocks = blocked_bloom(keys, "key", size)
    return probe(rows, "key", scratch.save(bloom, "bloom"), blocks, "_maybe").where("_maybe").drop("_maybe")


def repeated_passages(docs: DataFrame, text: str = "text", id_column: str = "doc_id", threshold: float = THRESHOLD,
                      recall: float = RECALL) -> DataFrame:
    """Every occurrence of a paragraph or block whose class occurs in two rows of ``docs`` or more.

    Columns: ``doc_id``, code-point span ``start``, ``end``, ``n_words``, ``paragraph`` (a whole
    line, else a block), ``class_id`` (hex), ``first_doc_id`` (where the class occurs first, by id,
    nulls last), ``occurrences`` and ``removed`` (all but the first occurrence). Removing the union
    of the removed spans of a document removes its repeats. Null and empty texts have none, nor
    has an empty table. Repeats inside one document alone are no class.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "substring-dedup")
    bands, rows = tune_bands(threshold, recall)
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    units = scratch.save(source.withColumn("row", F.monotonically_increasing_id()).select(
        "doc_id", "row", F.inline(_units(bands, rows)("text"))), "units")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "start")
    keys = scratch.save(units.groupBy("key", "paragraph").agg(
        F.count("*").alias("n"), F.min(order).alias("first"), F.min("row").alias("low"), F.max("row").alias("high")), "keys")

    members = scratch.save(shared_buckets(
        units.where("paragraph").select(F.explode("bands").alias("bucket"), F.col("key").alias("node")).distinct()), "members")
    wanted = scratch.save(members.select(F.col("node").alias("key")).distinct(), "wanted")
    found = _only(scratch, source.select(F.inline(_paragraph_texts()("text"))), wanted, wanted.count())
    bodies = scratch.save(found.groupBy("key").agg(F.first("text").alias("text")), "bodies")
    labels = bucket_components(scratch, members, bodies, threshold, weighted=False).select(F.col("node").alias("key"), "root")
    # A key that is no paragraph's, or is linked with none, is a class of its own; most are, and stay out of the join.
    alone = keys.join(labels, "key", "left_anti").where("low < high").select(
        "key", F.col("key").alias("root"), F.col("n").alias("occurrences"), "first")
    linked = keys.join(labels, "key")
    merged = linked.groupBy("root").agg(
        F.sum("n").alias("occurrences"), F.min("first").alias("first"), F.min("low").alias("low"),
        F.max("high").alias("high")).where("low < high").drop("low", "high")
    classes = scratch.save(alone.unionByName(linked.select("key", "root").join(merged, "root")), "classes")
    hits = _only(scratch, units.drop("bands"), classes.select("key"), classes.count())
    is_first = (F.col("row") == F.col("first.row")) & (F.col("start") == F.col("first.start"))
    return hits.join(classes, "key").select(
        "doc_id", "start", "end", "n_words", "paragraph", F.lower(F.hex("root")).alias("class_id"),
        F.col("first.doc_id").alias("first_doc_id"), "occurrences", (~is_first).alias("removed"))
