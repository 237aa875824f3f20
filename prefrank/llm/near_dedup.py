"""MinHash near-duplicate detection with ProbMinHash sketches.

A text is its bag of five-word shingles; one that occurs c times weighs 1 + ln(c), so that
a line repeated over and over does not outweigh the rest of its text. Every shingle sends
exponential arrivals at a rate of its weight to random registers; a register keeps the
shingle that came first. A shingle stops as soon as its next arrival is later than the
latest register (Ertl, "ProbMinHash", 2020). Two texts agree in a register with the
probability Jaccard of their bags, or with their plain Jaccard where all weights are 1. A text
with repeated shingles has both sketches, other texts have one that serves as both. Registers
are cut into bands; texts that share a band are compared exactly, and linked texts form classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from prefrank.llm.links import bucket_components, shared_buckets
from prefrank.llm.scratch import Scratch, small_batches, tidy
from prefrank.llm.similarity import THRESHOLD, weighted_shingles
from prefrank.llm.words import MASK, Words, mix, slices

#: 36 bands of 7 registers: a pair at plain or probability Jaccard 0.8 shares a band with probability 0.9998, one at 0.4 with 0.06.
BANDS = 36
ROWS = 7

_U = np.uint64
_STEP = _U(0xA0761D6478BD642F)


def banding_recall(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    return 1 - (1 - similarity ** rows) ** bands


def probminhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """Sketches (docs x registers) of weighted elements; 0 where a text has no element.

    All elements of the batch move in step: turn i draws arrival i of those still active.
    """
    time = np.full(docs * registers, np.inf)
    sketch = np.zeros(docs * registers, _U)
    now = np.zeros(len(element))
    turn = 0
    while len(element):
        turn += 1
        draw = mix(element + _U(turn * int(_STEP) & MASK))
        now = now - np.log((draw >> _U(11)).astype(np.float64) * 2.0 ** -53 + 2.0 ** -54) / weight
        slot = doc * registers + (mix(draw ^ _STEP) % _U(registers)).astype(np.int64)
        np.minimum.at(time, slot, now)
        first = time[slot] == now
        sketch[slot[first]] = element[first]
        going = now < time.reshape(docs, registers).max(1)[doc]
        doc, element, weight, now = doc[going], element[going], weight[going], now[going]
    return sketch.reshape(docs, registers)


def band_keys(bands: int = BANDS, rows: int = ROWS):
    """UDF: distinct band keys of the weighted and the plain sketch of each text; empty for a text without words."""

    def coded(sketch: np.ndarray) -> np.ndarray:
        sketch = sketch.reshape(-1, bands, rows)
        code = np.broadcast_to(np.arange(bands, dtype=_U), sketch.shape[:2]).copy()
        for j in range(rows):
            code = mix(code * _STEP + sketch[:, :, j])
        return code

    @F.arrow_udf("array<bigint>")
    def keys(texts: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.list_(pa.int64()))]
        for part in slices(texts):
            words = Words(part)
            doc, shingle, weight = weighted_shingles(words)
            code = coded(probminhash(doc, shingle, weight, words.docs, bands * rows))
            filled = np.diff(words.bounds) > 0
            repeats = np.zeros(words.docs, bool)
            repeats[doc[weight > 1]] = True
            own, number = repeats[doc], np.cumsum(repeats) - 1
            plain = coded(probminhash(number[doc[own]], shingle[own], np.ones(own.sum()), int(repeats.sum()), bands * rows))
            held = np.zeros((words.docs, 2, bands), bool)
            held[filled, 0] = True
            held[repeats, 1] = plain != code[repeats]
            codes = np.stack([code, code], axis=1)
            codes[repeats, 1] = plain
            offsets = np.r_[0, np.cumsum(held.sum((1, 2)))]
            parts.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(codes[held].view(np.int64))))
        return pa.concat_arrays(parts)

    return keys


def content_key(text: str) -> Column:
    """128-bit key of the raw text; null is an empty text."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def near_duplicate_classes(docs: DataFrame, text: str = "text", id_column: str = "doc_id",
                           threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, class_id, class_size, first_id, first_key) of every different text.

    ``key`` is `content_key`; equal texts have one key. Ids are integers or texts. ``class_id`` is the smallest id of the
    class (a hash of its first key if all its ids are null, or if a class with a smaller first key
    has the same smallest id); (``first_id``, ``first_key``) names the row to keep. Texts without a word are linked with nothing but their exact copies.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "near-dedup")
    rows_ = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn(
        "key", content_key("text"))
    banded = rows_.select("id", "key", band_keys(bands, rows)("text").alias("bands"))
    texts = scratch.save(banded.groupBy("key").agg(
        F.min("id").alias("id"), F.count("*").alias("n"), F.first("bands").alias("bands")), "texts")
    members = scratch.save(shared_buckets(
        texts.select(F.explode("bands").alias("bucket"), F.col("key").alias("node"))), "members")
    wanted = members.select(F.col("node").alias("key")).distinct()
    bodies = scratch.save(
        rows_.select("key", "text").join(wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")),
        "bodies")
    labels = bucket_components(scratch, members, bodies, threshold)
    named = texts.select("key", "id", "n").join(labels.withColumnRenamed("node", "key"), "key", "left").select(
        "key", "id", "n", F.coalesce("root", "key").alias("root"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    classes = scratch.save(
        named.groupBy("root").agg(F.sum("n").alias("class_size"), F.min(order).alias("first")), "named")
    # Rows of one id may be in different classes: one of them keeps it as its name. Such ids are few, or none.
    shared = scratch.save(classes.where("first.id is not null").groupBy(F.col("first.id").alias("shared_id")).agg(
        F.count("*").alias("n"), F.min("first.key").alias("owner")).where("n > 1").select("shared_id", "owner"), "shared")
    classes = classes.join(shared, F.col("first.id") == F.col("shared_id"), "left").select(
        "root", "class_size", "first",
        F.when(F.col("owner").isNull() | (F.col("owner") == F.col("first.key")), F.col("first.id")).alias("own_id"))
    # Names of classes are of the ids' kind: whole numbers, or texts.
    other = F.xxhash64("first.key") if isinstance(docs.schema[id_column].dataType, IntegralType) else F.hex("first.key")
    kind = "bigint" if isinstance(docs.schema[id_column].dataType, IntegralType) else "string"
    return scratch.save(named.join(classes, "root").select(
        "key", F.coalesce(F.col("own_id").cast(kind), other).alias("class_id"), "class_size",
        F.col("first.id").alias("first_id"), F.col("first.key").alias("first_key")), "classes")


def near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id", **options) -> DataFrame:
    """Every row of ``docs`` with ``class_id``, ``class_size`` and ``is_first``.

    ``is_first`` holds for the rows of a class that carry its smallest id and first text;
    repeated rows (same id, same text) are all first, `keep_first` drops the repeats. Null
    text counts as empty; null ids come last. Other columns pass through, columns with the
    added names are replaced. An empty table gives an empty result.
    """
    classes = near_duplicate_classes(docs, text, id_column, **options)
    classes = classes.select(*[F.col(c).alias(f"_class_{c}") for c in classes.columns])
    joined = tidy(docs, "class_id", "class_size", "is_first").withColumn("_class_own", content_key(text)).join(
        classes, F.col("_class_own") == F.col("_class_key"))
    first = F.col(id_column).eqNullSafe(F.col("_class_first_id")) & (F.col("_class_key") == F.col("_class_first_key"))
    return joined.withColumns({
        "class_id": F.col("_class_class_id"), "class_size": F.col("_class_class_size"), "is_first": first,
    }).drop("_class_own", *classes.columns)


def keep_first(docs: DataFrame, text: str = "text", id_column: str = "doc_id", **options) -> DataFrame:
    """One row of each class, with the columns of ``docs``; one of repeated rows stays, any of them."""
    firsts = near_duplicates(docs, text, id_column, **options).where("is_first")
    return firsts.dropDuplicates(["class_id"]).select(*docs.columns)
