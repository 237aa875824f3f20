"""How document filters interact: what each removes, step by step, in every order of the filters.

A stream reads the files in available-now micro-batches. Each text has a mask of the filters it fails;
the state of a text is the smallest id seen with it, because all later ids are copies. When a
smaller id arrives, the mask counted for the earlier one is retracted and counted again as a copy. Every
micro-batch adds its differences to counters by part and mask, which are all that the report needs.
Texts are keyed by a hash; some hundred of them share one key, because a call for each text costs more than its work.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Callable, Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegralType, LongType, StringType

from prefrank.llm.words import utf8
from prefrank.session import scratch_path

LETTERS = "ABCDE"
#: Keys of the state; a key holds the texts whose hash it is.
KEYS = 4096
#: Documents that a task holds at once.
BATCH_ROWS = 2000
_CAPITALS = bytes(range(0x41, 0x5B))
_MARKS = b"#$%&*|"


def judge_document(text: bytes) -> int:
    """Bits of the failed filters: 1 under 200 words, 2 under half of them distinct, 4 over 3 % capitals, 8 marks."""
    words = text.split()
    n, distinct = len(words), len(set(words))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.decode())
    return ((n < 200) | (100 * distinct < 50 * n) << 1 | (100 * capitals > 3 * points) << 2
            | (len(text.translate(None, _MARKS)) < len(text)) << 3)


def _collapse(judge: Callable[[bytes], int], copy: int, numeric: bool, keys: int):
    """Rows of a batch by text: only the smallest id of each text goes to its state, the others are copies for sure.

    Copies have no digest, and a key that only spreads them.
    """
    kind = pa.int64() if numeric else pa.string()
    schema = pa.schema([("key", pa.int32()), ("digest", pa.string()), ("id", kind), ("known", pa.bool_()),
                        ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            parts = batch.column(1).fill_null("").to_pylist()
            masks: dict[str, int] = {}
            least: dict[str, object] = {}
            digests = []
            data, offsets = utf8(batch.column(2))
            for own, begin, end in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist()):
                text = data[begin:end].tobytes()
                digest = hashlib.sha256(text).hexdigest()
                digests.append(digest)
                if digest not in masks:
                    masks[digest] = judge(text)
                if own is not None and (digest not in least or own < least[digest]):
                    least[digest] = own
            rows: dict[tuple, int] = {}
            for i, (own, part, digest) in enumerate(zip(ids, parts, digests)):
                mask = masks[digest]
                if own is not None and own == least[digest]:
                    row = (int(digest[:12], 16) % keys, digest, own, True, part, mask)
                else:
                    # Without an id a row is no copy and makes none; it gets a number that only spreads it.
                    known = own is not None
                    number = zlib.crc32(str(own).encode() if known else digest.encode(), i * (not known))
                    own = own if known else number if numeric else str(number)
                    row = (number % keys, None, own, known, part, mask | copy * known)
                rows[row] = rows.get(row, 0) + 1
            if rows:
                columns = [*zip(*rows), list(rows.values())]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _least_ids(copy: int):
    """State of the texts of a key: for each its smallest id, the mask and the rows of each part that carry it."""
    names = ["id", "known", "part", "mask", "n"]

    def keep(_, frames, state: GroupState):
        texts = json.loads(state.get[0]) if state.exists else {}
        changed = False
        for frame in frames:
            settled = frame["digest"].isna()
            if settled.any():
                yield frame.loc[settled, names]
            frame, out = frame[~settled], []
            for digest, own, part, own_mask, n in zip(*(frame[c].tolist() for c in ("digest", "id", "part", "mask", "n"))):
                least, mask, parts = texts.get(digest) or (None, 0, {})
                if least is None or own < least:
                    for other, rows in parts.items():
                        out += [(least, True, other, mask, -rows), (least, True, other, mask | copy, rows)]
                    least, mask, parts = own, own_mask, {}
                if own == least:
                    parts[part] = parts.get(part, 0) + n
                    texts[digest] = (least, mask, parts)
                    out.append((own, True, part, own_mask, n))
                    changed = True
                else:
                    out.append((own, True, part, own_mask | copy, n))
            if out:
                yield pd.DataFrame(out, columns=names)
        if changed:
            state.update((json.dumps(texts),))

    return keep


def mask_changes(docs: DataFrame, text: str = "text", id_column: str = "doc_id", part: str = "lang",
                 judge: Callable[[bytes], int] = judge_document, letters: str = LETTERS, keys: int = KEYS) -> DataFrame:
    """Stream of (id, known, part, mask, n): rows to add to, or with a negative n to take from, the counters.

    ``docs`` is a stream. Ids may be integers or texts; ``known`` is false for null ids. The last letter's bit marks copies.
    ``keys`` should grow with the documents, a key for some hundred of them; it stays as it is for a checkpoint.
    """
    copy = 1 << len(letters) - 1
    numeric = isinstance(docs.schema[id_column].dataType, IntegralType)
    kind = LongType() if numeric else StringType()
    table = docs.select(F.col(id_column).cast(kind).alias("id"), F.col(part).cast("string").alias("part"),
                        F.col(text).alias("text"))
    name = kind.simpleString()
    rows = f"id {name}, known boolean, part string, mask int, n bigint"
    collapsed = table.mapInArrow(_collapse(judge, copy, numeric, keys), f"key int, digest string, {rows}")
    return collapsed.groupBy("key").applyInPandasWithState(
        _least_ids(copy), rows, "texts string", "append", GroupStateTimeout.NoTimeout)


def label_flags(labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, good, toxic) of labelled ids; of repeated rows one with a 1 is enough."""
    flag = {name: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(name)
            for name, c in (("good", "quality"), ("toxic", "toxic"))}
    return labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(*flag.values()).where(
        "good = 1 or toxic = 1")


def start_audit(docs: DataFrame, labels: DataFrame, path: str, checkpoint: str, letters: str = LETTERS,
                **options) -> StreamingQuery:
    """Keep counters of a stream of documents below ``path``, one folder of differences for each micro-batch.

    It ends when the present files are used up; started again with the same folders it goes on with the
    new ones. A replayed micro-batch overwrites its folders. ``labels``: `label_flags`.
    """
    spark = docs.sparkSession
    changes = mask_changes(docs, letters=letters, **options)

    def count(batch: DataFrame, number: int) -> None:
        # Stored first: the state must not be computed twice, and the join is planned adaptively.
        place = f"{path}/changes/batch={number}"
        batch.write.mode("overwrite").parquet(place)
        stored = spark.read.schema(changes.schema).parquet(place)
        flags = labels.withColumn("known", F.lit(True)).withColumn("id", F.col("id").cast(stored.schema["id"].dataType))
        counted = stored.join(flags, ["id", "known"], "left").groupBy("part", "mask").agg(
            F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])
        counted.write.mode("overwrite").parquet(f"{path}/counters/batch={number}")

    # A stream takes the settings of its start; the session gets its own back.
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = spark.conf.get(setting)
    spark.conf.set(setting, str(BATCH_ROWS))
    try:
        return (changes.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).foreachBatch(count).start())
    finally:
        spark.conf.set(setting, rows)


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """(part, mask, n, good, toxic) over all micro-batches of `start_audit`."""
    schema = "part string, mask int, n bigint, good bigint, toxic bigint"
    return spark.read.schema(schema).parquet(f"{path}/counters/batch=*").groupBy("part", "mask").agg(
        *[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def order_report(counters: DataFrame, letters: str = LETTERS) -> DataFrame:
    """What the filters do in every order: one row per part, order and step.

    ``kept`` and ``removed`` after and by the step, ``redundant`` failing its filter but removed before, ``unique_fails`` failing
    its filter alone, ``good_lost`` and ``toxic_lost`` labelled rows among the removed, ``shapley`` the filter's
    removed summed over all orders.
    """
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    rows = counters.select("*", F.explode(orders).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))

    def bits(found):
        total = F.lit(0)
        for i, letter in enumerate(letters):
            total = total + F.when(F.instr(found, letter) > 0, 1 << i).otherwise(0)
        return total

    before = bits(F.expr("substring(filter_order, 1, step - 1)"))
    rows = rows.withColumn("letter", F.expr("substring(filter_order, step, 1)")).withColumns(
        {"own": bits(F.col("letter")), "early": F.col("mask").bitwiseAND(before)})
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    first = fails & (F.col("early") == 0)

    def total(column: str, condition):
        return F.sum(F.when(condition, F.col(column)).otherwise(0))

    steps = rows.groupBy("part", "filter_order", "step", "letter").agg(
        total("n", ~fails & (F.col("early") == 0)).alias("kept"), total("n", first).alias("removed"),
        total("n", fails & (F.col("early") != 0)).alias("redundant"),
        total("n", F.col("mask") == F.col("own")).alias("unique_fails"),
        total("good", first).alias("good_lost"), total("toxic", first).alias("toxic_lost"))
    everywhere = Window.partitionBy("part", "letter")
    return steps.withColumn("shapley", F.sum("removed").over(everywhere)).drop("letter")


def audit_filters(docs: DataFrame, labels: DataFrame, letters: str = LETTERS, **options) -> DataFrame:
    """`order_report` of a stream of documents, run over its present files.

    Null texts are empty, null parts the empty text. Rows with a null id are counted, are never copies and make none.
    Rows that repeat an id and its text are all originals. Texts are judged whole, whatever their length; a batch of Arrow
    rows is held. Other columns are not read; no documents, no rows. ``labels`` (doc_id, quality, toxic).
    """
    spark = docs.sparkSession
    place = scratch_path(spark, "filter-audit")
    flags = label_flags(labels)
    flags.write.parquet(f"{place}/flags")
    start_audit(docs, spark.read.schema(flags.schema).parquet(f"{place}/flags"), place, f"{place}/state", letters,
                **options).awaitTermination()
    if not _exists(spark, f"{place}/counters"):
        return order_report(spark.createDataFrame([], "part string, mask int, n bigint, good bigint, toxic bigint"), letters)
    return order_report(read_counters(spark, place), letters)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
