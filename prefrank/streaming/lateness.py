"""Late rows of a stream, kept apart instead of dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import AtomicType, DoubleType, StringType, StructField, StructType

from prefrank.streaming.feeds import start

#: Keys that rows are spread over; nothing is remembered between micro-batches.
SPREAD = 256


def mark_late(df: DataFrame, timestamp: str, lateness: str = "1 hour", spread: int = SPREAD) -> DataFrame:
    """All rows of a stream with ``arrival`` and ``delay_seconds``.

    ``arrival`` is ``late`` for a time before the watermark (what ``lateness`` allows behind the newest time
    of earlier micro-batches), ``undated`` for a null time, else ``kept``. The delay of a late row is how far
    it is behind the watermark. Every row comes out once, whatever the cut into micro-batches.
    """
    schema = StructType([*df.schema.fields, StructField("arrival", StringType()), StructField("delay_seconds", DoubleType())])
    names = df.columns

    def split(_, frames, state: GroupState):
        mark = state.getCurrentWatermarkMs() * 1000
        for frame in frames:
            behind = mark - frame["_micros"].astype("float64") if mark > 0 else frame["_micros"] * 0.0
            late = behind > 0
            arrival = late.map({True: "late", False: "kept"}).where(frame["_micros"].notna(), "undated")
            yield frame[names].assign(arrival=arrival, delay_seconds=(behind / 1e6).where(late))

    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, AtomicType)]
    keyed = df.withColumns({"_spread": F.pmod(F.xxhash64(*plain), F.lit(spread)).cast("int"),
                            "_micros": F.unix_micros(F.col(timestamp).cast("timestamp"))})
    return keyed.withWatermark(timestamp, lateness).groupBy("_spread").applyInPandasWithState(
        split, schema, "nothing int", "append", GroupStateTimeout.NoTimeout)


def start_split(df: DataFrame, timestamp: str, path: str, checkpoint: str, lateness: str = "1 hour") -> StreamingQuery:
    """Store a stream with its late and undated rows in folders of their own below ``path``."""
    return start(mark_late(df, timestamp, lateness), path, checkpoint, partition_by=["arrival"])


def read_split(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Stored rows of :func:`start_split`; filters on ``arrival`` read their folder only. ``schema``: that of the input."""
    return spark.read.schema(StructType([
        *schema.fields, StructField("delay_seconds", DoubleType()), StructField("arrival", StringType())])).parquet(path)
