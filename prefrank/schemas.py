"""Explicit schemas of the tables the operators read and write."""

from pyspark.sql import types as T

PREFERENCE = T.StructType([
    T.StructField("conversation_id", T.StringType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("response_a", T.StringType()),
    T.StructField("response_b", T.StringType()),
    T.StructField("winner", T.StringType()),
    T.StructField("merchant_segment", T.StringType()),
])
REQUIRED_PREFERENCE_COLUMNS = ("conversation_id", "prompt", "response_a", "response_b", "winner")
TEXT_COLUMNS = ("prompt", "response_a", "response_b")

REQUEST = T.StructType([
    T.StructField("prompt", T.StringType()),
    T.StructField("response_a", T.StringType()),
    T.StructField("response_b", T.StringType()),
    T.StructField("merchant_segment", T.StringType()),
    T.StructField("conversation_id", T.StringType()),
])

BATCH_REQUEST = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("items", T.ArrayType(REQUEST)),
])

FEEDBACK = T.StructType([
    T.StructField("conversation_id", T.StringType()),
    T.StructField("actual_winner", T.StringType()),
    T.StructField("satisfaction_score", T.IntegerType()),
    T.StructField("channel", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])

RESULT = T.StructType([
    T.StructField("prob_a_wins", T.DoubleType()),
    T.StructField("prob_b_wins", T.DoubleType()),
    T.StructField("prob_tie", T.DoubleType()),
    T.StructField("winner", T.StringType()),
    T.StructField("latency_ms", T.DoubleType()),
])

CACHE_ENTRY = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("written_at", T.TimestampType()),
])

INTERACTION = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("segment", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("expected_intent", T.StringType()),
    T.StructField("context", T.MapType(T.StringType(), T.LongType())),
])

RUN_HISTORY = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("epoch", T.IntegerType()),
    T.StructField("val_auc", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("log_loss", T.DoubleType()),
])

TRAINING_HISTORY = T.StructType([
    *RUN_HISTORY.fields,
    T.StructField("loss", T.DoubleType()),
    T.StructField("cls_loss", T.DoubleType()),
    T.StructField("rank_loss", T.DoubleType()),
])
