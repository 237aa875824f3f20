"""Output files: submission CSV, JSON reports, feedback events, rule tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefrank import fixed_values as fixed
from prefrank.functions.text import cut
from prefrank.schemas import FEEDBACK


def submission_rows(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """(id, prediction) with the prediction cut to its limit."""
    return df.select("id", cut(prediction, fixed.SUBMISSION_CHARS).alias("prediction"))


def write_submission(df: DataFrame, path: str, prediction: str = "prediction") -> None:
    """CSV with header, written in parallel; an empty table still gets its header."""
    (submission_rows(df, prediction).write.mode("overwrite")
     .option("header", True).option("escape", '"').option("emptyValue", "")
     # The writer would trim values by default.
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_json(df: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    df.write.mode("overwrite").json(path)


def feedback_json(df: DataFrame) -> DataFrame:
    """Feedback events as JSON text in a ``value`` column, nulls kept as fields."""
    record = F.struct(
        "conversation_id", "actual_winner", "satisfaction_score", "channel",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("timestamp"))
    return df.select(F.to_json(record, {"ignoreNullFields": "false"}).alias("value"))


def parse_feedback(df: DataFrame, value: str = "value") -> DataFrame:
    """Feedback events from JSON text; unreadable text gives null fields."""
    return df.select(F.from_json(value, FEEDBACK).alias("event")).select("event.*")


def write_settings(spark: SparkSession, settings: dict, path: str) -> None:
    """Small settings as one line of JSON, to be read with `load_rules`."""
    spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_rules(spark: SparkSession, path: str) -> dict:
    """Settings file on the driver: YAML when the library is present, else JSON.

    Rule files hold a few dozen entries; the operators take them as plain arguments.
    """
    text = spark.read.text(path, wholetext=True).first()["value"]
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """Keyword rules as a table (ord, keyword, intent)."""
    rows = [(i, keyword, intent) for i, (keyword, intent) in enumerate(rules)]
    return spark.createDataFrame(rows, "ord int, keyword string, intent string")
