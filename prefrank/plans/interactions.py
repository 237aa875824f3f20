"""Support messages: redact, detect intent, prompt, generate, parse, submit."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefrank import fixed_values as fixed
from prefrank.functions import text
from prefrank.functions.privacy import PORTUGUESE, Dialect, redact
from prefrank.operators import routing


def prepare_interactions(df: DataFrame, company: str, rules=fixed.INTENT_RULES,
                         dialect: Dialect = PORTUGUESE) -> DataFrame:
    """Redact ``message`` and add ``intent`` and the reasoning ``prompt``.

    Raises ``TypeError`` when the message is not text.
    """
    kind = df.schema["message"].dataType
    if not isinstance(kind, T.StringType):
        raise TypeError(f"message must be a string column, not {kind.simpleString()}")
    return (df.withColumn("message", redact("message", dialect))
            .withColumn("intent", routing.detect_intent("message", rules))
            .withColumn("prompt", routing.reasoning_prompt("message", "segment", "intent", company)))


def generate(df: DataFrame, function: Callable, prompt: str = "prompt", out: str = "raw") -> DataFrame:
    """Add generated text from ``function(prompts) -> texts`` on Arrow batches.

    A class is built once per task. ``latency_ms`` is the batch time shared by its rows.
    """
    schema = T.StructType(df.schema.fields + [
        T.StructField(out, T.StringType()), T.StructField("latency_ms", T.DoubleType())])

    def run(batches):
        model = function() if isinstance(function, type) else function
        for pdf in batches:
            begin = time.perf_counter()
            produced = pd.Series(list(model(pdf[prompt])), index=pdf.index, dtype="object")
            spent = (time.perf_counter() - begin) * 1000 / max(len(pdf), 1)
            yield pdf.assign(**{out: produced, "latency_ms": spent})

    return df.mapInPandas(run, schema)


def parse_interactions(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``thinking``, ``response`` and their display cuts."""
    parsed = df.withColumn("_parsed", text.parse_generated(raw)).withColumns({
        "thinking": F.col("_parsed.thinking"), "response": F.col("_parsed.response")})
    return parsed.drop("_parsed").withColumns({
        "thinking_display": text.ellipsis("thinking", fixed.THINKING_DISPLAY_CHARS),
        "response_display": text.ellipsis("response", fixed.RESPONSE_DISPLAY_CHARS)})


def answer_interactions(df: DataFrame, function: Callable, company: str, rules=fixed.INTENT_RULES,
                        limit_ms: float = fixed.LATENCY_LIMIT_MS) -> DataFrame:
    """The whole chain; ``prediction`` is ready for the submission writer."""
    answered = parse_interactions(generate(prepare_interactions(df, company, rules), function))
    return answered.withColumns({
        "prediction": F.col("response"), "over_limit": F.col("latency_ms") > limit_ms})
