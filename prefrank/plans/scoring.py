"""Scoring of requests: key, cache lookup, redaction, features, scorer, winner.

Two kinds of scorer exist. A native one maps a table to a table with column
expressions (``fusion_scorer``). A user function on Arrow batches enters through
``batch_scorer``: it receives the input texts and the feature matrix of a batch and
returns one probability row per input.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefrank import fixed_values as fixed
from prefrank.functions import scoring
from prefrank.functions.features import (
    aux_vector, lower_words, pair_features, with_aux_vector, words_per_sentence,
)
from prefrank.functions.privacy import MAIN, Dialect, is_blank, redact
from prefrank.functions.text import cache_key, input_text
from prefrank.operators import cache as cache_ops
from prefrank.operators import contracts
from prefrank.operators.dataset import normalize_segment
from prefrank.schemas import CACHE_ENTRY, RESULT, TEXT_COLUMNS
from prefrank.session import computed_once
from prefrank.sources.tables import append_cache, path_exists, read_cache

Scorer = Callable[[DataFrame], DataFrame]


def fusion_scorer(head: scoring.FusionHead, embedding: str | None = None) -> Scorer:
    """Native scorer: fusion head over ``x_aux`` and an optional embedding column."""

    def score(df: DataFrame) -> DataFrame:
        logits = scoring.fusion_logits(head, embedding, "x_aux")
        return df.withColumn("logits", logits).withColumn("probabilities", scoring.softmax("logits"))

    return score


def batch_scorer(function: Callable, batch_rows: int | None = None) -> Scorer:
    """Scorer around ``function(texts, aux) -> array of shape (n, 3)``.

    ``function`` may also be a class: it is then built once per task, for models that
    are expensive to load. ``batch_rows`` caps the rows given to one call; the Arrow batch
    size of the session applies otherwise. Rows whose ``input_text`` is null get no score.
    """

    def score(df: DataFrame) -> DataFrame:
        schema = T.StructType(df.schema.fields + [
            T.StructField("probabilities", T.ArrayType(T.DoubleType()))])

        def run(batches):
            model = function() if isinstance(function, type) else function
            for pdf in batches:
                wanted = np.flatnonzero(pdf["input_text"].notna().to_numpy())
                column = np.full(len(pdf), None, dtype=object)
                step = batch_rows or max(len(wanted), 1)
                for begin in range(0, len(wanted), step):
                    places = wanted[begin:begin + step]
                    piece = pdf.iloc[places]
                    rows = np.asarray(model(piece["input_text"], np.stack(piece["x_aux"].to_numpy())),
                                      dtype="float64")
                    if rows.shape != (len(piece), fixed.NUM_CLASSES):
                        raise ValueError(f"scorer returned shape {rows.shape} for {len(piece)} rows")
                    for place, row in zip(places, rows):
                        column[place] = row
                yield pdf.assign(probabilities=column)

        return df.mapInPandas(run, schema)

    return score


def prepare(df: DataFrame, dialect: Dialect = MAIN, segment: str = "segment") -> DataFrame:
    """Redact the texts, flag blank rows, add input text and features.

    A match always holds visible characters and so does its placeholder: a text is blank
    after redaction exactly when it is blank before, and the flag can come from the raw
    texts, where filters on it stay cheap.
    """
    blank = is_blank("prompt") | is_blank("response_a") | is_blank("response_b")
    df = df.withColumn("rejected", blank)
    df = df.withColumns({c: redact(c, dialect) for c in TEXT_COLUMNS})
    df = with_aux_vector(df, segment=segment)
    return df.withColumn("input_text", input_text(*TEXT_COLUMNS, segment))


def with_result_columns(df: DataFrame) -> DataFrame:
    """Spread ``probabilities`` into the named result columns and pick the winner."""
    p = F.col("probabilities")
    return df.withColumns({
        "prob_a_wins": p[0], "prob_b_wins": p[1], "prob_tie": p[2],
        "winner": scoring.winner("probabilities"),
    })


def with_preferred_text(df: DataFrame) -> DataFrame:
    """Add the text each scored triple prefers; null on a tie."""
    return df.withColumn("preferred", scoring.winner_text("winner", "response_a", "response_b"))


def score_triples(df: DataFrame, scorer: Scorer, dialect: Dialect = MAIN) -> DataFrame:
    """Score clean triples (with ``segment``); rows blank after redaction are left out."""
    ready = prepare(df, dialect).where(~F.col("rejected")).drop("rejected")
    return with_result_columns(scorer(ready))


def score_requests(requests: DataFrame, scorer: Scorer, now: Column, cache: DataFrame | None = None,
                   ttl: int = fixed.CACHE_TTL_SECONDS, policy: str = "reject",
                   namespace: str = "pref:", dialect: Dialect = MAIN) -> DataFrame:
    """Score a request table: one outcome row per request.

    Keys cover the raw texts; only redacted texts reach the scorer, and only those of
    requests that are neither cached nor refused. ``reason`` says why a row has no
    result and is null otherwise; see ``results``, ``refused`` and ``new_entries``. Write
    the outcome once and derive the three from the written table. The latency of a fresh
    row is the input column ``latency_ms`` when present.

    Without a cache this is one scan and no shuffle. With one, equal requests collapse on
    the map side before anything wide is shuffled; each different request is looked up and
    scored once, and its result is joined back to narrow rows. The join has one row per
    key on the result side, so a busy key can be split.
    """
    df = requests.withColumn("segment", normalize_segment("merchant_segment", policy))
    df = df.withColumn("key", cache_key(*TEXT_COLUMNS, "segment", namespace=namespace))
    if "latency_ms" not in df.columns:
        df = df.withColumn("latency_ms", F.lit(None).cast("double"))
    missing = F.col("prompt").isNull() | F.col("response_a").isNull() | F.col("response_b").isNull()
    blank = is_blank("prompt") | is_blank("response_a") | is_blank("response_b")
    df = df.withColumn("reason", F.when(F.col("segment").isNull(), "unknown segment")
                       .when(missing, "missing text").when(blank, "empty input after redaction"))

    identity = [c for c in requests.columns if c not in TEXT_COLUMNS and c != "latency_ms"]
    narrow = identity + ["segment", "key", "latency_ms", "reason"]
    if cache is None:
        open_rows = F.col("reason").isNull()
        scored = _score_open(df, scorer, dialect, open_rows, narrow).withColumns({
            "cached": F.lit(None).cast(RESULT), "from_cache": F.lit(False)})
    else:
        distinct = (df.where(F.col("reason").isNull()).groupBy("key")
                    .agg(*[F.first(c).alias(c) for c in (*TEXT_COLUMNS, "segment")]))
        looked_up = cache_ops.with_cached(distinct, cache, now, ttl)
        answers = _score_open(looked_up, scorer, dialect, ~F.col("from_cache"),
                              ["key", "cached", "from_cache"]).withColumnRenamed("key", "_key")
        # Refused rows match nothing; a key from their content keeps them off one partition.
        spread = F.concat(F.lit("-"), F.hex(F.xxhash64(*TEXT_COLUMNS, *identity)))
        rows = df.withColumn("_key", F.when(F.col("reason").isNull(), F.col("key")).otherwise(spread))
        scored = (rows.select(*narrow, "_key").join(answers, "_key", "left").drop("_key")
                  .withColumn("from_cache", F.coalesce("from_cache", F.lit(False))))

    usable = F.col("from_cache") | scoring.valid_probabilities("probabilities")
    scored = scored.withColumn("reason", F.coalesce("reason", F.when(~usable, "invalid probabilities")))
    good = F.col("reason").isNull()
    scored = with_result_columns(scored)
    merged = {name: F.when(good, F.when(F.col("from_cache"), F.col("cached")[name]).otherwise(F.col(name)))
              for name in RESULT.fieldNames()}
    return scored.select(*identity, "segment", "key", *[c.alias(n) for n, c in merged.items()],
                         "from_cache", "reason")


def _score_open(df: DataFrame, scorer: Scorer, dialect: Dialect, wanted: Column, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``probabilities``; texts of unwanted rows do not travel to the scorer."""
    ready = prepare(df, dialect)
    ready = ready.select(*keep, F.when(wanted, F.col("input_text")).alias("input_text"),
                         F.when(wanted, F.col("x_aux")).alias("x_aux"))
    return computed_once(scorer(ready).select(*keep, "probabilities"), "probabilities")


def results(outcome: DataFrame) -> DataFrame:
    """Scored rows, from the cache or fresh."""
    return outcome.where(F.col("reason").isNull()).drop("reason")


def refused(outcome: DataFrame) -> DataFrame:
    """Rows without a result, with their reason."""
    return outcome.where(F.col("reason").isNotNull())


def new_entries(outcome: DataFrame, now: Column) -> DataFrame:
    """Cache rows to append for the fresh results, one per key."""
    return cache_ops.entries(results(outcome), now)


def score_and_store(requests: DataFrame, scorer: Scorer, now: Column, outcome_path: str,
                    cache_path: str | None = None, **options) -> DataFrame:
    """Score a request table, write the outcome once, then append the new cache entries.

    The entries come from the written outcome, so texts are not scored again. A repeated
    run overwrites its outcome and appends equal entries, of which lookups see one.
    """
    spark = requests.sparkSession
    cache = None
    if cache_path:
        exists = path_exists(spark, cache_path)
        cache = read_cache(spark, cache_path) if exists else spark.createDataFrame([], CACHE_ENTRY)
    outcome = score_requests(requests, scorer, now, cache, **options)
    outcome.write.mode("overwrite").parquet(outcome_path)
    stored = spark.read.schema(outcome.schema).parquet(outcome_path)
    if cache_path:
        append_cache(new_entries(stored, now), cache_path)
    return stored


def score_batches(batches: DataFrame, head: scoring.FusionHead, items: str = "items") -> DataFrame:
    """Score batch requests inside their row: (batch_id, results, total_latency_ms).

    Each step rewrites the item array, so order is kept, nothing is exploded and no
    shuffle regroups the items. Batches that break the contract are left out (see
    ``contracts.check_batches``); an item left blank by redaction has a null winner.
    """
    fields = batches.schema[items].dataType.elementType.fieldNames()

    def step(df: DataFrame, fields_of: Callable) -> DataFrame:
        return df.withColumn("_items", F.transform("_items", lambda i: F.struct(
            *[column.alias(name) for name, column in fields_of(i).items()])))

    df = contracts.valid(contracts.check_batches(batches, items)).select(
        "batch_id", F.col(items).alias("_items"))
    df = step(df, lambda i: {
        **{c: redact(i[c]) for c in TEXT_COLUMNS},
        "segment": normalize_segment(i["merchant_segment"], "exact"),
        "conversation_id": i["conversation_id"],
        "latency_ms": i["latency_ms"] if "latency_ms" in fields else F.lit(None).cast("double"),
    })
    df = step(df, lambda i: {
        **{c: i[c] for c in ("response_a", "response_b", "segment", "conversation_id", "latency_ms")},
        "blank": is_blank(i["prompt"]) | is_blank(i["response_a"]) | is_blank(i["response_b"]),
        "wa": lower_words(i["response_a"]), "wb": lower_words(i["response_b"]),
        "sa": words_per_sentence(i["response_a"]), "sb": words_per_sentence(i["response_b"]),
    })
    df = step(df, lambda i: {
        **{c: i[c] for c in ("conversation_id", "latency_ms", "blank")},
        "x_aux": aux_vector(pair_features(
            i["response_a"], i["response_b"], i["wa"], i["wb"], i["sa"], i["sb"]), i["segment"]),
    })
    df = step(df, lambda i: {
        **{c: i[c] for c in ("conversation_id", "latency_ms", "blank")},
        "logits": scoring.fusion_logits(head, None, i["x_aux"]),
    })
    df = step(df, lambda i: {
        **{c: i[c] for c in ("conversation_id", "latency_ms")},
        "p": F.when(~i["blank"], scoring.softmax(i["logits"])),
    })
    df = step(df, lambda i: {
        "conversation_id": i["conversation_id"],
        "prob_a_wins": i["p"][0], "prob_b_wins": i["p"][1], "prob_tie": i["p"][2],
        "winner": scoring.winner(i["p"]), "latency_ms": i["latency_ms"],
    })
    total = F.aggregate("_items", F.lit(0.0),
                        lambda s, i: s + F.coalesce(i["latency_ms"], F.lit(0.0)))
    return df.select("batch_id", F.col("_items").alias("results"), total.alias("total_latency_ms"))
