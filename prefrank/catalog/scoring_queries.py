"""Scorers, cache, batches, evaluation, training."""

import numpy as np
from pyspark.sql import functions as F

from prefrank.catalog import views as v
from prefrank.catalog.metric_queries import _BINS, _ECE, _POINT, _auc_sql
from prefrank.catalog.registry import query
from prefrank.functions import scoring
from prefrank.functions.text import cache_key
from prefrank.operators import cache, dataset, metrics
from prefrank.plans import evaluation
from prefrank.plans import scoring as plan


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


PROBABILITIES = ("prob_a_wins", "prob_b_wins", "prob_tie")
_P_SQL = "round(p0, 6) AS prob_a_wins, round(p1, 6) AS prob_b_wins, round(p2, 6) AS prob_tie"
_WINNER_SQL = "['A','B','tie'][pred + 1] AS winner"
_REDACTED_SQL = f"""redacted AS (SELECT * REPLACE ({v.redact_sql('prompt')} AS prompt,
  {v.redact_sql('response_a')} AS response_a, {v.redact_sql('response_b')} AS response_b) FROM clean)"""
_SCORED_SQL = (f"{v.CLEAN_SQL}, {_REDACTED_SQL}, {v.pair_features_sql('f', 'redacted')}, "
               f"{v.fusion_sql('logit', 'f')}, {v.softmax_sql('preds', 'logit')}")


@query("softmax_winner", f"WITH {v.VECTORS_SQL} SELECT vec_id, {_P_SQL}, {_WINNER_SQL} FROM preds")
def softmax_winner(spark, folder):
    rows = plan.with_result_columns(v.vector_predictions(spark, folder))
    return _rounded(rows.select("vec_id", *PROBABILITIES, "winner"), *PROBABILITIES)


@query("fusion_head_scores", f"""WITH {v.PAIRS_SQL}, e AS (
  SELECT pairs.*, embedding FROM pairs JOIN embeddings ON vec_id = doc_id),
  {v.pair_features_sql('f', 'e')}, {v.fusion_sql('logit', 'f', 64)}, {v.softmax_sql('preds', 'logit')}
  SELECT doc_id, {_P_SQL}, {_WINNER_SQL} FROM preds""")
def fusion_head_scores(spark, folder):
    vectors = v.table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    rows = v.document_pairs(spark, folder).join(vectors, "doc_id")
    rows = plan.with_aux_vector(rows)
    scored = plan.fusion_scorer(v.example_head(64), "embedding")(rows)
    return _rounded(plan.with_result_columns(scored).select("doc_id", *PROBABILITIES, "winner"), *PROBABILITIES)


@query("score_triples", f"WITH {_SCORED_SQL} SELECT conversation_id, {_P_SQL}, {_WINNER_SQL} FROM preds")
def score_triples(spark, folder):
    clean = dataset.clean_preferences(v.triples(spark, folder))
    scored = plan.score_triples(clean, plan.fusion_scorer(v.example_head()))
    return _rounded(scored.select("conversation_id", *PROBABILITIES, "winner"), *PROBABILITIES)


@query("score_document_pairs", f"""WITH {v.PAIRS_SQL}, clean AS (SELECT * FROM pairs),
  {_REDACTED_SQL}, {v.pair_features_sql('f', 'redacted')}, {v.fusion_sql('logit', 'f')},
  {v.softmax_sql('preds', 'logit')} SELECT doc_id, {_P_SQL}, {_WINNER_SQL} FROM preds""")
def score_document_pairs(spark, folder):
    scored = plan.score_triples(v.document_pairs(spark, folder), plan.fusion_scorer(v.example_head()))
    return _rounded(scored.select("doc_id", *PROBABILITIES, "winner"), *PROBABILITIES)


_BY_SEGMENT = f"""WITH {_SCORED_SQL} SELECT segment, count(*) AS n,
  round(avg((pred = label)::INT), 6) AS accuracy, round(avg(conf), 6) AS preference_score_mean,
  round(avg(-ln(least(greatest(CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 2.220446049250313e-16),
    1 - 2.220446049250313e-16))), 6) AS log_loss FROM preds GROUP BY segment"""


@query("segment_scorecard", _BY_SEGMENT)
def segment_scorecard(spark, folder):
    """Load, redact, featurise, score and evaluate per segment."""
    clean = dataset.clean_preferences(v.triples(spark, folder))
    scored = plan.score_triples(clean, plan.fusion_scorer(v.example_head()))
    rows = metrics.point_metrics(scored, ["segment"])
    return _rounded(rows, "accuracy", "log_loss", "preference_score_mean")


class FeatureSoftmax:
    """Stand-in for a user's model: softmax over three of the features."""

    def __call__(self, texts, aux):
        logits = aux[:, [2, 5, 7]].astype("float64")
        exps = np.exp(logits - logits.max(axis=1, keepdims=True))
        return exps / exps.sum(axis=1, keepdims=True)


@query("batch_scorer", f"""WITH {v.CLEAN_SQL}, {_REDACTED_SQL}, {v.pair_features_sql('f', 'redacted')},
  logit AS (SELECT *, x2::FLOAT::DOUBLE AS l0, x5::FLOAT::DOUBLE AS l1, x7::FLOAT::DOUBLE AS l2 FROM f),
  {v.softmax_sql('preds', 'logit')} SELECT conversation_id, {_P_SQL}, {_WINNER_SQL} FROM preds""")
def batch_scorer(spark, folder):
    clean = dataset.clean_preferences(v.triples(spark, folder))
    scored = plan.score_triples(clean, plan.batch_scorer(FeatureSoftmax))
    return _rounded(scored.select("conversation_id", *PROBABILITIES, "winner"), *PROBABILITIES)


_KEY_SQL = "'pref:' || sha256(prompt || '|' || response_a || '|' || response_b || '|' || segment)"


@query("cached_scoring", f"""WITH {_SCORED_SQL},
  k AS (SELECT conversation_id, segment AS s, split_part(conversation_id, '-', 1)::BIGINT % 3 AS third FROM clean)
  SELECT conversation_id, third = 0 AS from_cache,
    CASE WHEN third = 0 THEN 0.6 ELSE round(p0, 6) END AS prob_a_wins,
    CASE WHEN third = 0 THEN 0.3 ELSE round(p1, 6) END AS prob_b_wins,
    CASE WHEN third = 0 THEN 0.1 ELSE round(p2, 6) END AS prob_tie,
    CASE WHEN third = 0 THEN 'A' ELSE ['A','B','tie'][pred + 1] END AS winner,
    CASE WHEN third = 0 THEN 12.5 END AS latency_ms
  FROM preds JOIN k USING (conversation_id)""")
def cached_scoring(spark, folder):
    """A third of the requests has a live entry, a third an expired one."""
    requests = v.triples(spark, folder).where(F.col("response_b").isNotNull()).drop("winner")
    now = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    third = F.split("conversation_id", "-")[0].cast("long") % 3
    key = cache_key("prompt", "response_a", "response_b", F.upper("merchant_segment"))
    stored = F.to_json(F.struct(
        F.lit(0.6).alias("prob_a_wins"), F.lit(0.3).alias("prob_b_wins"), F.lit(0.1).alias("prob_tie"),
        F.lit("A").alias("winner"), F.lit(12.5).alias("latency_ms")))
    age = F.when(third == 0, F.expr("INTERVAL 10 MINUTES")).otherwise(F.expr("INTERVAL 2 HOURS"))
    entries = requests.where(third < 2).select(
        key.alias("key"), stored.alias("value"), (now - age).alias("written_at"))
    outcome = plan.score_requests(requests, plan.fusion_scorer(v.example_head()), now, entries)
    return _rounded(plan.results(outcome).select("conversation_id", "from_cache", *PROBABILITIES, "winner", "latency_ms"),
                    *PROBABILITIES)


@query("cache_lookup", """WITH c AS (
    SELECT user_id, arg_max(value, ts) AS latency FROM events
    WHERE event_type = 'purchase' AND ts > TIMESTAMP '2024-01-31' - INTERVAL 5 DAYS
      AND ts <= TIMESTAMP '2024-01-31' GROUP BY user_id)
  SELECT e.event_id, c.user_id IS NOT NULL AS from_cache, c.latency AS cached_latency
  FROM events e LEFT JOIN c USING (user_id) WHERE e.event_type = 'view'""")
def cache_lookup(spark, folder):
    e = v.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    requests = e.where(F.col("event_type") == "view").select("event_id", F.col("user_id").cast("string").alias("key"))
    entry = F.to_json(F.struct(F.lit("A").alias("winner"), F.col("value").alias("latency_ms")))
    entries = e.where(F.col("event_type") == "purchase").select(
        F.col("user_id").cast("string").alias("key"), entry.alias("value"), F.col("ts").alias("written_at"))
    now = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    found = cache.with_cached(requests, entries, now, ttl=5 * 86400)
    return found.select("event_id", "from_cache", F.col("cached.latency_ms").alias("cached_latency"))


_ITEMS_SQL = f"""{v.CLEAN_SQL}, items AS (
  SELECT conversation_id, 0 AS position, prompt, response_a, response_b, segment FROM clean
  UNION ALL SELECT conversation_id, 1, prompt, response_b, response_a, segment FROM clean),
  ok AS (SELECT * FROM items WHERE conversation_id IN (SELECT conversation_id FROM clean WHERE
    length(prompt) <= 4096 AND length(response_a) <= 4096 AND length(response_b) <= 4096
    AND regexp_matches(prompt, '\\S') AND regexp_matches(response_a, '\\S') AND regexp_matches(response_b, '\\S'))),
  {v.pair_features_sql('f', 'ok')}, {v.fusion_sql('logit', 'f')}, {v.softmax_sql('preds', 'logit')}"""


@query("batch_requests", f"""WITH {_ITEMS_SQL}
  SELECT conversation_id AS batch_id, string_agg(['A','B','tie'][pred + 1], ',' ORDER BY position) AS winners,
         round(sum(p0), 6) AS a_mass, count(*) * 2.5 AS total_latency_ms FROM preds GROUP BY conversation_id""")
def batch_requests(spark, folder):
    """Each triple in both orders as one batch of two items."""
    clean = dataset.clean_preferences(v.triples(spark, folder))

    def item(a, b):
        return F.struct("prompt", F.col(a).alias("response_a"), F.col(b).alias("response_b"),
                        F.col("segment").alias("merchant_segment"), "conversation_id",
                        F.lit(2.5).alias("latency_ms"))

    batches = clean.select(F.col("conversation_id").alias("batch_id"), F.array(
        item("response_a", "response_b"), item("response_b", "response_a")).alias("items"))
    scored = plan.score_batches(batches, v.example_head())
    mass = F.aggregate("results", F.lit(0.0), lambda s, r: s + r["prob_a_wins"])
    return scored.select("batch_id", F.array_join(F.col("results.winner"), ",").alias("winners"),
                         F.round(mass, 6).alias("a_mass"), "total_latency_ms")


@query("best_candidate", f"""WITH {_SCORED_SQL} SELECT preds.conversation_id,
  CASE pred WHEN 0 THEN preds.response_a WHEN 1 THEN preds.response_b END AS preferred FROM preds""")
def best_candidate(spark, folder):
    clean = dataset.clean_preferences(v.triples(spark, folder))
    scored = plan.score_triples(clean, plan.fusion_scorer(v.example_head()))
    return plan.with_preferred_text(scored).select("conversation_id", "preferred")


@query("evaluate_triples", f"""WITH {_SCORED_SQL}, {_auc_sql('preds')}, {_BINS}
  SELECT round((SELECT avg(auc) FROM aucs), 6) AS auc, round({_ECE}, 6) AS ece, {_POINT} FROM preds""")
def evaluate_triples(spark, folder):
    """Load, score, metric bundle; stores the predictions between scoring and metrics."""
    clean = dataset.clean_preferences(v.triples(spark, folder))
    result = evaluation.evaluate(clean, plan.fusion_scorer(v.example_head()))
    return _rounded(result, "accuracy", "auc", "log_loss", "preference_score_mean", "ece")


@query("log_loss_by_label", f"""WITH {v.VECTORS_SQL} SELECT label, count(*) AS n,
  round(avg(-ln(CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)), 6) AS log_loss FROM preds GROUP BY label""")
def log_loss_by_label(spark, folder):
    rows = v.vector_predictions(spark, folder).withColumn(
        "loss", scoring.row_log_loss("probabilities", "label"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("log_loss"))
