"""Counters, latency, drift, alerts, retention, feedback."""

from pyspark.sql import functions as F

from prefrank.catalog import views as v
from prefrank.catalog.registry import query
from prefrank.fixed_values import INFERENCE_LATENCY_BOUNDS
from prefrank.operators import feedback, monitoring


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("inference_counts", f"WITH {v.REQUESTS_SQL} SELECT intent, segment, count(*) AS n FROM requests GROUP BY 1, 2")
def inference_counts(spark, folder):
    return monitoring.label_counts(v.requests(spark, folder), "intent", "segment")


@query("request_counts", """SELECT CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS method,
  '/' || event_type AS endpoint, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
  count(*) AS n FROM events GROUP BY 1, 2, 3""")
def request_counts(spark, folder):
    rows = v.table(spark, folder, "events").select(
        F.when(F.col("event_type") == "view", "GET").otherwise("POST").alias("method"),
        F.concat(F.lit("/"), "event_type").alias("endpoint"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"))
    return monitoring.label_counts(rows, "method", "endpoint", "status_code")


_LIMITS = [*INFERENCE_LATENCY_BOUNDS, None]


@query("latency_histogram", "WITH " + v.REQUESTS_SQL + " " + " UNION ALL ".join(
    f"""SELECT intent, '{'+Inf' if b is None else b}' AS le,
    count(*) FILTER (WHERE {'true' if b is None else f'latency_ms / 100 <= {b}'}) AS bucket_count,
    round(sum(latency_ms / 100), 6) AS latency_sum, count(*) AS latency_count FROM requests GROUP BY intent"""
    for b in _LIMITS))
def latency_histogram(spark, folder):
    rows = v.requests(spark, folder).withColumn("seconds", F.col("latency_ms") / 100)
    return _rounded(monitoring.latency_histogram(rows, "seconds", INFERENCE_LATENCY_BOUNDS, ["intent"]),
                    "latency_sum")


_TARGETS = ((0.5, 100), (0.95, 200), (0.99, 300))


@query("latency_percentiles", "WITH " + v.REQUESTS_SQL + " " + " UNION ALL ".join(
    f"""SELECT intent, {s} AS share, round(quantile_cont(latency_ms, {s}), 6) AS latency_ms,
    {t}.0 AS target_ms, quantile_cont(latency_ms, {s}) > {t} AS breached FROM requests GROUP BY intent"""
    for s, t in _TARGETS))
def latency_percentiles(spark, folder):
    return _rounded(monitoring.latency_percentiles(v.requests(spark, folder), "latency_ms", by=["intent"]),
                    "latency_ms")


@query("price_percentiles", " UNION ALL ".join(
    f"SELECT {s} AS share, round(quantile_cont(l_extendedprice, {s}), 6) AS quantile FROM lineitem"
    for s in (0.01, 0.25, 0.5, 0.95, 0.99)))
def price_percentiles(spark, folder):
    """The exact quantile operator on the largest table."""
    from prefrank.operators.ordering import exact_quantiles

    rows = v.table(spark, folder, "lineitem")
    return _rounded(exact_quantiles(rows, "l_extendedprice", (0.01, 0.25, 0.5, 0.95, 0.99)), "quantile")


@query("limit_breaches", f"""WITH {v.REQUESTS_SQL} SELECT segment, count(*) AS requests,
  count(*) FILTER (WHERE latency_ms > 300) AS breaches FROM requests GROUP BY segment""")
def limit_breaches(spark, folder):
    return monitoring.limit_breaches(v.requests(spark, folder), "latency_ms", by=["segment"])


@query("cache_stats", """WITH k AS (SELECT user_id, min(event_id) AS first_id FROM events GROUP BY user_id)
  SELECT count(*) FILTER (WHERE event_id <> first_id) AS hits, count(*) FILTER (WHERE event_id = first_id) AS misses
  FROM events JOIN k USING (user_id)""")
def cache_stats(spark, folder):
    """A user's first event misses, the later ones hit."""
    e = v.table(spark, folder, "events").select("event_id", "user_id")
    first = e.groupBy("user_id").agg(F.min("event_id").alias("first_id"))
    rows = e.join(first, "user_id").select((F.col("event_id") != F.col("first_id")).alias("from_cache"))
    return monitoring.cache_stats(rows)


_EDGES_SQL = ", ".join(f"quantile_cont(value, {i / 10})" for i in range(1, 10))
_PSI_SQL = f"""edges AS (SELECT [{_EDGES_SQL}] AS e FROM events WHERE ts < TIMESTAMP '2024-01-16'),
  binned AS (SELECT len(list_filter(e, lambda x: x < value)) AS bin, ts < TIMESTAMP '2024-01-16' AS base FROM events, edges),
  counts AS (SELECT bin, count(*) FILTER (WHERE base) AS b, count(*) FILTER (WHERE NOT base) AS c
             FROM binned GROUP BY bin),
  shares AS (SELECT greatest(coalesce(b, 0)::DOUBLE / (SELECT sum(b) FROM counts), 1e-6) AS p,
                    greatest(coalesce(c, 0)::DOUBLE / (SELECT sum(c) FROM counts), 1e-6) AS q
             FROM range(0, 10) r(i) LEFT JOIN counts ON bin = i),
  psi AS (SELECT sum((q - p) * ln(q / p)) AS psi FROM shares)"""


def _psi(spark, folder):
    e = v.requests(spark, folder).withColumnRenamed("latency_ms", "value")
    early = F.col("ts") < F.to_timestamp(F.lit("2024-01-16 00:00:00"))
    return monitoring.population_stability(e.where(early), e.where(~early), "value")


@query("psi_drift", f"WITH {_PSI_SQL} SELECT round(psi, 6) AS psi, psi > 0.2 AS drifted FROM psi")
def psi_drift(spark, folder):
    """The second half of the month against the first."""
    return _rounded(_psi(spark, folder), "psi")


@query("psi_shifted", """WITH edges AS (SELECT [""" + ", ".join(
    f"quantile_cont(l_extendedprice, {i / 10})" for i in range(1, 10)) + """] AS e
    FROM lineitem WHERE l_returnflag = 'N'),
  binned AS (SELECT len(list_filter(e, lambda x: x < l_extendedprice * CASE WHEN l_returnflag = 'N' THEN 1 ELSE 1.5 END))
    AS bin, l_returnflag = 'N' AS base FROM lineitem, edges),
  counts AS (SELECT bin, count(*) FILTER (WHERE base) AS b, count(*) FILTER (WHERE NOT base) AS c FROM binned GROUP BY bin),
  shares AS (SELECT greatest(coalesce(b, 0)::DOUBLE / (SELECT sum(b) FROM counts), 1e-6) AS p,
                    greatest(coalesce(c, 0)::DOUBLE / (SELECT sum(c) FROM counts), 1e-6) AS q
             FROM range(0, 10) r(i) LEFT JOIN counts ON bin = i)
  SELECT round(sum((q - p) * ln(q / p)), 6) AS psi, sum((q - p) * ln(q / p)) > 0.2 AS drifted FROM shares""")
def psi_shifted(spark, folder):
    """Returned lines at one and a half times their price against kept lines."""
    rows = v.table(spark, folder, "lineitem")
    kept = rows.where(F.col("l_returnflag") == "N").select("l_extendedprice")
    returned = rows.where(F.col("l_returnflag") != "N").select(
        (F.col("l_extendedprice") * 1.5).alias("l_extendedprice"))
    return _rounded(monitoring.population_stability(kept, returned, "l_extendedprice"), "psi")


@query("alerts", f"""WITH {_PSI_SQL},
  m AS (SELECT 'latency_p99_ms' AS metric, quantile_cont(value, 0.99) AS value FROM events
        UNION ALL SELECT 'psi', psi FROM psi
        UNION ALL SELECT 'pii_scrubbed_cpf', count(*)::DOUBLE FROM documents
                  WHERE regexp_matches(text, '{v.MAIN_RULES_SQL[0][0]}')
        UNION ALL SELECT 'pii_scrubbed_card', count(*)::DOUBLE FROM documents
                  WHERE {v.redact_sql('text', v.MAIN_RULES_SQL[:2])} <> {v.redact_sql('text', v.MAIN_RULES_SQL[:3])}),
  r(alert, metric, threshold, severity, action) AS (VALUES
    ('p99_breach', 'latency_p99_ms', 300.0, 'critical', 'page_oncall'),
    ('psi_drift', 'psi', 0.2, 'warning', 'trigger_retrain_pipeline'),
    ('pii_leak', 'pii_scrubbed_cpf', 0.0, 'critical', 'block_and_audit'),
    ('p99_watch', 'latency_p99_ms', 50.0, 'warning', 'notify'),
    ('card_watch', 'pii_scrubbed_card', 0.0, 'warning', 'notify'))
  SELECT alert, metric, round(value, 6) AS value, threshold::DOUBLE AS threshold, severity, action
  FROM m JOIN r USING (metric) WHERE value > threshold""")
def alerts(spark, folder):
    requests = v.requests(spark, folder)
    p99 = monitoring.latency_percentiles(requests, "latency_ms", ((0.99, 300.0),)).select(
        F.lit("latency_p99_ms").alias("metric"), F.col("latency_ms").alias("value"))
    psi = _psi(spark, folder).select(F.lit("psi").alias("metric"), F.col("psi").alias("value"))
    events = monitoring.pii_event_counts(v.table(spark, folder, "documents"), "text")
    pii = events.select(F.concat(F.lit("pii_scrubbed_"), "pii_type").alias("metric"),
                        F.col("n").cast("double").alias("value"))
    rules = monitoring.alert_rules(spark)
    watched = spark.createDataFrame([("p99_watch", "latency_p99_ms", 50.0, "warning", "notify"),
                                     ("card_watch", "pii_scrubbed_card", 0.0, "warning", "notify")], rules.schema)
    found = monitoring.alerts(p99.unionByName(psi).unionByName(pii), rules.unionByName(watched))
    return _rounded(found, "value")


@query("retention", f"""WITH {v.REQUESTS_SQL} SELECT event_id FROM requests
  WHERE ts >= TIMESTAMP '2024-04-15' - INTERVAL 90 DAYS""")
def retention(spark, folder):
    now = F.to_timestamp(F.lit("2024-04-15 00:00:00"))
    return monitoring.within_retention(v.requests(spark, folder), "ts", now).select("event_id")


_CONSENT_SQL = "consent AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND value > 60)"


@query("with_consent", f"WITH {_CONSENT_SQL} SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM consent)")
def with_consent(spark, folder):
    e = v.table(spark, folder, "events")
    consent = e.where((F.col("event_type") == "signup") & (F.col("value") > 60)).select("user_id")
    return monitoring.with_consent(e, consent, "user_id").select("event_id")


@query("without_consent",
       f"WITH {_CONSENT_SQL} SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM consent)")
def without_consent(spark, folder):
    e = v.table(spark, folder, "events")
    consent = e.where((F.col("event_type") == "signup") & (F.col("value") > 60)).select("user_id")
    return monitoring.without_consent(e, consent, "user_id").select("event_id")


@query("traffic_split", """SELECT user_id, CASE WHEN ('0x' || substring(md5(user_id::VARCHAR), 1, 7))::BIGINT
    < 80530636 THEN 'challenger' ELSE 'champion' END AS arm, count(*) AS n FROM events GROUP BY 1, 2""")
def traffic_split(spark, folder):
    rows = v.table(spark, folder, "events").withColumn("arm", monitoring.traffic_split("user_id", 0.3))
    return monitoring.label_counts(rows, "user_id", "arm")


_MATCHED_SQL = """p AS (SELECT user_id, ts, event_id, ['A','B','tie'][event_id % 3 + 1] AS predicted
    FROM events WHERE event_type = 'view'),
  f AS (SELECT user_id, ts, event_id, ['A','B','tie'][user_id % 3 + 1] AS actual
    FROM events WHERE event_type = 'purchase'),
  matched AS (SELECT f.event_id, f.user_id, f.actual, p.predicted FROM f ASOF LEFT JOIN p
    ON f.user_id = p.user_id AND f.ts >= p.ts)"""


def _matched(spark, folder):
    e = v.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    predictions = e.where(F.col("event_type") == "view").select(
        "user_id", "ts", "event_id", v.pick(("A", "B", "tie"), F.col("event_id") % 3).alias("predicted"))
    given = e.where(F.col("event_type") == "purchase").select(
        "user_id", "ts", "event_id", v.pick(("A", "B", "tie"), F.col("user_id") % 3).alias("actual"))
    return feedback.latest_before(predictions, given, "user_id", "ts", "predicted", "event_id")


@query("feedback_matches", f"WITH {_MATCHED_SQL} SELECT event_id, actual, predicted FROM matched")
def feedback_matches(spark, folder):
    return _matched(spark, folder).select("event_id", "actual", "predicted")


@query("feedback_accuracy", f"""WITH {_MATCHED_SQL} SELECT actual, count(*) AS feedback, count(predicted) AS matched,
  round(avg((predicted = actual)::INT), 6) AS accuracy FROM matched GROUP BY actual""")
def feedback_accuracy(spark, folder):
    rows = feedback.realised_accuracy(_matched(spark, folder), "predicted", "actual", ["actual"])
    return _rounded(rows, "accuracy")
