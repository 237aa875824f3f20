"""Streaming forms run over the check tables until their input is used up."""

from pyspark.sql import functions as F

from prefrank import session
from prefrank.catalog import views as v
from prefrank.catalog.metric_queries import _BEST
from prefrank.catalog.privacy_queries import _TYPES
from prefrank.catalog.quality_queries import FEEDBACK_ERRORS_SQL, FEEDBACK_SQL, feedback
from prefrank.catalog.registry import query
from prefrank.catalog.scoring_queries import _P_SQL, _SCORED_SQL, _WINNER_SQL, PROBABILITIES
from prefrank.operators.ordering import exact_quantiles
from prefrank.plans import scoring as plan
from prefrank.sources.reports import feedback_json
from prefrank.streaming import feeds, lateness, panes, repeats, run_watch, versions

STAMP = "yyyy-MM-dd HH:mm:ss"
_STAMP_SQL = "'%Y-%m-%d %H:%M:%S'"


def stream_table(spark, folder, name, schema=None):
    """A check table as a stream.

    As a glob the path may be a single file or a folder; a plain path must be a folder.
    """
    schema = schema or v.table(spark, folder, name).schema
    return feeds.read_table(spark, f"{folder}/{name}.parque[t]", schema)


def events(spark, folder):
    stream = stream_table(spark, folder, "events")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run(spark, df, name):
    """Append-mode stream into Parquet, then the written rows."""
    out = session.scratch_path(spark, name)
    feeds.start(df, f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


def run_complete(spark, df, name):
    """Complete-mode stream, then its last result."""
    out = session.scratch_path(spark, name)
    feeds.start_replacing(df, f"{out}/rows", f"{out}/state").awaitTermination()
    return feeds.latest_batch(spark, f"{out}/rows")


def run_updating(spark, df, name, *keys):
    """Update-mode stream, then the newest row of each key."""
    out = session.scratch_path(spark, name)
    versions.start_updating(df, f"{out}/rows", f"{out}/state").awaitTermination()
    return versions.latest_rows(spark, f"{out}/rows", df.schema, *keys)


def stamp(column):
    return F.date_format(column, STAMP).alias(column)


@query("stream_tumbling_counts", f"""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), {_STAMP_SQL}) AS window_start,
  event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_tumbling_counts(spark, folder):
    """Open windows too: the newest version of each window and label."""
    counts = feeds.tumbling_counts(events(spark, folder), "ts", "event_type")
    return run_updating(spark, counts, "tumbling", "window_start", "event_type").select(stamp("window_start"), "event_type", "n")


@query("stream_closed_windows", f"""WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n
    FROM events GROUP BY 1, 2)
  SELECT strftime(start, {_STAMP_SQL}) AS window_start, event_type, n FROM w
  WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_closed_windows(spark, folder):
    """Append mode: only windows the watermark has closed."""
    counts = feeds.tumbling_counts(events(spark, folder), "ts", "event_type", window="1 day")
    return run(spark, counts, "closed").select(stamp("window_start"), "event_type", "n")


@query("stream_sliding_latency", f"""WITH w AS (
    SELECT unnest([time_bucket(INTERVAL 15 MINUTES, ts) - i * INTERVAL 15 MINUTES for i in range(0, 4)]) AS start, value
    FROM events)
  SELECT strftime(start, {_STAMP_SQL}) AS window_start, count(*) AS n, quantile_disc(value, 0.5) AS p50_ms,
         quantile_disc(value, 0.95) AS p95_ms, quantile_disc(value, 0.99) AS p99_ms,
         quantile_disc(value, 0.99) > 300 AS over_limit FROM w GROUP BY start""")
def stream_sliding_latency(spark, folder):
    """Exact percentiles: the stream counts the values of panes of a quarter, windows are ranked from the counts."""
    out = session.scratch_path(spark, "sliding")
    panes.start_counting(events(spark, folder), "ts", "value", f"{out}/rows", f"{out}/state").awaitTermination()
    return panes.exact_percentiles(panes.read_counts(spark, f"{out}/rows")).select(
        stamp("window_start"), "n", "p50_ms", "p95_ms", "p99_ms", "over_limit")


@query("stream_sliding_sketch", f"""WITH w AS (
    SELECT unnest([time_bucket(INTERVAL 15 MINUTES, ts) - i * INTERVAL 15 MINUTES for i in range(0, 16)]) AS start FROM events)
  SELECT strftime(start, {_STAMP_SQL}) AS window_start, count(*) AS n, true AS p50_near, true AS p95_near, true AS p99_near
  FROM w GROUP BY start""")
def stream_sliding_sketch(spark, folder):
    """Four-hour windows merged from panes of a quarter; every percentile's rank among the window's rows is near its share."""
    stream = panes.latency_panes(events(spark, folder), "ts", "value")
    stored = run_updating(spark, stream, "panes", "pane_start")
    # Stored, a row for each window has a known size: rows of the table meet it where they are, none is copied into a shuffle.
    place = session.scratch_path(spark, "percentiles")
    panes.sliding_percentiles(stored, "4 hours").write.parquet(place)
    found = spark.read.parquet(place)
    rows = v.table(spark, folder, "events").select(F.window(F.col("ts").cast("timestamp"), "4 hours", "15 minutes")["start"]
                                                   .alias("window_start"), "value")
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    # The share that a value stands for lies between the share of smaller rows and that of rows up to it.
    ranks = [F.count_if(F.col("value") < F.col(f"{p}_ms")).alias(f"{p}_below") for p in shares]
    ranks += [F.count_if(F.col("value") <= F.col(f"{p}_ms")).alias(f"{p}_upto") for p in shares]
    held = rows.join(found, "window_start").groupBy("window_start", "n").agg(*ranks)
    slack = 2 * panes.RANK_ERROR * F.col("n")
    return held.select(stamp("window_start"), "n", *[
        ((F.col(f"{p}_below") <= share * F.col("n") + slack) & (F.col(f"{p}_upto") >= share * F.col("n") - slack)).alias(f"{p}_near")
        for p, share in shares.items()])


@query("stream_run_decisions", f"""WITH {v.HISTORY_SQL}, {_BEST},
  stops AS (SELECT run_id, min(epoch) AS stop_epoch FROM best WHERE streak >= 2 GROUP BY run_id),
  ran AS (SELECT best.*, stop_epoch FROM best LEFT JOIN stops USING (run_id) WHERE stop_epoch IS NULL OR epoch <= stop_epoch)
  SELECT run_id, count(*)::INT AS epochs, max(epoch) AS last_epoch, max(best_so_far) AS best_auc,
    max(CASE WHEN improved THEN epoch END) AS best_epoch, any_value(stop_epoch) AS stop_epoch FROM ran GROUP BY run_id""")
def stream_run_decisions(spark, folder):
    """Histories written in three parts; the stream is started after each and goes on where it was."""
    out = session.scratch_path(spark, "runs")
    history = v.run_history(spark, folder).withColumns({c: F.lit(None).cast("double") for c in (
        "accuracy", "log_loss", "loss", "cls_loss", "rank_loss")})
    for low, high in ((0, 3), (3, 20), (20, 1000)):
        history.where((F.col("epoch") > low) & (F.col("epoch") <= high)).write.parquet(f"{out}/history/{low}")
        run_watch.start_watching(spark, f"{out}/history", f"{out}/rows", f"{out}/state").awaitTermination()
    return run_watch.current_decisions(spark, f"{out}/rows").drop("no_improve_count")


#: Five files by day, in which one event of ten comes twelve days late.
_FILE_SQL = "least(4, (date_diff('day', DATE '2024-01-01', ts::DATE) + CASE WHEN event_id % 10 = 0 THEN 12 ELSE 0 END) // 6)"


@query("stream_late_rows", f"""WITH e AS (SELECT *, {_FILE_SQL} AS file FROM events),
  marks AS (SELECT f.file, max(e.ts) - INTERVAL 1 HOUR AS mark FROM range(0, 5) f(file) LEFT JOIN e ON e.file < f.file GROUP BY f.file)
  SELECT event_id, coalesce(ts < date_trunc('millisecond', mark), false) AS late,
    CASE WHEN ts < date_trunc('millisecond', mark) THEN round(epoch(date_trunc('millisecond', mark)) - epoch(ts), 3) END AS delay_seconds
  FROM e JOIN marks USING (file)""")
def stream_late_rows(spark, folder):
    """Events in five files, each a micro-batch: kept and late rows are all rows, late ones with their delay."""
    out = session.scratch_path(spark, "late")
    rows = v.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01")) + F.when(F.col("event_id") % 10 == 0, 12).otherwise(0)
    filed = rows.withColumn("file", F.least(F.lit(4), F.floor(day / 6)))
    for file in range(5):
        filed.where(F.col("file") == file).drop("file").coalesce(1).write.mode("append").parquet(f"{out}/in")
    stream = feeds.read_table(spark, f"{out}/in", rows.schema, max_files=1)
    lateness.start_split(stream, "ts", f"{out}/rows", f"{out}/state").awaitTermination()
    stored = lateness.read_split(spark, f"{out}/rows", rows.schema)
    return stored.select("event_id", (F.col("arrival") == "late").alias("late"), F.round("delay_seconds", 3).alias("delay_seconds"))


@query("stream_sessions", f"""WITH g AS (SELECT user_id, ts,
    CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
  SELECT user_id, strftime(min(ts), {_STAMP_SQL}) AS session_start, count(*) AS turns FROM s
  GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOURS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(spark, folder):
    sessions = feeds.sessions(events(spark, folder), "user_id", "ts", gap="6 hours")
    return run(spark, sessions, "sessions").select("user_id", stamp("session_start"), "turns")


@query("stream_repeat_suppression", f"""WITH RECURSIVE kept(user_id, ts) AS (
    SELECT user_id, min(ts) FROM events GROUP BY user_id
    UNION ALL
    SELECT k.user_id, min(e.ts) FROM kept k JOIN events e ON e.user_id = k.user_id AND e.ts >= k.ts + INTERVAL 3600 SECONDS
    GROUP BY k.user_id)
  SELECT user_id, strftime(ts, {_STAMP_SQL}) AS ts FROM kept""")
def stream_repeat_suppression(spark, folder):
    out = session.scratch_path(spark, "repeats")
    requests = events(spark, folder).select("user_id", "ts")
    repeats.start_suppressing(requests, "user_id", "ts", out, f"{out}/state").awaitTermination()
    return repeats.read_kept(spark, out, requests.schema).select("user_id", stamp("ts"))


@query("stream_feedback_join", """SELECT v.event_id AS predicted_id, p.event_id AS feedback_id
  FROM events v JOIN events p ON v.event_id // 2 = p.event_id // 2
  WHERE v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 24 HOURS""")
def stream_feedback_join(spark, folder):
    """Neighbouring events share a conversation of at most two rows."""
    e = events(spark, folder).withColumn("conversation", F.floor(F.col("event_id") / 2))
    made = e.where(F.col("event_type") == "view").select(
        "conversation", F.col("event_id").alias("predicted_id"), F.col("ts").alias("made_at"))
    given = e.where(F.col("event_type") == "purchase").select(
        "conversation", F.col("event_id").alias("feedback_id"), F.col("ts").alias("given_at"))
    matched = feeds.match_feedback(made, given, "conversation", "made_at", "given_at")
    return run(spark, matched, "matches").select("predicted_id", "feedback_id")


_STEP_TYPES_SQL = ", ".join(
    f"CASE WHEN regexp_matches(s{i}, '{rule[0]}') THEN '{_TYPES[i]}' END" for i, rule in enumerate(v.MAIN_RULES_SQL))


def _chain_sql() -> str:
    steps = ["c0 AS (SELECT doc_id, text AS s0 FROM documents)"]
    for i, rule in enumerate(v.MAIN_RULES_SQL):
        steps.append(f"c{i + 1} AS (SELECT *, {v.redact_sql(f's{i}', (rule,))} AS s{i + 1} FROM c{i})")
    return ", ".join(steps)


@query("stream_redaction", f"""WITH {_chain_sql()} SELECT doc_id, s5 AS text,
  concat_ws(',', {_STEP_TYPES_SQL}) AS pii_types, {v.pii_sql('s5')} AS leak FROM c5""")
def stream_redaction(spark, folder):
    stream = stream_table(spark, folder, "documents", "doc_id long, text string")
    rows = run(spark, feeds.redact_messages(stream, "text"), "redacted")
    return rows.select("doc_id", "text", F.array_join("pii_types", ",").alias("pii_types"), "leak")


@query("stream_scoring", f"WITH {_SCORED_SQL} SELECT conversation_id, {_P_SQL}, {_WINNER_SQL} FROM preds")
def stream_scoring(spark, folder):
    """Requests written as a table, then scored as a stream with a cache."""
    out = session.scratch_path(spark, "scoring")
    requests = v.triples(spark, folder).where(F.col("response_b").isNotNull()).drop("winner")
    requests.write.parquet(f"{out}/requests")
    stream = feeds.read_table(spark, f"{out}/requests", requests.schema)
    scorer = plan.fusion_scorer(v.example_head())
    feeds.score_stream(stream, scorer, f"{out}/outcome", f"{out}/cache", f"{out}/state").awaitTermination()
    rows = plan.results(spark.read.parquet(f"{out}/outcome"))
    return rows.select("conversation_id", *[F.round(c, 6).alias(c) for c in PROBABILITIES], "winner")


@query("stream_feedback_ingest", f"""WITH {FEEDBACK_SQL}, c AS (SELECT *, {FEEDBACK_ERRORS_SQL} AS errors FROM feedback)
  SELECT errors = '' AS accepted, coalesce(channel, 'api') AS channel, actual_winner, count(*) AS n
  FROM c GROUP BY 1, 2, 3""")
def stream_feedback_ingest(spark, folder):
    """Feedback as JSON lines in, accepted and rejected tables out."""
    out = session.scratch_path(spark, "feedback")
    feedback_json(feedback(spark, folder)).write.text(f"{out}/inbox")
    raw = feeds.read_json_lines(spark, f"{out}/inbox")
    feeds.ingest_feedback(raw, f"{out}/events", f"{out}/state").awaitTermination()
    return feeds.read_feedback(spark, f"{out}/events").groupBy("accepted", "channel", "actual_winner").agg(
        F.count("*").alias("n"))


_BASE = ", ".join(f"quantile_cont(value, {i / 10})" for i in range(1, 10))


@query("stream_drift", f"""WITH edges AS (SELECT [{_BASE}] AS e FROM events),
  b AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS d, len(list_filter(e, lambda x: x < value)) AS bin FROM events, edges),
  days AS (SELECT d, count(*) AS total FROM b GROUP BY d),
  c AS (SELECT d, bin, count(*) AS n FROM b GROUP BY 1, 2),
  q AS (SELECT days.d, total, greatest(coalesce(n, 0)::DOUBLE / total, 1e-6) AS q
        FROM days CROSS JOIN range(0, 10) r(i) LEFT JOIN c ON c.d = days.d AND c.bin = i)
  SELECT strftime(d, {_STAMP_SQL}) AS window_start, any_value(total) AS n, round(sum((q - 0.1) * ln(q / 0.1)), 6) AS psi,
         sum((q - 0.1) * ln(q / 0.1)) > 0.2 AS drifted FROM q GROUP BY d""")
def stream_drift(spark, folder):
    """Daily drift of a value against nine cut points of the whole table."""
    shares = [i / 10 for i in range(1, 10)]
    quantiles = exact_quantiles(v.table(spark, folder, "events"), "value", shares)
    edges = sorted(r["quantile"] for r in quantiles.collect())
    counts = run_complete(spark, feeds.binned_counts(events(spark, folder), "ts", "value", edges), "drift")
    scored = feeds.windowed_stability(counts, [0.1] * 10)
    return scored.select(stamp("window_start"), "n", F.round("psi", 6).alias("psi"), "drifted")
