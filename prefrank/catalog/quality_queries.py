"""Loading, quality reports, contracts."""

from pyspark.sql import functions as F

from prefrank.catalog import views as v
from prefrank.catalog.registry import query
from prefrank.functions.scoring import winner
from prefrank.operators import contracts, dataset
from prefrank.operators.ordering import PRIMES, ROUNDS, round_constants
from prefrank.plans.validation import validation_report

_COLUMNS = "conversation_id, prompt, response_a, response_b, segment, label"


@query("load_preferences", f"WITH {v.CLEAN_SQL} SELECT {_COLUMNS} FROM clean")
def load_preferences(spark, folder):
    return dataset.clean_preferences(v.triples(spark, folder))


@query("limited_load", f"""WITH {v.TRIPLES_SQL.replace('triples AS (', 'every AS (')},
  triples AS (SELECT * FROM every ORDER BY conversation_id LIMIT 50),
  {v.CLEAN_ONLY_SQL}
  SELECT {_COLUMNS} FROM clean""")
def limited_load(spark, folder):
    """The loader's row limit, applied before null rows are dropped."""
    return dataset.clean_preferences(v.triples(spark, folder), max_rows=50, order="conversation_id")


@query("row_counts", f"""WITH {v.TRIPLES_SQL} SELECT count(*) AS rows,
  count(*) FILTER (WHERE response_b IS NULL) AS dropped,
  count(*) FILTER (WHERE response_b IS NOT NULL) AS kept FROM triples""")
def row_counts(spark, folder):
    return dataset.row_counts(v.triples(spark, folder))


def _round_sql(turn: int, factor: int, summand: int) -> str:
    """One round of the permutation as a lateral subquery; even turns move the left half."""
    own, other, side = ("l", "r", "width") if turn % 2 == 0 else ("r", "l", "height")
    first = f"(({other}{turn} * {factor} + {summand}) % {PRIMES[0]})"
    return (f"LATERAL (SELECT ({own}{turn} + ({first} * {first}) % {PRIMES[1]}) % {side} AS {own}{turn + 1}, "
            f"{other}{turn} AS {other}{turn + 1}) AS t{turn}")


_ONCE_SQL = "LATERAL (SELECT v // height AS l0, v % height AS r0) AS t, " + ", ".join(
    _round_sql(turn, *pair) for turn, pair in enumerate(round_constants(7)))


@query("epoch_order", f"""WITH RECURSIVE {v.CLEAN_SQL}, size AS (SELECT count(*) AS n,
    (floor(sqrt(count(*) - 1)) + 1)::BIGINT AS width FROM clean),
  sides AS (SELECT n, width, (n + width - 1) // width AS height FROM size),
  walk(conversation_id, label, v) AS (
    SELECT conversation_id, label, l{ROUNDS} * height + r{ROUNDS} FROM (
      SELECT conversation_id, label, row_number() OVER (ORDER BY conversation_id) - 1 AS v FROM clean) AS c, sides, {_ONCE_SQL}
    UNION ALL SELECT conversation_id, label, l{ROUNDS} * height + r{ROUNDS} FROM walk, sides, {_ONCE_SQL} WHERE v >= n)
  SELECT conversation_id, label, v::BIGINT AS position FROM walk, sides WHERE v < n""")
def epoch_order(spark, folder):
    rows = dataset.clean_preferences(v.triples(spark, folder)).select("conversation_id", "label")
    return dataset.epoch_order(rows, "conversation_id", seed=7)


@query("label_distribution", f"""WITH {v.TRIPLES_SQL}
  SELECT winner, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM triples), 6) AS pct,
         count(*)::DOUBLE / (SELECT count(*) FROM triples) < 0.1 AS underrepresented
  FROM triples WHERE winner IS NOT NULL GROUP BY winner""")
def label_distribution(spark, folder):
    rows = dataset.by_frequency(dataset.label_distribution(v.triples(spark, folder)))
    return rows.withColumn("pct", F.round("pct", 6))


@query("null_report", f"""WITH {v.TRIPLES_SQL}
  SELECT 'prompt' AS column, count(*) FILTER (WHERE prompt IS NULL) AS nulls FROM triples
  UNION ALL SELECT 'response_a', count(*) FILTER (WHERE response_a IS NULL) FROM triples
  UNION ALL SELECT 'response_b', count(*) FILTER (WHERE response_b IS NULL) FROM triples""")
def null_report(spark, folder):
    return dataset.null_report(v.triples(spark, folder))


@query("length_stats", """SELECT 'text' AS column, min(length(text))::BIGINT AS min_chars,
  round(avg(length(text)), 6) AS mean_chars, round(quantile_cont(length(text), 0.95), 6) AS p95_chars,
  max(length(text))::BIGINT AS max_chars FROM documents
  UNION ALL SELECT 'source', min(length(source)), round(avg(length(source)), 6),
  round(quantile_cont(length(source), 0.95), 6), max(length(source)) FROM documents""")
def length_stats(spark, folder):
    rows = dataset.length_stats(v.table(spark, folder, "documents"), ["text", "source"])
    return rows.withColumns({c: F.round(c, 6) for c in ("mean_chars", "p95_chars")})


@query("pii_rows", f"""WITH {v.PAIRS_SQL} SELECT count(*) AS checked, count(*) FILTER (WHERE
  {v.pii_sql('response_a')} OR {v.pii_sql('response_b')}) AS with_pii FROM pairs""")
def pii_rows(spark, folder):
    return dataset.pii_rows(v.document_pairs(spark, folder))


def _lengths_sql() -> str:
    forms = (("min", "min(length({c}))"), ("mean", "round(avg(length({c})), 6)"),
             ("p95", "round(quantile_cont(length({c}), 0.95), 6)"), ("max", "max(length({c}))"))
    return " UNION ALL ".join(
        f"SELECT 'length', '{c}', '{m}', CAST({e.format(c=c)} AS DOUBLE), 'INFO' FROM triples"
        for c in ("prompt", "response_a", "response_b") for m, e in forms)


_PII_ANY = " OR ".join(f"coalesce({v.pii_sql(c)}, false)" for c in ("prompt", "response_a", "response_b"))


@query("validation_report", f"""WITH {v.TRIPLES_SQL},
  p AS (SELECT count(*) AS n, count(*) FILTER (WHERE {_PII_ANY}) AS hits FROM triples),
  l AS (SELECT winner, count(*) AS c FROM triples WHERE winner IS NOT NULL GROUP BY winner)
  SELECT 'rows' AS "check", 'table' AS subject, 'rows' AS metric, n::DOUBLE AS value, 'INFO' AS status FROM p
  UNION ALL SELECT 'nulls', 'prompt', 'nulls', count(*), CASE WHEN count(*) > 0 THEN 'WARN' ELSE 'OK' END
    FROM triples WHERE prompt IS NULL
  UNION ALL SELECT 'nulls', 'response_a', 'nulls', count(*), CASE WHEN count(*) > 0 THEN 'WARN' ELSE 'OK' END
    FROM triples WHERE response_a IS NULL
  UNION ALL SELECT 'nulls', 'response_b', 'nulls', count(*), CASE WHEN count(*) > 0 THEN 'WARN' ELSE 'OK' END
    FROM triples WHERE response_b IS NULL
  UNION ALL SELECT 'labels', winner, 'count', c, CASE WHEN c::DOUBLE / n < 0.1 THEN 'WARN' ELSE 'OK' END FROM l, p
  UNION ALL SELECT 'labels', winner, 'pct', round(100.0 * c / n, 6),
    CASE WHEN c::DOUBLE / n < 0.1 THEN 'WARN' ELSE 'OK' END FROM l, p
  UNION ALL SELECT 'pii', 'table', 'checked', n, CASE WHEN hits > 0 THEN 'WARN' ELSE 'OK' END FROM p
  UNION ALL SELECT 'pii', 'table', 'with_pii', hits, CASE WHEN hits > 0 THEN 'WARN' ELSE 'OK' END FROM p
  UNION ALL {_lengths_sql()}""")
def validation(spark, folder):
    return validation_report(v.triples(spark, folder)).withColumn("value", F.round("value", 6))


def _requests(spark, folder):
    """Document pairs as requests; long texts and odd segments break the contract."""
    segment = v.pick(("MEI", "varejo", "OTHER", "CORPORATE"), F.col("doc_id") % 4)
    return v.document_pairs(spark, folder).select(
        "doc_id", "prompt", "response_a", "response_b", segment.alias("merchant_segment"),
        F.lpad(F.col("doc_id").cast("string"), F.col("doc_id").cast("int") % 150 + 1, "0")
        .alias("conversation_id"))


def _text_checks_sql(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN '{c}: missing' END, "
            f"CASE WHEN length({c}) > 4096 THEN '{c}: too long' END, "
            f"CASE WHEN NOT regexp_matches({c}, '\\S') THEN '{c}: blank' END")


@query("validate_requests", f"""WITH {v.PAIRS_SQL}, r AS (
  SELECT doc_id, prompt, response_a, response_b,
         ['MEI','varejo','OTHER','CORPORATE'][doc_id % 4 + 1] AS merchant_segment,
         doc_id % 150 + 1 AS id_length FROM pairs)
  SELECT doc_id, concat_ws('; ', {', '.join(_text_checks_sql(c) for c in ('prompt', 'response_a', 'response_b'))},
    CASE WHEN merchant_segment NOT IN ('MEI','VAREJO','CORPORATE') THEN 'merchant_segment: unknown' END,
    CASE WHEN id_length > 128 THEN 'conversation_id: too long' END) AS errors FROM r""")
def validate_requests(spark, folder):
    checked = contracts.check_requests(_requests(spark, folder))
    return checked.select("doc_id", F.array_join("errors", "; ").alias("errors"))


def feedback(spark, folder):
    """Events read as feedback, some of them broken."""
    e = v.table(spark, folder, "events")
    winner_text = v.pick(("A", "B", "tie", "C"), F.col("event_id") % 4)
    channel = v.pick(("webchat", "api", "whatsapp", "mobile", "fax"), F.col("event_id") % 5)
    return e.select(
        "event_id",
        F.when(F.col("event_id") % 97 == 0, "").otherwise(F.col("user_id").cast("string"))
        .alias("conversation_id"),
        winner_text.alias("actual_winner"),
        F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("event_id") % 7).cast("int")
        .alias("satisfaction_score"),
        F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(channel).alias("channel"),
        F.col("ts").cast("timestamp").alias("timestamp"))


FEEDBACK_SQL = """feedback AS (
  SELECT event_id, CASE WHEN event_id % 97 = 0 THEN '' ELSE user_id::VARCHAR END AS conversation_id,
         ['A','B','tie','C'][event_id % 4 + 1] AS actual_winner,
         CASE WHEN event_id % 3 <> 0 THEN event_id % 7 END AS satisfaction_score,
         CASE WHEN event_id % 11 <> 0 THEN ['webchat','api','whatsapp','mobile','fax'][event_id % 5 + 1] END
         AS channel FROM events)"""
FEEDBACK_ERRORS_SQL = """concat_ws('; ',
    CASE WHEN length(conversation_id) < 1 THEN 'conversation_id: missing' END,
    CASE WHEN length(conversation_id) > 128 THEN 'conversation_id: too long' END,
    CASE WHEN actual_winner NOT IN ('A','B','tie') THEN 'actual_winner: unknown' END,
    CASE WHEN satisfaction_score NOT BETWEEN 1 AND 5 THEN 'satisfaction_score: out of range' END,
    CASE WHEN channel NOT IN ('webchat','api','whatsapp','mobile') THEN 'channel: unknown' END)"""


@query("validate_feedback", f"WITH {FEEDBACK_SQL} SELECT event_id, {FEEDBACK_ERRORS_SQL} AS errors FROM feedback")
def validate_feedback(spark, folder):
    checked = contracts.check_feedback(feedback(spark, folder))
    return checked.select("event_id", F.array_join("errors", "; ").alias("errors"))


@query("feedback_as_training", f"""WITH {FEEDBACK_SQL} SELECT event_id,
  CASE actual_winner WHEN 'A' THEN 'model_a' WHEN 'B' THEN 'model_b' WHEN 'tie' THEN 'tie' END AS winner
  FROM feedback WHERE {FEEDBACK_ERRORS_SQL} = ''""")
def feedback_as_training(spark, folder):
    good = contracts.valid(contracts.check_feedback(feedback(spark, folder)))
    return good.select("event_id", dataset.feedback_winner_to_training("actual_winner").alias("winner"))


@query("score_range", """SELECT count(*) AS rows, count(*) FILTER (WHERE value / 400 > 1 OR value < 0) AS out_of_range
  FROM events""")
def score_range(spark, folder):
    rows = v.table(spark, folder, "events").select((F.col("value") / 400).alias("score"))
    return contracts.score_range_alerts(rows, "score")


@query("validate_results", f"""WITH {v.VECTORS_SQL}, r AS (
  SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN p0 + 0.5 ELSE p0 END AS q0, p1, p2 FROM preds)
  SELECT vec_id, CASE WHEN q0 > 1 OR abs(q0 + p1 + p2 - 1) >= 1e-4 THEN 'probabilities: invalid' ELSE '' END
  AS errors FROM r""")
def validate_results(spark, folder):
    rows = v.vector_predictions(spark, folder)
    p = F.col("probabilities")
    broken = F.when(F.col("vec_id") % 5 == 0, F.array(p[0] + 0.5, p[1], p[2])).otherwise(p)
    rows = rows.withColumn("probabilities", broken).withColumn("winner", winner("probabilities"))
    return contracts.check_results(rows).select("vec_id", F.array_join("errors", "; ").alias("errors"))
