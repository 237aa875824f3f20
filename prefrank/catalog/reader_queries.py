"""Readers, gates and files that decide what a job takes in."""

from pyspark.sql import functions as F

from prefrank import session
from prefrank.catalog import views as v
from prefrank.catalog.registry import query
from prefrank.functions.privacy import has_pii
from prefrank.operators import dataset, routing
from prefrank.plans import scoring as plan
from prefrank.schemas import REQUIRED_PREFERENCE_COLUMNS
from prefrank.sources import cache_files, tables
from prefrank.sources.reports import load_rules, write_settings


def _stored(spark, folder):
    """The triples as a table of Parquet files with a column nobody asks for."""
    path = session.scratch_path(spark, "triples")
    v.triples(spark, folder).withColumn("note", F.lit("unused")).write.parquet(path)
    return path


@query("read_preferences", f"WITH {v.CLEAN_SQL} SELECT conversation_id, prompt, response_a, response_b, segment, label FROM clean")
def read_preferences(spark, folder):
    return tables.read_preferences(spark, _stored(spark, folder))


@query("read_preferences_limited", f"""WITH {v.TRIPLES_SQL}, first AS (SELECT * FROM triples ORDER BY conversation_id LIMIT 40)
  SELECT count(*) FILTER (WHERE response_b IS NOT NULL) AS kept, 0::BIGINT AS none,
    (SELECT count(*) FROM triples WHERE response_b IS NOT NULL) AS everything FROM first""")
def read_preferences_limited(spark, folder):
    """Row limits of the reader: 40 before null rows go, 0 for none, null for all."""
    path = _stored(spark, folder)
    sizes = [tables.read_preferences(spark, path, n, "conversation_id").agg(F.count("*")).scalar() for n in (40, 0, None)]
    return spark.range(1).select(*[s.alias(n) for s, n in zip(sizes, ("kept", "none", "everything"))])


@query("read_for_validation", f"""WITH {v.TRIPLES_SQL} SELECT least(count(*), 25) AS limited, count(*) AS everything,
  count(*) FILTER (WHERE response_b IS NULL) AS without_b FROM triples""")
def read_for_validation(spark, folder):
    """Raw rows, nothing dropped; 0 reads everything."""
    path = _stored(spark, folder)
    limited = tables.read_for_validation(spark, path, 25).agg(F.count("*")).scalar()
    return tables.read_for_validation(spark, path, 0).agg(
        F.count("*").alias("everything"), F.count_if(F.col("response_b").isNull()).alias("without_b")).withColumn("limited", limited)


@query("required_columns", f"""WITH {v.TRIPLES_SQL}, names AS (SELECT unnest([{", ".join(f"'{c}'" for c in REQUIRED_PREFERENCE_COLUMNS)}]) AS name)
  SELECT name, false AS accepted, name AS missing, NULL::BIGINT AS rows FROM names
  UNION ALL SELECT '', true, '', (SELECT count(*) FROM triples)""")
def required_columns(spark, folder):
    """The reader on tables that lack one column each, and on the whole table."""
    path = _stored(spark, folder)
    out = []
    for name in ("", *REQUIRED_PREFERENCE_COLUMNS):
        table = spark.read.parquet(path).drop(name)
        try:
            out.append((name, True, "", dataset.require_columns(table).count()))
        except KeyError:
            out.append((name, False, ",".join(dataset.missing_columns(table)), None))
    return spark.createDataFrame(out, "name string, accepted boolean, missing string, rows long")


@query("rule_file", """SELECT intent, count(*) AS n FROM (SELECT CASE
    WHEN contains(lower(text), 'the') THEN 'article' WHEN contains(lower(text), 'card') THEN 'payment' ELSE 'none' END AS intent
    FROM documents) GROUP BY intent""")
def rule_file(spark, folder):
    """Keyword rules and their default from a settings file."""
    path = session.scratch_path(spark, "rules")
    write_settings(spark, {"rules": [["the", "article"], ["card", "payment"]], "default": "none"}, path)
    settings = load_rules(spark, path)
    intent = routing.detect_intent("text", [tuple(r) for r in settings["rules"]], settings["default"])
    return v.table(spark, folder, "documents").groupBy(intent.alias("intent")).agg(F.count("*").alias("n"))


_REASON_SQL = f"""{v.TRIPLES_SQL}, r AS (SELECT conversation_id, split_part(conversation_id, '-', 1)::BIGINT AS c, response_b FROM triples)
  SELECT conversation_id, CASE WHEN c % 7 = 0 THEN 'unknown segment' WHEN response_b IS NULL THEN 'missing text'
    WHEN c % 5 = 0 THEN 'empty input after redaction' END AS reason FROM r"""


@query("refused_requests", f"WITH {_REASON_SQL} WHERE c % 7 = 0 OR response_b IS NULL OR c % 5 = 0")
def refused_requests(spark, folder):
    """Requests of an unknown segment, without a text or with a blank one get a reason and no result."""
    c = F.split("conversation_id", "-")[0].cast("long")
    requests = v.triples(spark, folder).drop("winner").withColumns({
        "prompt": F.when(c % 5 == 0, F.lit(" \t\n")).otherwise(F.col("prompt")),
        "merchant_segment": F.when(c % 7 == 0, F.lit("OUTRO")).otherwise(F.col("merchant_segment"))})
    outcome = plan.score_requests(requests, plan.fusion_scorer(v.example_head()), F.current_timestamp())
    rows = plan.refused(outcome)
    return rows.select("conversation_id", F.when(F.col("winner").isNull() & F.col("prob_tie").isNull(), F.col("reason")).alias("reason"))


@query("pii_gate", f"""SELECT count(*) FILTER (WHERE NOT {v.pii_sql('text')}) AS passed, bool_or({v.pii_sql('text')}) AS refused FROM documents""")
def pii_gate(spark, folder):
    """The gate before training refuses the whole table and passes its rows without personal data."""
    docs = v.table(spark, folder, "documents").select("text")
    try:
        dataset.pii_gate(docs, ["text"])
        refused = False
    except dataset.PiiFound:
        refused = True
    clean = dataset.pii_gate(docs.where(~has_pii("text")), ["text"])
    return clean.agg(F.count("*").alias("passed")).withColumn("refused", F.lit(refused))


@query("cache_compaction", """WITH e AS (SELECT user_id::VARCHAR AS key, event_id, ts::DATE AS day, value FROM events WHERE event_type = 'purchase'),
  last AS (SELECT key, arg_max(value, ts) AS latency_ms FROM (SELECT user_id::VARCHAR AS key, value, ts FROM events
    WHERE event_type = 'purchase' AND ts > TIMESTAMP '2024-01-31' - INTERVAL 20 DAYS) GROUP BY key)
  SELECT key, latency_ms, latency_ms AS after_ms, true AS fewer_files, true AS fewer_rows FROM last""")
def cache_compaction(spark, folder):
    """The live entries of a cache that was appended to six times, before and after it is compacted."""
    from prefrank.operators import cache

    path = session.scratch_path(spark, "cache")
    events = v.table(spark, folder, "events").where("event_type = 'purchase'").withColumn("ts", F.col("ts").cast("timestamp"))
    value = F.to_json(F.struct(F.lit("A").alias("winner"), F.col("value").alias("latency_ms")))
    for part in range(6):
        tables.append_cache(events.where(F.col("event_id") % 6 == part).select(
            F.col("user_id").cast("string").alias("key"), value.alias("value"), F.col("ts").alias("written_at")), path)

    now = F.to_timestamp(F.lit("2024-01-31 00:00:00"))

    def live(name):
        found = cache.live_entries(tables.read_cache(spark, path), now, ttl=20 * 86400)
        return found.select("key", F.col("cached.latency_ms").alias(name))

    before = session.reliable_checkpoint(live("latency_ms"))
    files, rows = cache_files.count_files(spark, path), tables.read_cache(spark, path).count()
    cache_files.compact(spark, path)
    cache_files.compact(spark, path, grace_seconds=0)
    fewer = cache_files.count_files(spark, path) < files, tables.read_cache(spark, path).count() < rows
    return before.join(live("after_ms"), "key", "full").withColumns(
        {"fewer_files": F.lit(fewer[0]), "fewer_rows": F.lit(fewer[1])})
