"""Intents, prompts, generated text, submissions."""

import re

from pyspark.sql import functions as F

from prefrank import fixed_values as fixed
from prefrank import session
from prefrank.catalog import views as v
from prefrank.catalog.registry import query
from prefrank.functions import text
from prefrank.operators import routing
from prefrank.plans import interactions
from prefrank.sources.reports import rule_table, submission_rows, write_submission

# The check tables hold no Portuguese support messages, so the rules look for common words.
RULES = (("que", "reclamacao_taxa"), ("der", "duvida_taxa_mdr"), ("ing", "problema_terminal"),
         ("el", "cancelamento"), ("th", "solicitacao_especial"))
_CASES = " ".join(f"WHEN contains(lower(message), '{k}') THEN '{i}'" for k, i in RULES)
_MESSAGES_SQL = f"""messages AS (
  SELECT conv_id, turn, text AS message, ['MEI','VAREJO','CORPORATE'][conv_id % 3 + 1] AS segment,
         ['reclamacao_taxa','cancelamento'][conv_id % 2 + 1] AS expected_intent
  FROM conversations WHERE role = 'user'),
  routed AS (SELECT *, CASE {_CASES} ELSE 'outros' END AS intent FROM messages)"""


def messages(spark, folder):
    rows = v.table(spark, folder, "conversations").where(F.col("role") == "user")
    return rows.select(
        "conv_id", "turn", F.col("text").alias("message"),
        v.pick(v.SEGMENTS, F.col("conv_id") % 3).alias("segment"),
        v.pick(("reclamacao_taxa", "cancelamento"), F.col("conv_id") % 2).alias("expected_intent"))


def _routed(spark, folder):
    return messages(spark, folder).withColumn("intent", routing.detect_intent("message", RULES))


@query("detect_intent", f"WITH {_MESSAGES_SQL} SELECT conv_id, turn, intent FROM routed")
def detect_intent(spark, folder):
    return _routed(spark, folder).select("conv_id", "turn", "intent")


_RULE_VALUES = ", ".join(f"({i}, '{k}', '{n}')" for i, (k, n) in enumerate(RULES))


@query("match_rule_table", f"""WITH rules(ord, keyword, intent) AS (VALUES {_RULE_VALUES}),
  hits AS (SELECT d.doc_id, arg_min(r.intent, r.ord) AS intent FROM documents d
           JOIN rules r ON contains(lower(d.text), r.keyword) GROUP BY d.doc_id)
  SELECT d.doc_id, coalesce(h.intent, 'outros') AS intent FROM documents d LEFT JOIN hits h USING (doc_id)""")
def match_rule_table(spark, folder):
    docs = v.table(spark, folder, "documents").select("doc_id", F.col("text").alias("message"))
    return routing.match_rule_table(docs, rule_table(spark, RULES)).select("doc_id", "intent")


_ACTION_SQL = """CASE intent WHEN 'reclamacao_taxa' THEN 'antecipacao' WHEN 'duvida_taxa_mdr' THEN 'info_taxa_mdr'
  WHEN 'problema_terminal' THEN 'suporte_tecnico' WHEN 'cancelamento' THEN 'retencao_avancada'
  ELSE 'atendimento_geral' END"""
_PRIORITY_SQL = """CASE intent WHEN 'reclamacao_taxa' THEN 1 WHEN 'duvida_taxa_mdr' THEN 2
  WHEN 'problema_terminal' THEN 1 WHEN 'cancelamento' THEN 0 ELSE 3 END"""


@query("route_intent", f"""WITH {_MESSAGES_SQL} SELECT intent, {_ACTION_SQL} AS action, {_PRIORITY_SQL} AS priority,
  count(*) AS n FROM routed GROUP BY intent""")
def route_intent(spark, folder):
    rows = routing.route(_routed(spark, folder))
    return rows.groupBy("intent", "action", "priority").agg(F.count("*").alias("n"))


@query("intent_confusion", f"""WITH {_MESSAGES_SQL} SELECT expected_intent AS expected, intent AS detected,
  count(*) AS n FROM routed GROUP BY 1, 2""")
def intent_confusion(spark, folder):
    return routing.intent_confusion(_routed(spark, folder))


@query("intent_accuracy", f"""WITH {_MESSAGES_SQL} SELECT count(*) AS n,
  round(avg((expected_intent = intent)::INT), 6) AS accuracy FROM routed""")
def intent_accuracy(spark, folder):
    rows = routing.intent_accuracy(_routed(spark, folder))
    return rows.withColumn("accuracy", F.round("accuracy", 6))


def _text_sql(text: str) -> str:
    """A text as a SQL literal; line breaks are spelled out."""
    quoted = text.replace("'", "''").split("\n")
    return " || chr(10) || ".join(f"'{line}'" for line in quoted)


def _case_sql(column: str, mapping: dict, default: str) -> str:
    cases = " ".join(f"WHEN {_text_sql(k)} THEN {_text_sql(value)}" for k, value in mapping.items())
    return f"CASE {column} {cases} ELSE {_text_sql(default)} END"


_PROMPT_PARTS = {
    "company": "'Loja'", "segment": "segment", "message": "message", "intent": "intent",
    "tone": _case_sql("segment", fixed.SEGMENT_TONES, fixed.DEFAULT_TONE),
    "action": _case_sql("intent", fixed.ACTION_HINTS, fixed.DEFAULT_ACTION_HINT)}
_PROMPT_SQL = " || ".join(
    _PROMPT_PARTS[name] if name in _PROMPT_PARTS else _text_sql(name)
    for name in re.split(r"\{(\w+)\}", fixed.REASONING_PROMPT))


@query("reasoning_prompt", f"WITH {_MESSAGES_SQL} SELECT conv_id, turn, {_PROMPT_SQL} AS prompt FROM routed")
def reasoning_prompt(spark, folder):
    return _routed(spark, folder).select("conv_id", "turn", routing.reasoning_prompt(
        "message", "segment", "intent", "Loja").alias("prompt"))


_RAW_SQL = """raws AS (SELECT doc_id, CASE doc_id % 3
    WHEN 0 THEN 'x <think> ' || source || chr(10) || lang || ' </think>' || text || ' '
    WHEN 1 THEN text ELSE '<think>' || lang || '</think>  ' END AS raw FROM documents)"""


def _raw(spark, folder):
    docs = v.table(spark, folder, "documents")
    full = F.concat(F.lit("x <think> "), "source", F.lit("\n"), "lang", F.lit(" </think>"), "text", F.lit(" "))
    bare = F.concat(F.lit("<think>"), "lang", F.lit("</think>  "))
    kind = F.col("doc_id") % 3
    return docs.select("doc_id", F.when(kind == 0, full).when(kind == 1, F.col("text")).otherwise(bare).alias("raw"))


_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_PARSED_SQL = f"""{_RAW_SQL}, cut AS (SELECT doc_id, raw,
    trim(regexp_extract(raw, '<think>(.*?)</think>', 1, 's'), {_TRIM}) AS thinking,
    CASE WHEN contains(raw, '</think>')
         THEN trim(substring(raw, strpos(raw, '</think>') + 8), {_TRIM}) ELSE '' END AS tail FROM raws),
  parsed AS (SELECT doc_id, thinking, CASE WHEN tail = '' THEN trim(raw, {_TRIM}) ELSE tail END AS response FROM cut)"""


@query("parse_generated", f"WITH {_PARSED_SQL} SELECT doc_id, thinking, response FROM parsed")
def parse_generated(spark, folder):
    rows = _raw(spark, folder).select("doc_id", text.parse_generated("raw").alias("p"))
    return rows.select("doc_id", "p.thinking", "p.response")


@query("display_cuts", f"""WITH {_PARSED_SQL} SELECT doc_id,
  CASE WHEN length(thinking) > 300 THEN substring(thinking, 1, 300) || '...' ELSE thinking END AS thinking_display,
  CASE WHEN length(response) > 400 THEN substring(response, 1, 400) || '...' ELSE response END AS response_display
  FROM parsed""")
def display_cuts(spark, folder):
    rows = interactions.parse_interactions(_raw(spark, folder))
    return rows.select("doc_id", "thinking_display", "response_display")


@query("submission_rows", """SELECT CAST(doc_id AS VARCHAR) AS id, substring(text, 1, 500) AS prediction
  FROM documents""")
def submission(spark, folder):
    docs = v.table(spark, folder, "documents")
    return submission_rows(docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("prediction")))


@query("submission_csv", """SELECT CAST(doc_id AS VARCHAR) AS id, substring(text, 1, 500) AS prediction
  FROM documents""")
def submission_csv(spark, folder):
    """The submission written as CSV and read back, line breaks and quotes included."""
    path = session.scratch_path(spark, "submission")
    docs = v.table(spark, folder, "documents")
    write_submission(docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("prediction")), path)
    return (spark.read.schema("id string, prediction string").option("header", True).option("escape", '"')
            .option("multiLine", True).csv(path))


class Parrot:
    """Stand-in generator: repeats the prompt's length after an empty line of thought."""

    def __call__(self, prompts):
        return [f"<think>eco</think> {len(p)} caracteres" for p in prompts]


@query("answer_interactions", f"""WITH {_MESSAGES_SQL} SELECT conv_id, turn, intent, 'eco' AS thinking,
  length({_PROMPT_SQL}) || ' caracteres' AS prediction FROM routed""")
def answer_interactions(spark, folder):
    rows = interactions.answer_interactions(messages(spark, folder), Parrot, "Loja", RULES)
    return rows.select("conv_id", "turn", "intent", "thinking", "prediction")


@query("confidence_gate", f"""WITH {v.VECTORS_SQL} SELECT segment,
  CASE segment WHEN 'MEI' THEN 0.7 WHEN 'VAREJO' THEN 0.75 ELSE 0.85 END AS confidence_threshold, count(*) AS n,
  count(*) FILTER (WHERE segment = 'CORPORATE' OR
    conf < CASE segment WHEN 'MEI' THEN 0.7 WHEN 'VAREJO' THEN 0.75 ELSE 0.85 END) AS needs_review
  FROM preds GROUP BY segment""")
def confidence_gate(spark, folder):
    rows = v.vector_predictions(spark, folder).withColumn("confidence", F.array_max("probabilities"))
    gated = routing.confidence_gate(rows)
    return gated.groupBy("segment", "confidence_threshold").agg(
        F.count("*").alias("n"), F.count_if("needs_review").alias("needs_review"))
