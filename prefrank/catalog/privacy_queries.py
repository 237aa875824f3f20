"""Redaction, detection, pseudonyms, audit."""

from pyspark.sql import functions as F

from prefrank import session
from prefrank.catalog import views as v
from prefrank.catalog.registry import query
from prefrank.functions import privacy
from prefrank.operators import audit, monitoring
from prefrank.plans.auditing import audit_files, has_violation

@query("redact_documents", f"SELECT doc_id, {v.redact_sql('text')} AS text FROM documents")
def redact_documents(spark, folder):
    return v.table(spark, folder, "documents").select("doc_id", privacy.redact("text").alias("text"))


@query("redact_documents_portuguese",
       f"SELECT doc_id, {v.redact_sql('text', v.PORTUGUESE_RULES_SQL)} AS text FROM documents")
def redact_documents_portuguese(spark, folder):
    docs = v.table(spark, folder, "documents")
    return docs.select("doc_id", privacy.redact("text", privacy.PORTUGUESE).alias("text"))


_TYPES = ("cpf", "cnpj", "card", "phone", "email")
_TYPES_SQL = ", ".join(
    f"CASE WHEN regexp_matches(text, '{p}') THEN '{t}' END" for t, (p, _) in zip(_TYPES, v.MAIN_RULES_SQL))


@query("pii_types", f"SELECT doc_id, concat_ws(',', {_TYPES_SQL}) AS types, "
                    f"{v.pii_sql('text')} AS has_pii FROM documents")
def pii_types(spark, folder):
    return v.table(spark, folder, "documents").select(
        "doc_id", F.array_join(privacy.pii_types("text"), ",").alias("types"),
        privacy.has_pii("text").alias("has_pii"))


@query("pii_by_source", f"""SELECT source, count(*) AS documents,
  count(*) FILTER (WHERE {v.pii_sql('text')}) AS with_pii FROM documents GROUP BY source""")
def pii_by_source(spark, folder):
    return v.table(spark, folder, "documents").groupBy("source").agg(
        F.count("*").alias("documents"), F.count_if(privacy.has_pii("text")).alias("with_pii"))


def _steps_sql() -> str:
    """Type counts of texts changed by each step."""
    steps = ["s0 AS (SELECT doc_id, text AS t FROM documents)"]
    for i, rule in enumerate(v.MAIN_RULES_SQL):
        steps.append(f"s{i + 1} AS (SELECT doc_id, {v.redact_sql('t', (rule,))} AS t FROM s{i})")
    parts = [
        f"SELECT '{kind}' AS pii_type, count(*) AS n FROM s{i} a JOIN s{i + 1} b USING (doc_id) WHERE a.t <> b.t"
        for i, kind in enumerate(_TYPES)]
    return "WITH " + ", ".join(steps) + " SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n > 0"


@query("pii_event_counts", _steps_sql())
def pii_event_counts(spark, folder):
    return monitoring.pii_event_counts(v.table(spark, folder, "documents"), "text")


@query("pii_leaks", f"""WITH r AS (SELECT {v.redact_sql('text')} AS text FROM documents)
  SELECT count(*) AS outputs, count(*) FILTER (WHERE {v.pii_sql('text')}) AS leaks FROM r""")
def pii_leaks(spark, folder):
    redacted = v.table(spark, folder, "documents").select(privacy.redact("text").alias("text"))
    return monitoring.pii_leaks(redacted, "text")


def _hmac_sql(value: str, salt: str) -> str:
    key = salt.encode().ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()
    return (f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({value}))))")


@query("pseudonymize_users",
       f"SELECT event_id, {_hmac_sql('CAST(user_id AS VARCHAR)', 'check-salt')} AS user_hash FROM events")
def pseudonymize_users(spark, folder):
    return v.table(spark, folder, "events").select(
        "event_id", privacy.pseudonymize("user_id", "check-salt").alias("user_hash"))


@query("normalize_documents", r"""SELECT doc_id,
  trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\s+', ' ', 'g'))
  AS text FROM documents""")
def normalize_documents(spark, folder):
    return v.table(spark, folder, "documents").select("doc_id", privacy.normalize_text("text").alias("text"))


_LINES_SQL = r"""pieces AS (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS p FROM documents),
numbered AS (SELECT doc_id, unnest(p) AS content, unnest(range(1, len(p) + 1)) AS line, len(p) AS n FROM pieces),
lines AS (SELECT doc_id, line, content FROM numbered WHERE NOT (line = n AND content = ''))"""
_FOUND_SQL = f"""WITH {_LINES_SQL}, found AS (
  SELECT doc_id, line, substring(regexp_replace(content, '\\s+$', ''), 1, 200) AS content
  FROM lines WHERE {v.pii_sql('content')})"""


def _lines(spark, folder):
    return audit.split_lines(v.table(spark, folder, "documents"), "text", "doc_id")


@query("audit_lines", f"{_FOUND_SQL} SELECT doc_id, line::BIGINT AS line, content FROM found")
def audit_lines(spark, folder):
    found = audit.violations(_lines(spark, folder))
    return found.select("doc_id", F.col("line").cast("long").alias("line"), "content")


@query("audit_summary", f"""{_FOUND_SQL}
  SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS files_scanned, 0::BIGINT AS files_skipped, count(*) AS total_violations,
         CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM found""")
def audit_summary(spark, folder):
    docs = v.table(spark, folder, "documents")
    return audit.audit_summary(audit.distinct_files(docs, "doc_id"), audit.violations(_lines(spark, folder)))


@query("audit_report", f"""{_FOUND_SQL}
  SELECT doc_id, (line - 1) // 100 AS page, count(*) AS n, min(line)::BIGINT AS first_line,
         arg_min(content, line) AS first_content FROM found GROUP BY 1, 2""")
def audit_report(spark, folder):
    report = audit.report_rows(audit.violations(_lines(spark, folder)), path="doc_id", lines_per_row=100)
    first = F.col("violations")[0]
    return report.select("doc_id", "page", F.size("violations").cast("long").alias("n"),
                         first["line"].cast("long").alias("first_line"), first["content"].alias("first_content"))


def _tree(spark, folder):
    """Documents as text files by source; every seventh below a hidden folder, every eleventh below another."""
    docs = v.table(spark, folder, "documents").select("doc_id", "source", F.col("text").alias("value"))
    tree = session.scratch_path(spark, "audit-tree")
    place = F.when(F.col("doc_id") % 7 == 0, ".hidden").when(F.col("doc_id") % 11 == 0, "_inner").otherwise("plain")
    for name in (".hidden", "_inner", "plain"):
        docs.where(place == name).drop("doc_id").write.partitionBy("source").text(f"{tree}/{name}")
    return tree


@query("audit_file_tree", f"""{_FOUND_SQL}
  SELECT d.source, f.content, count(*) AS n FROM found f JOIN documents d USING (doc_id) GROUP BY 1, 2""")
def audit_file_tree(spark, folder):
    """A file tree with hidden folders, audited with two overlapping targets."""
    tree = _tree(spark, folder)
    found = audit_files(spark, [tree, f"{tree}/.hidden"]).violations
    source = F.regexp_extract("path", "source=([^/]+)", 1).alias("source")
    return found.groupBy(source, "content").agg(F.count("*").alias("n"))


@query("audit_strict", f"""{_FOUND_SQL}
  SELECT count(*) AS total_violations, 0::BIGINT AS files_skipped, CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
    count(*) > 0 AS found_any, count(*) FILTER (WHERE doc_id % 7 = 0) > 0 AS hidden_any FROM found""")
def audit_strict(spark, folder):
    """Totals of the tree, and the strict probe of all of it and of its hidden part."""
    tree = _tree(spark, folder)
    return audit_files(spark, [tree]).summary.drop("files_scanned").withColumns({
        "found_any": F.lit(has_violation(spark, [tree])), "hidden_any": F.lit(has_violation(spark, [f"{tree}/.hidden"]))})
