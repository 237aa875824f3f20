"""Query of the licence scan over ``documents``, and its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefrank.llm.licenses import HINTS, OUTRANKED, RULES, SENTENCES, scan_licenses


def op8_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", F.array_join("license_sentences", ",").alias("sentences"),
                                      F.array_join("licenses", ",").alias("licenses"))


def rule_pattern(ids: list[str]) -> str:
    """Pattern over the identifiers joined as `,a,b,`: these, in this order, with any others between."""
    pattern = ",(.*,)?".join(["", *ids, ""]).replace(",(.*,)?", ",", 1)[:-len(",(.*,)?")] + ","
    if ids[-1] not in OUTRANKED:
        return pattern
    others = "|".join(sorted(set(SENTENCES.values()) - set(OUTRANKED[ids[-1]])))
    return f"{pattern}(({others}),)*({OUTRANKED[ids[-1]][1]},|$)"


_KNOWN = ", ".join(f"('{text}', '{name}')" for text, name in SENTENCES.items())
_FITS = ", ".join(
    "CASE WHEN " + " OR ".join(f"regexp_matches(joined, '{rule_pattern(ids)}')" for n, ids in RULES if n == name)
    + f" THEN '{name}' END" for name in sorted({n for n, _ in RULES}))

OP8_SQL = f"""
WITH known(sentence, id) AS (VALUES {_KNOWN}),
cut AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_split_to_array(regexp_replace(coalesce(text, ''), '\\n\\s*[^a-z\\s]{{0,3}}\\s*([A-Z0-9])', E'\\n\\n\\\\1', 'g'),
      '[.!?;:]+(?:\\s+|$)|\\n\\s*\\n') AS pieces
  FROM documents WHERE regexp_matches(lower(coalesce(text, '')), '{HINTS}')),
sentences AS (
  SELECT doc_id, i, trim(regexp_replace(regexp_replace(regexp_replace(lower(pieces[i]), '[^a-z0-9.]+', ' ', 'g'),
    '\\.([^0-9 ])', ' \\1', 'g'), '(\\.$)| +', ' ', 'g')) AS sentence
  FROM cut, range(1, len(pieces) + 1) AS r(i)),
found AS (
  SELECT doc_id, string_agg(id, ',' ORDER BY i) AS ids FROM sentences JOIN known USING (sentence) GROUP BY doc_id),
named AS (SELECT doc_id, coalesce(ids, '') AS ids, ',' || coalesce(ids, '') || ',' AS joined
  FROM documents LEFT JOIN found USING (doc_id))
SELECT doc_id, ids AS sentences, array_to_string(list_filter([{_FITS}], lambda x: x IS NOT NULL), ',') AS licenses FROM named
"""
