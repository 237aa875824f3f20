"""Query of the filter interaction audit over ``documents``."""

from pyspark.sql import DataFrame, SparkSession

from prefrank.llm.filter_audit import KEYS, audit_filters

#: Micro-batches for all files; each reads the labels once, so their number does not grow with the input.
BATCHES = 8
#: Documents for each key of the state.
KEYED = 256

OP13_SQL = r"""WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
  words AS (SELECT *, list_filter(string_split_regex(text, '[\x09-\x0D\x20]+'), lambda w: w <> '') AS ws,
    min(doc_id) OVER (PARTITION BY text) AS least FROM texts),
  masks AS (SELECT doc_id, part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask FROM words),
  flags AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
  counters AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM masks LEFT JOIN flags USING (doc_id) GROUP BY part, mask),
  letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
  orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
    FROM letters a, letters b, letters c, letters d, letters e WHERE a.b + b.b + c.b + d.b + e.b = 31
      AND len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
  steps AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
    FROM orders, range(1, 6) r(step)),
  results AS (SELECT part, filter_order, step, own,
      sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept,
      sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
      sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
      sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
      sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
      sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM counters, steps GROUP BY ALL)
  SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM results"""


def op13_retraction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As a glob the path may be one file or a folder of files.
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = len(table.inputFiles())
    docs = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, -(-files // BATCHES))).parquet(
        f"{sf_dir}/documents.parque[t]")
    return audit_filters(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keys=max(KEYS, table.count() // KEYED))
