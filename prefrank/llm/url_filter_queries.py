"""Query of the URL filter over ``pages``, and its SQL.

The list holds the URLs of pages on hosts with a listed name; other pages whose URL has the
same canonical form are blocked with them.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefrank.llm.url_filter import filter_urls, url_host

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
LISTED_NAME = r"(^|\.)(cheap|free|best|win|casino|pills)[a-z]*-[a-z-]+\."


def op3_blocked_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    listed = pages.where(url_host(F.col("url")).rlike(LISTED_NAME)).select("url")
    return filter_urls(pages, listed, RULES).select("page_id", "host", "path", "rule", "verdict")


_FITS = " ".join(
    f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{{{i}}}'"
    for i, (_, host, path) in sorted(enumerate(RULES), key=lambda r: -len(r[1][1]) - len(r[1][2])))

OP3_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS body FROM pages),
parts AS (
  SELECT page_id, body,
    coalesce(translate(regexp_extract(body, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(body, '^[^/?#]*([^?#]*)', 1), '') AS path,
    list_filter(string_split(regexp_extract(body, '^[^?#]*\\?([^#]*)', 1), '&'),
      lambda p: NOT regexp_matches(p, '^((utm_[^=]*|ref|fbclid|gclid)(=.*)?)?$')) AS params FROM cut),
named AS (
  SELECT page_id, host, path,
    CASE WHEN host <> '' AND regexp_replace(host, '^www\\.', '') <> '' THEN
      regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/$', '')
      || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canonical,
    CASE {_FITS.format(*[r[1] + r[2] for r in RULES])} END AS rule,
    CASE {_FITS.format(*[r[0] for r in RULES])} END AS action FROM parts),
listed AS (SELECT DISTINCT canonical FROM named WHERE regexp_matches(host, '{LISTED_NAME}') AND canonical IS NOT NULL)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block'
  ELSE 'allow' END) AS verdict FROM named
"""
