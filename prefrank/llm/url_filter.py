"""URL filter: rules first, then a blocked Bloom filter before an exact hash join with a list.

Native throughout: hashing, filter and join are SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefrank.llm.scratch import Scratch, tidy

#: A block is 8 words of 64 bits; a URL sets one bit in each word of one block.
BLOCK_WORDS = 8
BITS_PER_URL = 16
#: The filter is broadcast, so its size is bounded: 2**17 blocks are 8 MB of bits.
MAX_BLOCKS = 1 << 17

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without ``www.``, path without its last ``/`` and the query without tracking parameters.

    Scheme and fragment do not count. Null without ``://`` or with an empty host.
    """
    host = F.regexp_replace(url_host(url), r"^www\.", "")
    path = F.regexp_replace(url_path(url), "/$", "")
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike("^((utm_[^=]*|ref|fbclid|gclid)(=.*)?)?$")), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits; rules are (action, host, path) and fit subdomains too."""
    rule = action = F.lit(None).cast("string")
    for kind, where, begin in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == where) | F.endswith(host, F.lit("." + where))) & F.startswith(path, F.lit(begin))
        rule, action = F.when(fits, F.lit(where + begin)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(action)
    return rule, action


def _block(value: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(blocks))


def _bits(value: Column) -> list[Column]:
    code = F.xxhash64(value, F.lit(1))
    place = [F.shiftrightunsigned(code, 6 * i).bitwiseAND(63).cast("int") for i in range(BLOCK_WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), at) for at in place]


def blocked_bloom(values: DataFrame, column: str, count: int) -> tuple[DataFrame, int]:
    """(filter with a row for each block in use, number of blocks) of about ``count`` different values."""
    blocks = min(MAX_BLOCKS, max(1, -(-count * BITS_PER_URL // (64 * BLOCK_WORDS))))
    bits = values.select(_block(F.col(column), blocks).alias("_block"),
                         *[b.alias(f"_word{i}") for i, b in enumerate(_bits(F.col(column)))])
    return bits.groupBy("_block").agg(*[F.bit_or(f"_word{i}").alias(f"_word{i}") for i in range(BLOCK_WORDS)]), blocks


def probe(rows: DataFrame, column: str, bloom: DataFrame, blocks: int, out: str) -> DataFrame:
    """``rows`` with boolean ``out``: whether ``column`` may be in the filter. A null value is not."""
    found = rows.withColumn("_block", _block(F.col(column), blocks)).join(F.broadcast(bloom), "_block", "left")
    hit = F.col(column).isNotNull()
    for i, bit in enumerate(_bits(F.col(column))):
        hit = hit & (F.col(f"_word{i}").bitwiseAND(bit) == bit)
    return found.withColumn(out, F.coalesce(hit, F.lit(False))).drop("_block", *[f"_word{i}" for i in range(BLOCK_WORDS)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    The longest fitting rule decides; else a page is blocked if the canonical form of its URL is
    that of a listed one (``listed`` has a column like ``url``), else allowed. Only pages that
    pass the Bloom filter meet the list in the exact join; the others are not shuffled. Null URLs
    and URLs without ``://`` are allowed. Columns with the added names are replaced, others pass
    through; every row, repeated ones too, gives one row.
    """
    names = ("host", "path", "rule", "verdict")
    scratch = Scratch(pages.sparkSession, "url-filter")
    known = scratch.save(listed.select(canonical_url(F.col(url)).alias("_canonical")).where(
        "_canonical is not null").distinct(), "listed")
    bloom, blocks = blocked_bloom(known, "_canonical", known.count())
    bloom = scratch.save(bloom, "bloom")
    rule, action = matching_rule(F.col("_host"), F.col("_path"), rules)
    judged = tidy(pages, *names).withColumns({"_host": url_host(F.col(url)), "_path": url_path(F.col(url))}).withColumns(
        {"_rule": rule, "_action": action, "_canonical": F.when(rule.isNull(), canonical_url(F.col(url)))})
    probed = probe(judged, "_canonical", bloom, blocks, "_maybe")
    sure = probed.where("not _maybe").withColumn("_listed", F.lit(False))
    checked = probed.where("_maybe").join(
        known.withColumn("_listed", F.lit(True)).hint("shuffle_hash"), "_canonical", "left")
    verdict = F.coalesce("_action", F.when(F.col("_listed"), "block").otherwise("allow"))
    return sure.unionByName(checked).select(
        *tidy(pages, *names).columns, F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("_rule").alias("rule"), verdict.alias("verdict"))
