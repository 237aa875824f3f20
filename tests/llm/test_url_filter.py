from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from prefrank.llm import url_filter
from prefrank.llm.url_filter import blocked_bloom, canonical_url, filter_urls, probe
from prefrank.llm.url_filter_queries import RULES

URLS = [
    "https://www.Example.ORG/es/1?x=1#y", "http://a.example.org/en/12", "http://badexample.org/es/", "http://example.org",
    "HTTP://x.com/fr/a", "http://x.com/de/a", "http://com/de/", "http://x.com/DE/a", "http://ÄB.com/de/b", "mailto:x", "", None,
    "a://b://c/de/", "http://listed.net/p/?utm_source=a&q=1#f", "https://www.listed.net/p?q=1", "http://listed.net/p?q=2",
    "http://user@host.com:80/fr/?a", "http:///de/", "http://x.net?a=/de/", "http://x.net#://y", "http://\n.com/de/",
]


def by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    body = url[url.index("://") + 3:]
    n = min([body.index(c) for c in "/?#" if c in body] or [len(body)])
    host = "".join(c.lower() if c.isascii() else c for c in body[:n])
    path = body[n:]
    path = path[:min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    if fits:
        kind, where, begin = max(fits, key=lambda r: len(r[1] + r[2]))
        return host, path, where + begin, kind
    parts = urlsplit("x://" + body)
    query = "&".join(p for p in parts.query.split("&") if p and not p.startswith("utm_"))
    listed = (host.removeprefix("www."), path.rstrip("/"), query) == ("listed.net", "/p", "q=1")
    return host, path, None, "block" if listed else "allow"


@pytest.mark.parametrize("bits,limit", [(16, 1 << 17), (1, 1)])
def test_verdicts_are_those_of_the_rules_and_the_list(spark, monkeypatch, bits, limit):
    """Also with a filter so small that nearly everything passes: the exact join decides."""
    monkeypatch.setattr(url_filter, "BITS_PER_URL", bits)
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", limit)
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate([*URLS, URLS[14]])], "page_id int, url string, rule string")
    listed = spark.createDataFrame([("http://listed.net/p?q=1",), ("http://www.listed.net/p/?q=1",), (None,),
                                    *[(f"http://spam{i}.net/",) for i in range(300)]], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, listed, RULES).collect()}
    assert got == {i: by_hand(u) for i, u in enumerate([*URLS, URLS[14]])}
    none = listed.where("false")
    assert {r.verdict for r in filter_urls(pages.where("page_id = 13"), none, RULES).collect()} == {"allow"}
    assert filter_urls(pages.where("false"), listed, RULES).count() == 0


def test_the_filter_has_no_false_negatives_and_few_false_positives(spark):
    values = spark.range(20000).select(F.concat(F.lit("host/"), "id").alias("v"))
    held = values.where(F.xxhash64("v") % 2 == 0)
    n = held.count()
    got = probe(values.withColumn("held", F.xxhash64("v") % 2 == 0), "v", *blocked_bloom(held, "v", n), "maybe")
    counts = {(r.held, r.maybe): r["count"] for r in got.groupBy("held", "maybe").count().collect()}
    assert counts.get((True, False), 0) == 0 and counts[(True, True)] == n
    assert counts.get((False, True), 0) < 0.02 * (20000 - n)


def test_canonical_forms(column):
    got = column(canonical_url(F.col("t")), ["http://www.A.com/x/?b=1&utm_x=2&a=3#z", "https://a.com/x?b=1&a=3", "x", None, "http:///a"])
    assert got == ["a.com/x?b=1&a=3", "a.com/x?b=1&a=3", None, None, None]
