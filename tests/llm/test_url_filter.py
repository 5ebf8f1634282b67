from __future__ import annotations

import numpy as np
import pytest

from lexifold.llm import url_filter

from .fixtures import plain

URLS = [
    "https://a.example.net/x", "https://EXAMPLE.NET/en/1", "http://sub.example.net/en?x", "http://example.com/de/1#f", "http://badexample.com/de/1",
    "http://x.org/fr/", "http://x.org/fr", "http://net", "http://net?x=/", "net/", "", None, "a://b://c.net/", "http://x.net/\n/y", "https://example.net/EN/1",
    "https://www.example.com/de/9", "http://.net/", "http://a..net/", "https://user@x.net:80/", "https://a.example.net/x",
]


def brute(url, rules, otherwise="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = rest[: min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])]
        tail = rest[len(host) :]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        host = host.translate({i: i + 32 for i in range(65, 91)})
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda f: len(f[0])) if fits else (None, otherwise)
    return host, path, rule, verdict


def judged(spark, rules, urls=URLS):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    return url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))


def test_rules(spark):
    out = plain(judged(spark, url_filter.RULES), "page_id", "host", "path", "rule", "verdict")
    assert out == sorted(((i, *brute(u, url_filter.RULES)) for i, u in enumerate(URLS)), key=repr)


def test_many_listed(spark):
    rules = [(f"h{i}.net", f"/p{i % 7}", "block") for i in range(500)] + [("net", "", "allow")]
    urls = [f"http://a.h{i}.net/p{i % 5}/x" for i in range(0, 700, 3)]
    out = plain(judged(spark, rules, urls), "page_id", "rule", "verdict")
    assert out == sorted(((i, *brute(u, rules)[2:]) for i, u in enumerate(urls)), key=repr)


def test_false_positives_are_removed(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 1)
    rules = [(f"h{i}.net", "/", "block") for i in range(2_000)]
    urls = [f"http://g{i}.net/" for i in range(300)] + ["http://h7.net/"]
    assert [r for r in plain(judged(spark, rules, urls), "page_id", "verdict") if r[1] == "block"] == [(300, "block")]


def test_filter_holds_all_it_was_given(spark):
    keys = spark.range(5_000).selectExpr("cast(id as string) key")
    bloom = url_filter.bloom_filter(keys)
    hashes = np.array([r[0] for r in keys.selectExpr("xxhash64(key)").collect()])
    assert url_filter.may_hold(bloom, hashes).all()
    other = np.array([r[0] for r in spark.range(10**6, 10**6 + 5_000).selectExpr("xxhash64(cast(id as string))").collect()])
    assert url_filter.may_hold(bloom, other).mean() < 0.05


@pytest.mark.parametrize("n_rules", [0, 4])
def test_empty(spark, n_rules):
    assert judged(spark, url_filter.RULES[:n_rules], []).collect() == []
    if not n_rules:
        assert {r.verdict for r in judged(spark, []).collect()} == {"allow"}
