"""URL cascade and segment search against plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import queries, topk_search, url_cascade

PAGES = "page_id long, url string, host string, extra int"


def expected_rule(url, rules):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        tail = url.split("://", 1)[1]
        cut = min([tail.find(c) for c in "/?#" if c in tail], default=len(tail))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in tail[:cut])
        path = tail[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *((None, "allow") if not fits else max(fits)[1:]))


URLS = [
    None, "", "no scheme", "http://", "http://com/", "https://a.COM", "https://a.com/x", "http://example.com/en/1",
    "http://www.example.com/en/1?x=/es/", "http://m.example.com/en/", "http://notexample.com/en/", "http://x.net/es/1",
    "http://x.net/fr#t", "http://x.net/fr/#t", "http://x.net", "ftp://u@x.net:80/es/", "a://b://c.com/", "http://exAmple.com/EN/",
    "http://ünï.com/ß", "http://net/es/", "http://\nx.com/\n",
]


def judged(frame):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("most_bits", [1 << 23, 0])
def test_urls_by_rules(spark, most_bits):
    rows = [(i, u, "clash", 1) for i, u in enumerate(URLS + URLS[:5])]
    pages = spark.createDataFrame(rows, PAGES)
    rules = spark.createDataFrame(queries.URL_RULES + queries.URL_RULES[:1] + [(None, "/", "block")], "host string, path string, verdict string")
    out = url_cascade.judge_urls(pages, rules, most_bits=most_bits)
    assert judged(out) == sorted(((i, *expected_rule(u, queries.URL_RULES)) for i, u, _, _ in rows), key=repr)
    assert out.columns == ["page_id", "url", "host", "extra", "path", "rule", "verdict"]


def test_hosts_of_rules_and_urls_are_lowered_alike(spark):
    pages = spark.createDataFrame([(1, "http://\u00dc.COM/a", "", 1), (2, "http://x.\u00dc.com/a", "", 1)], PAGES)
    rules = spark.createDataFrame([("\u00dc.Com", "/", "block")], "host string, path string, verdict string")
    assert [r[3:] for r in judged(url_cascade.judge_urls(pages, rules))] == [("\u00dc.com/", "block")] * 2


def test_urls_without_rows_or_rules(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/", "", 1)], PAGES)
    assert judged(url_cascade.judge_urls(pages, rules)) == [(1, "a.com", "/", None, "allow")]
    some = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    assert judged(url_cascade.judge_urls(pages.limit(0), some)) == []


def test_cascade_is_exact_over_its_universe(spark):
    listed = {f"k{i}" for i in range(0, 3000, 7)}
    universe = [f"k{i}" for i in range(3000)]
    cascade = url_cascade.build_cascade(
        spark.createDataFrame([(k,) for k in sorted(listed)] + [(None,)], "key string"),
        spark.createDataFrame([(k,) for k in universe], "key string").repartition(3))
    assert len(cascade.levels) > 2
    frame = spark.createDataFrame([(k,) for k in universe], "key string").withColumn("in", cascade.lists(F.col("key")))
    assert {r["key"] for r in frame.collect() if r["in"]} == listed
    plan = frame._jdf.queryExecution().toString()
    assert "Join" not in plan and "Python" not in plan


def brute_top(rows, k):
    clean = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(1024 * x)) for x in v]
        clean[i] = min(clean.get(i, q), q)
    out = []
    for i, q in clean.items():
        if i % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in clean.items() if j != i and len(x) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [16_384, 7])
def test_search_against_brute_force(spark, block_rows):
    draw = random.Random(3)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(11)]) for i in range(200)]
    rows += [(i, [0.5] * 11) for i in range(200, 240)]
    rows += [(300, None), (310, [1.0, None]), (320, [float("nan")] * 11), (330, [float("inf")] * 11), (None, [1.0] * 11)]
    rows += [rows[0], (10, [0.25] * 11), (340, []), (350, [1.0, 2.0]), (351, [3.0, -4.0]), (361, [])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, e array<double>, q string, rank int")
    out = topk_search.top_k_search(frame, "vec_id", "e", F.col("id") % 10 == 0, k=5, block_rows=block_rows, chunk_rows=9)
    assert sorted(tuple(r) for r in out.collect()) == brute_top(rows, 5)


def test_search_of_nothing(spark):
    frame = spark.createDataFrame([], "vec_id long, e array<float>")
    assert topk_search.top_k_search(frame, "vec_id", "e", F.col("id") % 10 == 0).collect() == []


def test_segment_bounds_hold_and_tighten():
    draw = np.random.default_rng(1)
    q, x = draw.integers(-900, 900, (20, 64)), draw.integers(-900, 900, (50, 64))
    exact, last = q @ x.T, None
    for qs, xs in zip(topk_search.segment_statistics(q), topk_search.segment_statistics(x), strict=True):
        bound = qs @ xs.T
        assert (bound >= exact - 1e-6).all()
        assert last is None or bound.mean() <= last
        last = bound.mean()


def test_products_beyond_floats():
    big = 3_000_000_007
    rows, ids, scores = topk_search.dense_top(np.array([0]), np.array([[big, 1]]), np.array([1, 2]), np.array([[1, 0], [1, 1]]), 1)
    assert (ids.tolist(), scores.tolist()) == ([2], [big + 1])
    assert list(itertools.chain(rows)) == [0]
