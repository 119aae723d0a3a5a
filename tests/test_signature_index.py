"""The indexed catalogue against the one written into the plan."""

import io
import random
import time
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from checks.views import TEMPLATES
from faultline.functions import signatures as sig
from faultline.operators import logs
from faultline.operators.signature_index import build_signature_index, grams, indexed_families, indexed_matches, literal_of


def test_literals_follow_the_same_rules(spark):
    rules = [r for s in sig.CATALOGUE for r in s.regexes] + ["ab", "a.*b", r"x\.y\dzz", "(a)bcd", "abc$", r"no\d{3}", "[a]bcd", ""]
    rows = spark.createDataFrame([(r,) for r in rules], "regex string").select("regex", literal_of(F.col("regex")).alias("l")).collect()
    assert [(r.regex, r.l) for r in rows] == [(r, sig.required_literal(r)) for r in rules]


def test_default_catalogue_matches_as_in_the_plan(spark):
    draw = random.Random(3)
    texts = ["\n".join(draw.choice([*TEMPLATES, "ſSLError ", "x", "", "HTTP 503 HTTP 502", "Kilobyte", "OOMKİLLED"]).upper()
                       if draw.random() < 0.3 else draw.choice(TEMPLATES) for _ in range(draw.randint(0, 9))) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, stdout string")
    index = build_signature_index(sig.signature_catalog(spark))
    found = indexed_families(logs.explode_lines(rows, ["id"], stripped=False), ["id"], index, limit=100).collect()
    want = logs.match_signatures(rows, ["id"]).collect()
    shown = lambda r: (r.id, r.position, r.sig_idx, r["name"], r.severity, list(r.matches), r.n_matches)
    assert sorted(map(shown, found)) == sorted(map(shown, want)) and len(want) > 40


def test_plan_does_not_grow_with_the_catalogue(spark):
    def size(n):
        rules = spark.range(n).select(
            F.col("id").cast("int").alias("sig_idx"), F.lit(0).alias("rx_idx"), F.lit("n").alias("name"), F.lit("unknown").alias("category"),
            F.lit("low").alias("severity"), F.concat(F.lit("rule"), F.col("id").cast("string"), F.lit(".*end")).alias("regex"))
        lines = spark.createDataFrame([(1, 0, "RULE7 and the end")], "id int, line_no int, line string")
        out = indexed_families(lines, ["id"], build_signature_index(rules))
        text = io.StringIO()
        with redirect_stdout(text):
            out.explain("formatted")
        assert [(r.sig_idx, r.matches) for r in out.collect()] == [(7, ["RULE7 and the end"])]
        return len(text.getvalue())

    assert abs(size(10_000) - size(10)) < 500


def test_what_cannot_be_indexed_is_an_error(spark):
    for regex in ("(a)bcd", "^start", "ab", r"\d{3}"):
        signature = sig.Signature("odd", "unknown", "low", (regex,), "d", "r")
        with pytest.raises(ValueError, match="no literal"):
            build_signature_index(sig.signature_catalog(spark, [signature]))


def test_grams_of_odd_and_long_lines(spark):
    """All overlapping runs of letters, each once; a long line takes one pass (a substring at every place took its square)."""
    lines = ["", "abc", "abcd", "abcabca", "x\r äb\U0001f600cde"]
    got = [set(r.g) for r in spark.createDataFrame([(x,) for x in lines], "t string").select(grams(F.col("t"), 4).alias("g")).collect()]
    assert got[:4] == [set(), set(), {"abcd"}, {"abca", "bcab", "cabc"}]
    assert {lines[4][i:i + 4] for i in range(len(lines[4]) - 3)} <= got[4]
    long = spark.range(1).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(120_000)), lambda i: i.cast("string"))).alias("t"))
    start = time.monotonic()
    assert long.select(F.size(grams(F.col("t"), 4)).alias("n")).first().n > 10_000
    assert time.monotonic() - start < 30


def test_a_small_catalogue_is_broadcast(spark):
    """Lines are not shuffled once for each of their grams."""
    rules = spark.createDataFrame([(0, "disk", "unknown", "low", 0, "disk full.*E")], "sig_idx long, name string, category string, severity string, rx_idx int, regex string")
    lines = spark.createDataFrame([(1, 0, "the DISK FULL on nodE"), (2, 0, "disk")], "k int, line_no int, line string")
    found = indexed_matches(lines, ["k"], build_signature_index(rules))
    assert [(r.k, r.match) for r in found.collect()] == [(1, "DISK FULL on nodE")]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
