"""Classification: hand cases, and random texts against a plain statement of the rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from checks.views import TEMPLATES
from faultline.functions import signatures as sig
from faultline.functions.text import strip
from faultline.operators import logs
from faultline.plans.triage import classify_logs


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, stdout string")


def families(spark, texts, custom=None):
    rows = logs.match_logs(frame(spark, texts), custom=custom).orderBy("id").collect()
    return [[(m.name, list(m.matches)) for m in r.matches] for r in rows]


def expected_matches(text, catalogue):
    found = []
    for s in catalogue:
        hits = [m for rx in s.regexes for m in re.findall(rx, text, re.IGNORECASE)]
        if hits:
            found.append((s, hits))
    order = ["critical", "high", "medium", "low"]
    return [(s.name, hits) for s, hits in sorted(found, key=lambda p: order.index(p[0].severity))]


def test_template_families(spark):
    got = families(spark, TEMPLATES)
    assert got == [expected_matches(t, sig.CATALOGUE) for t in TEMPLATES]
    assert got[0] == [("java_oom", ["java.lang.OutOfMemoryError", "Java heap space"]), ("python_oom", ["MemoryError"])]
    assert got[15] == [("ssl_error", ["SSLError", "certificate verify failed", "SSLError"])]
    assert [name for name, _ in got[16]] == ["disk_full", "connection_refused"]
    assert got[17] == got[18] == got[19] == []


def test_expected_families_of_the_templates(spark):
    """Stated by hand, apart from the catalogue."""
    counted = [[(name, len(found)) for name, found in one] for one in families(spark, TEMPLATES)]
    assert counted == [
        [("java_oom", 2), ("python_oom", 1)], [("python_oom", 1)], [("disk_full", 1)], [("timeout", 2)],
        [("column_not_found", 2)], [("type_mismatch", 1)], [("parse_error", 3)], [("connection_refused", 1)],
        [("http_5xx", 2)], [("dns_failure", 1)], [("null_constraint", 1)], [("unique_violation", 2)],
        [("assertion_failed", 2)], [("auth_failure", 2)], [("token_expired", 2)], [("ssl_error", 3)],
        [("disk_full", 1), ("connection_refused", 1)], [], [], [],
    ]


def test_strip_is_linear(spark):
    import time

    rows = spark.createDataFrame([(" " * 1_000_000 + "x" + "\u3000 \x1c\n" * 250_000,), (" " * 1_000_000,)], "s string")
    rows.select(strip(F.col("s")).alias("s")).collect()
    start = time.perf_counter()
    assert [r.s for r in rows.select(strip(F.col("s")).alias("s")).collect()] == ["x", ""]
    assert time.perf_counter() - start < 5


@pytest.mark.parametrize("text, category", [
    ("[2024] KeyError: column 'customer_id' not found", "schema_mismatch"),
    ("Connection refused to database:5432", "source_unavailable"),
    ("HTTP 403 Forbidden - Access Denied", "permission_error"),
    ("OUTOFMEMORYERROR: heap space", "resource_exhaustion"),
    ("Everything is fine\nTask completed successfully", "unknown"),
])
def test_primary_category(spark, text, category):
    assert classify_logs(frame(spark, [text])).first().error_category == category


def test_two_families(spark):
    row = logs.match_logs(frame(spark, ["Connection refused\nRetry 1/3\njava.lang.OutOfMemoryError: x"])).first()
    assert {m.category for m in row.matches} == {"source_unavailable", "resource_exhaustion"}


def test_unicode_dialect(spark):
    texts = ["column x\rnot found", "column a not found", "HTTP 5١٢", "column\nnot found",
             "ſſl error", "diſk quota exceeded", "TİMED OUT", "KeyError column"]
    assert families(spark, texts) == [expected_matches(t, sig.CATALOGUE) for t in texts]


def random_texts(n):
    rng = random.Random(7)
    words = [w for t in TEMPLATES for w in t.replace("\n", " ").split(" ")] + ["", "INFO", "ok", "\t", "Killed", "é"]
    out = []
    for _ in range(n):
        lines = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(rng.randint(1, 130))]
        if rng.random() < 0.3:
            lines = [line for line in lines if not re.search("error|exception|traceback|failed|oom|killed|timeout", line, re.I)]
        out.append("\n".join(lines))
    return out


def expected_snippet(text):
    lines = text.strip().split("\n")
    words = ["error", "exception", "traceback", "failed", "oom", "killed", "timeout"]
    hits = [i for i, line in enumerate(lines) if any(w in line.lower() for w in words)]
    picked = lines[max(0, hits[0] - 5):hits[-1] + 10] if hits else lines[-50:]
    return "\n".join(picked)


def expected_key_lines(text):
    regexes = [rx for s in sig.CATALOGUE for rx in s.regexes]
    return [line.strip() for line in text.split("\n") if any(re.search(r, line, re.I) for r in regexes)][:10]


def test_random_texts_against_rules(spark):
    texts = random_texts(150)
    rows = logs.match_logs(logs.profile_logs(frame(spark, texts))).orderBy("id").collect()
    for row, text in zip(rows, texts):
        assert [(m.name, list(m.matches)) for m in row.matches] == expected_matches(text, sig.CATALOGUE)
        assert row.error_snippet == expected_snippet(text)
        assert row.key_log_lines == expected_key_lines(text)
        assert row.log_lines == len(text.strip().split("\n"))


def test_lines_agree_with_texts(spark):
    texts = [t for t in random_texts(40) if t.strip()]
    whole = frame(spark, texts)
    lines = logs.explode_lines(whole, ["id"], stripped=False)
    grouped = logs.line_matches(lines, ["id"]).groupBy("id", "name").agg(
        F.sort_array(F.collect_list(F.struct("rx_idx", "line_no", "pos", "match"))).alias("m"))
    got = {(r.id, r["name"]): [x["match"] for x in r.m] for r in grouped.collect()}
    want = {(i, name): hits for i, t in enumerate(texts) for name, hits in expected_matches(t, sig.CATALOGUE)}
    assert got == want
    keys = logs.line_key_lines(lines, ["id"]).orderBy("id", "rank").collect()
    for i, text in enumerate(texts):
        assert [r.line for r in keys if r.id == i] == expected_key_lines(text)
    stripped = frame(spark, [t.strip() for t in texts])
    snippet = logs.line_snippet(logs.explode_lines(stripped, ["id"]), ["id"]).orderBy("id", "line_no").collect()
    for i, text in enumerate(texts):
        assert "\n".join(r.line for r in snippet if r.id == i) == expected_snippet(text)


def test_custom_catalogue(spark):
    custom = [
        sig.Signature("start", "data_quality", "low", ("^head", r"(\w+)ing\b"), "d", "r"),
        sig.Signature("cross", "unknown", "critical", (r"a\s+b",), "d", "r"),
    ]
    texts = ["head and tail\nhead again, a\nb running", "nothing", "a  b"]
    assert families(spark, texts, custom) == [expected_matches(t, custom) for t in texts]
    assert sig.catalogue([]) is not None and len(sig.catalogue([])) == 16
    with pytest.raises(ValueError):
        sig.catalogue([sig.Signature("x", "data_quality", "low", ("(a)(b)",), "d", "r")])
    with pytest.raises(re.error):
        sig.catalogue([sig.Signature("x", "data_quality", "low", ("(",), "d", "r")])
    with pytest.raises(ValueError):
        logs.line_matches(logs.explode_lines(frame(spark, texts), ["id"]), ["id"], custom)


def test_truncation_and_tails(spark):
    rows = frame(spark, ["x" * 100_000, "x" * 100_001, "short"])
    got = logs.profile_logs(rows).orderBy("id").select("truncated", logs.tail_chars(F.col("stdout")).alias("t")).collect()
    assert [r.truncated for r in got] == [False, True, False]
    assert [len(r.t) for r in got] == [2000, 2000, 5]


def test_catalogue_size():
    assert len(sig.CATALOGUE) == 16
    assert sum(len(s.regexes) for s in sig.CATALOGUE) == 66
