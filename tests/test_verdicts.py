"""Reply recovery and validation against a plain statement of the rules."""

import json
import random

from pyspark.sql import functions as F

from faultline.functions import verdict as v
from faultline.operators.verdicts import choose_verdict, parse_replies
from faultline.schemas import CATEGORIES, SEVERITIES

BASE = {"error_category": "data_quality", "severity": "high", "root_cause": "x", "root_cause_summary": "y",
        "confidence": 0.5, "evidence": ["a", "b"]}


def parse(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    return [r.model_verdict for r in parse_replies(df).orderBy("i").collect()]


def inside_fence(text):
    for mark in ("```json", "```"):
        if mark in text:
            rest = text.split(mark, 1)[1]
            return rest.rsplit("```", 1)[0] if "```" in rest else rest
    return text


def balanced(text):
    start = text.find("{")
    depth = 0
    for i in range(start, len(text)) if start >= 0 else []:
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if depth == 0:
            return text[start:i + 1]
    return None


def test_fence_and_braces(spark):
    rng = random.Random(3)
    pieces = ["```json", "```", "{", "}", "{}", "a", "\n", '"k":1', " ", "}}", "{{"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", v.strip_fence(F.col("t")).alias("f"), v.outermost_object(F.col("t")).alias("o")).orderBy("i")
    for r, text in zip(rows.collect(), texts):
        assert r.f == inside_fence(text), text
        assert r.o == balanced(text), text


def test_valid_replies(spark):
    body = json.dumps(BASE)
    nested = json.dumps({**BASE, "root_cause": "brace } in text"})
    got = parse(spark, [
        body, f"```json\n{body}\n```", f"```\n{body}\n``` tail", f"text {body} more {{", f"```json\n{body}", nested,
        json.dumps({**BASE, "confidence": "0.25"}), json.dumps({**BASE, "root_cause": "a\nb"}).replace("\\n", "\n"),
        json.dumps({**BASE, "extra": [1]}), f"[{body}]", json.dumps({**BASE, "confidence": 1}),
    ])
    assert all(got)
    assert got[5].root_cause == "brace } in text" and got[6].confidence == 0.25 and got[7].root_cause == "a\nb"


def test_invalid_replies(spark):
    def changed(**fields):
        return json.dumps({**BASE, **fields})

    texts = ["", "no json", "{", "{}", "[1]", changed(error_category="other"), changed(severity="HIGH"),
             changed(confidence=1.5), changed(confidence=-0.1), changed(confidence=None), changed(root_cause=5),
             changed(evidence=None), changed(evidence=["a", 1]), changed(evidence="a"), changed(recommendations=["x"]),
             changed(recommendations=None), changed(immediate_action=5),
             json.dumps({k: x for k, x in BASE.items() if k != "root_cause_summary"})]
    assert parse(spark, texts) == [None] * len(texts)


def expected_priority(value):
    if isinstance(value, int):
        return max(1, min(5, int(value)))
    if isinstance(value, str):
        try:
            return max(1, min(5, int(value)))
        except ValueError:
            return {"critical": 1, "immediate": 1, "high": 2, "medium": 3, "low": 4}.get(value.lower(), 3)
    return 3


def test_priorities(spark):
    values = [1, 0, -4, 7, 3, "2", " 4 ", "+5", "-1", "99", "4.7", 4.7, 2.0, True, None, "critical", "Immediate", "HIGH",
              "medium", "low", "urgent", "", [1], {"a": 1}]
    body = {**BASE, "recommendations": [{"action": str(i), "priority": p} for i, p in enumerate(values)] + [{}]}
    got = parse(spark, [json.dumps(body)])[0].recommendations
    expected = [expected_priority(p) if not isinstance(p, bool) else 1 for p in values] + [3]
    assert [r.priority for r in got] == expected
    assert got[-1].action == "" and got[-1].automated is False


def test_enums():
    assert len(CATEGORIES) == 10 and len(SEVERITIES) == 4


def test_choice(spark):
    from faultline.operators.logs import match_logs

    logs = spark.createDataFrame([(0, "SSLError: certificate verify failed", json.dumps(BASE)),
                                  (1, "SSLError: certificate verify failed", "?"), (2, "fine", "?")],
                                 "i int, stdout string, raw string")
    rows = parse_replies(match_logs(logs).withColumn("primary", F.get("matches", F.lit(0))))
    got = [(r.verdict, r.verdict_source) for r in choose_verdict(rows).orderBy("i").collect()]
    assert got[0][1] == "model" and got[0][0].error_category == "data_quality"
    fallback = got[1][0]
    assert (fallback.error_category, fallback.severity, fallback.confidence) == ("network_error", "high", 0.6)
    assert fallback.evidence == ["Pattern match: SSLError", "Pattern match: certificate verify failed",
                                 "Pattern match: SSLError"]
    assert [r.priority for r in fallback.recommendations] == [1]
    assert (got[2][0].error_category, got[2][0].severity, got[2][0].confidence) == ("unknown", "medium", 0.2)
