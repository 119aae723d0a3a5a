"""Spelling variants against a plain statement of the same rules."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from faultline.llm import spelling

UP = str.maketrans(spelling.UPPER, spelling.LOWER)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i + 1:]


def brute(rows, least_length=7, least_count=2, factor=10):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least_length and c >= least_count}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return out


def sample_rows():
    draw = random.Random(5)
    stems = ["planning", "streams", "Señales", "\u00c9toiles\u00f7", "abcabcab", "aaaaaaaa", "letters"]
    stems += ["".join(draw.choice("abc") for _ in range(draw.randint(7, 9))) for _ in range(120)]

    def typo(word):
        at, kind = draw.randrange(len(word)), draw.randrange(3)
        letter = draw.choice("abcd\u00e9")
        return word[:at] + ("" if kind == 0 else letter) + word[at + (kind != 1):]

    rows = []
    for i in range(160):
        words = [draw.choice(stems[:draw.choice([3, 12, len(stems)])]) for _ in range(60)]
        words = [typo(w) if draw.random() < 0.2 else w for w in words]
        words = [typo(typo(w)) if draw.random() < 0.03 else w for w in words]
        rows.append((i, draw.choice([" ", "-", "_1 "]).join(words)))
    rows += [(200 + i, "chainings " * 12 + "chaininge " * (i % 4 < 3) + "chainingex" * (i % 20 == 0)) for i in range(60)]
    return rows + [(500, None), (501, ""), (None, "nullnull nullnull"), (7, rows[7][1]), (502, "Q" * 3000 + " " + "q" * 3001),
                   (503, "Q" * 3000 + " " + "q" * 3001), (504, "\u4f60\u597d short \U0001f600streams\U0001f600")]


def test_variants_equal_brute_force(spark):
    rows = sample_rows()
    docs = spark.createDataFrame(
        [(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, word string, n int, signature string").repartition(5)
    found = {tuple(r) for r in spelling.variant_groups(docs).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    expected = brute(rows)
    assert found == expected
    assert any(f for _, _, _, f, _, _ in expected) and any(n > 20 for _, _, n, _, _, _ in expected)
    assert any(f and f != root for _, _, _, f, _, root in expected)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variant_groups(docs).collect() == []


@pytest.mark.parametrize("halves_from", [4096, 2])
def test_large_signatures_lose_no_pair(halves_from):
    draw = random.Random(2)
    words = sorted({"".join(draw.choice("ab") for _ in range(draw.choice([6, 7]))).encode() for _ in range(150)})
    for short, long in ((6, 7), (7, 8)):
        role = np.array([spelling.EQUAL] * len(words) + [spelling.SHORT] * len(words) + [spelling.LONG] * len(words), np.int8)
        rows = words * 3
        a, b = spelling.verified_pairs(np.zeros(len(rows), np.int64), role, rows, halves_from)
        found = {tuple(sorted((rows[i], rows[j]))) for i, j in zip(a, b)}
        assert found == {(v, w) for v in words for w in words if v < w and one_edit(v, w)}


def test_pairs_are_dealt_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(spelling, "PAIRS_AT_ONCE", 7)
    first, count = np.array([1, 5, 0, 2, 9]), np.array([3, 0, 20, 1, 0])
    parts = list(spelling._pairs(first, count))
    assert max(len(i) for i, _ in parts) <= 7
    pairs = [(int(i), int(j)) for left, right in parts for i, j in zip(left, right)]
    assert pairs == [(i, first[i] + k) for i in range(5) for k in range(count[i])]
