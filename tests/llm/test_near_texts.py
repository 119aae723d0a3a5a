"""Decontamination and the similarity join against brute force."""

import random
import re

import numpy as np
import pytest

from faultline.llm import decontamination, jaccard_join
from faultline.llm.common import components, shingle_codes

DOCS = "doc_id long, text string, class_id string"


def vocabulary(n=400):
    draw = random.Random(9)
    return ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 8))) for _ in range(n)]


def shingles(text, width=5):
    words = re.findall(r"\w+", (text or "").lower())
    return {tuple(words[i:i + width]) for i in range(max(len(words) - width + 1, 1))} if words else set()


def brute_join(rows):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    link = [[i != j and bool(sets[i]) and bool(sets[j]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if link[i][j]:
                    root[i] = root[j] = min(root[i], root[j])
    out = []
    for i in range(n):
        group = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        out.append((rows[i][0], min(group) if group else None, sum(link[i])))
    return sorted(out, key=repr)


def near_copies(draw, words, text, changes):
    parts = text.split()
    for _ in range(changes):
        parts[draw.randrange(len(parts))] = draw.choice(words)
    return " ".join(parts)


def sample_rows():
    draw, words = random.Random(11), vocabulary()
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(30, 150))) for _ in range(25)]
    rows = list(enumerate(texts))
    for base in range(6):
        rows += [(len(rows) + i, near_copies(draw, words, texts[base], draw.randint(1, 3))) for i in range(5)]
    rows += [(100, texts[0]), (101, texts[0].upper() + "!"), (102, None), (103, ""), (104, " .. "), (105, "one two"), (106, "One, two"),
             (None, texts[7]), (7, texts[7]), (None, "only null ids here at all"), (None, "only null ids here at all")]
    return rows


@pytest.mark.parametrize("limits", [(512, 256), (4, 3)])
def test_join_against_brute_force(spark, monkeypatch, limits):
    monkeypatch.setattr(jaccard_join, "BUCKET", limits[0])
    monkeypatch.setattr(jaccard_join, "TILE", limits[1])
    rows = sample_rows()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], DOCS).repartition(3)
    out = jaccard_join.linked_documents(docs).collect()
    assert sorted(((r.doc_id, r.class_id, r.links) for r in out), key=repr) == brute_join(rows)


def test_one_of_each_class_stays(spark):
    rows = sample_rows()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], DOCS)
    out = jaccard_join.without_near_copies(docs)
    assert out.columns == docs.columns
    kept = sorted((r.doc_id for r in out.collect()), key=repr)
    classes = {c for i, c, _ in brute_join(rows) if c is not None and i not in (102, 103, 104)}
    assert kept == sorted([*classes, 102, 103, 104, None], key=repr)


def test_join_of_nothing(spark):
    assert jaccard_join.linked_documents(spark.createDataFrame([], DOCS)).collect() == []
    one = jaccard_join.linked_documents(spark.createDataFrame([(1, None, "x")], DOCS)).collect()
    assert [tuple(r) for r in one] == [(1, 1, 0)]


def test_paths_bring_similar_sets_together():
    draw = np.random.default_rng(5)
    pairs, hits = 400, {0.8: 0, 0.9: 0}
    for similarity in hits:
        signatures = draw.integers(0, 2**16, (2 * pairs, jaccard_join.HASHES)).astype("<u2")
        same = draw.random((pairs, jaccard_join.HASHES)) < similarity
        signatures[pairs:] = np.where(same, signatures[:pairs], signatures[pairs:])
        met = set()
        for run in range(1, jaccard_join.RUNS + 1):
            paths = np.repeat(jaccard_join.mixed(np.array([run], np.uint64)), 2 * pairs)
            owners = np.arange(2 * pairs)
            for _ in range(jaccard_join.DEPTH):
                paths, owners = jaccard_join.children(paths, owners, signatures)
            buckets = {}
            for p, o in zip(paths.tolist(), owners.tolist(), strict=True):
                buckets.setdefault(p, set()).add(o)
            met |= {i for b in buckets.values() for i in b if i < pairs and i + pairs in b}
        hits[similarity] = len(met) / pairs
    assert hits[0.8] >= 0.99 and hits[0.9] >= 0.995


def test_pairs_of_hot_buckets_are_found(spark, monkeypatch):
    # With one set a bucket every bucket is too large and goes down to the last level.
    monkeypatch.setattr(jaccard_join, "BUCKET", 1)
    draw, pairs = np.random.default_rng(6), 1_500
    a = draw.integers(0, 2**16, (pairs, jaccard_join.HASHES)).astype("<u2")
    b = np.where(draw.random(a.shape) < 0.8, a, draw.integers(0, 2**16, a.shape).astype("<u2"))
    rows = [(i, x.tobytes()) for i, x in enumerate([*a, *b])]
    reps = spark.createDataFrame([(i, bytearray(x)) for i, x in rows], "rep long, signature binary").repartition(4)
    found = {tuple(sorted((r.a, r.b))) for r in jaccard_join.candidate_links(reps, jaccard_join.RUNS).collect()}
    assert found <= {(i, i + pairs) for i in range(pairs)} and len(found) >= 0.998 * pairs


def test_components(spark):
    draw = random.Random(8)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    root = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    out = components(spark.createDataFrame(edges, "a long, b long"), "test-components").collect()
    assert {r.node: r.root for r in out} == root and len(out) == len(root)
    assert components(spark.createDataFrame([], "a long, b long"), "test-components").collect() == []


def brute_matches(docs, items, similarity=0.8):
    """All windows of every item's length, by multisets of shingles of equal weight."""
    out = set()
    for i, text in docs:
        words = re.findall(r"\w+", (text or "").lower())
        for item, item_text in items:
            wanted = re.findall(r"\w+", (item_text or "").lower())
            if not wanted or not words:
                continue
            n, width = min(len(wanted), len(words)), min(5, len(wanted))
            of = lambda ws, width=width: [tuple(ws[a:a + min(width, len(ws))]) for a in range(max(len(ws) - width + 1, 1))]
            for at in range(len(words) - n + 1):
                a, b = set(of(words[at:at + n])), set(of(wanted))
                if len(a & b) >= similarity * len(a | b):
                    out.add((i, item))
                    break
    return out


def test_contamination_against_brute_force(spark):
    draw, words = random.Random(13), vocabulary(900)
    items = [(i, " ".join(draw.sample(words, draw.randint(12, 45)))) for i in range(30)] + [(40, None), (41, ""), (42, "tiny item")]
    docs = []
    for i in range(80):
        body = [draw.choice(words) for _ in range(draw.randint(5, 200))]
        if i % 2:
            passage = items[draw.randrange(30)][1].split()
            if i % 4 == 1:
                passage[len(passage) // 2] = "changed"
            if i % 8 == 3:
                passage = passage[: len(passage) // 2]
            at = draw.randrange(len(body))
            body[at:at] = passage
        docs.append((i, " ".join(body).upper() if i % 3 else ",\n".join(body)))
    docs += [(90, None), (91, ""), (92, "Tiny... ITEM!"), (93, items[3][1]), (93, items[3][1]), (None, items[4][1]), (95, "x " * 9000 + items[5][1])]
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, similarity string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_matches(docs, items)
    for slice_words in (decontamination.SLICE_WORDS, 100):
        out = decontamination.contaminated(frame, bench, slice_words=slice_words).collect()
        assert {(r.doc_id, r.item_id) for r in out} == want
        assert sum(r.doc_id == 93 and r.item_id == 3 for r in out) == 2
    whole = [r for r in out if r.doc_id == 95][0]
    assert (whole.first_word, whole.words, round(whole.similarity, 9)) == (9000, len(items[5][1].split()), 1.0)
    clean = decontamination.clean_documents(frame, bench)
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((i for i, _ in docs if i not in {d for d, _ in want}), key=repr)
    assert clean.schema == frame.schema
    assert decontamination.contaminated(frame, bench.limit(0)).collect() == []
    assert decontamination.contaminated(frame.limit(0), bench).collect() == []


def test_items_without_id_are_found(spark):
    """They count as one item with a null id, in any number of slices."""
    draw, words = random.Random(17), vocabulary(900)
    items = [(1, " ".join(draw.sample(words, 30))), (None, " ".join(draw.sample(words, 25))), (None, " ".join(draw.sample(words, 40))), (None, None)]
    docs = [(i, f"before {items[i % 3][1]} after it") for i in range(6)] + [(6, " ".join(draw.sample(words, 60)))]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for slice_words in (decontamination.SLICE_WORDS, 20):
        out = decontamination.contaminated(frame, bench, slice_words=slice_words).collect()
        assert sorted((r.doc_id, r.item_id) for r in out) == [(i, None if i % 3 else 1) for i in range(6)]
        assert [r.doc_id for r in decontamination.clean_documents(frame, bench, slice_words=slice_words).collect()] == [6]


def test_equal_passages_have_equal_fingerprints():
    draw, words = random.Random(3), vocabulary(5_000)
    items = [(i, " ".join(draw.choices(words, k=24))) for i in range(500)]
    index = decontamination.ItemIndex(items, decontamination.WIDTH, decontamination.SIMILARITY, 0)
    texts = [" ".join([*draw.choices(words, k=50), text, *draw.choices(words, k=20)]) for _, text in items]
    found = [[m[0] for m in one] for one in decontamination.document_matches(index, texts)]
    assert found == [[i] for i in range(500)]


def test_multi_index_finds_all_within_the_radius():
    draw = np.random.default_rng(2)
    stored = draw.integers(0, 2**64, 300, np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << draw.choice(64, n, replace=False).astype(np.uint64)) if n else 0 for n in draw.integers(0, 25, 300)], np.uint64)
    queries = stored ^ flips
    got = set(zip(*(a.tolist() for a in decontamination.MultiIndex(stored, 18).within(queries)), strict=True))
    near = np.bitwise_count(queries[:, None] ^ stored[None, :]) <= 18
    assert got == set(zip(*(a.tolist() for a in np.nonzero(near)), strict=True))


def test_shingles_of_few_words():
    codes = np.arange(3, dtype=np.uint64)
    assert len(shingle_codes(codes, 5)) == 1 and len(shingle_codes(codes[:0], 5)) == 0 and len(shingle_codes(codes, 2)) == 2
