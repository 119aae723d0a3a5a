"""Line dedup against a plain statement, and an index extended and undone against one built anew."""

import random

import numpy as np
import pytest

from faultline.llm import line_dedup

SCHEMA = "doc_id long, text string, hi string, kind int, documents string"
STRIP = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(STRIP))


def brute(judged, stored=None):
    holders = {}
    for i, text in judged if stored is None else stored:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(-1 if i is None else i)
    out = []
    for i, text in judged:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(holders.get(key(x), ())) < 3 or len(key(x)) < 20
                or max(holders[key(x)]) == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def sample_rows(n=150, first=0):
    draw = random.Random(first)
    shared = [f"Shared line number {i} of this corpus" for i in range(25)]
    shared += ["\u00c9t\u00e9 line of twenty points", "ASCII UPPER line of points", "short", "nineteen code point"]
    rows = []
    for i in range(first, first + n):
        lines = [draw.choice(shared) for _ in range(draw.randint(0, 4))] + [f"own line of document {i}, part {j}" for j in range(3)]
        lines += ["A line that all the documents hold"] * draw.randint(1, 2)
        lines = [draw.choice([x, x.upper() if x.isascii() else x, f"  \t{x}\r", f"\u00a0{x}"]) for x in lines]
        draw.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    return rows


ODD = [(9000, None), (9001, ""), (9002, "\n\n"), (9003, "x" * 200_000 + "\n" + "Shared line number 3 of this corpus"),
       (None, "Shared line number 3 of this corpus"), (None, "A line that all the documents hold"),
       (4, "Shared line number 3 of this corpus\nShared line number 3 of this corpus")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(4)


def result(index, docs, **more):
    rows = line_dedup.without_repeated_lines(index, docs, **more).collect()
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in rows), key=repr)


def tables(index):
    counts = sorted(map(tuple, index.counts.collect()))
    return counts, sorted(map(repr, index.references.select("hi", "lo", "doc_id").collect()))


def test_dedup_equals_brute_force(spark):
    rows = sample_rows() + ODD
    docs = frame(spark, rows)
    index = line_dedup.build(docs, shards=7)
    expected = brute(rows)
    assert result(index, docs, references=index.references) == expected and result(index, docs) == expected
    assert sum(n for _, _, n, _ in expected) > 100
    new = sample_rows(30, 5000)
    assert result(index, frame(spark, new)) == brute(new, rows)


def test_insert_and_delete_are_reversible(spark, tmp_path):
    first, second = sample_rows(60), sample_rows(40, 100) + ODD
    index = line_dedup.build(frame(spark, first), shards=5)
    both = line_dedup.insert(index, frame(spark, second))
    # ODD holds id 4 again, which replaces that document of the first lot.
    kept = [r for r in first if r[0] != 4]
    assert result(both, frame(spark, kept + second)) == brute(kept + second)
    assert tables(both) == tables(line_dedup.build(frame(spark, kept + second), shards=5)) != tables(index)
    undone = line_dedup.delete(both, frame(spark, second))
    assert tables(undone) == tables(line_dedup.build(frame(spark, kept), shards=5))
    assert result(undone, frame(spark, kept)) == brute(kept)
    again = line_dedup.insert(undone, frame(spark, [first[4]]))
    assert tables(again) == tables(index) and result(again, frame(spark, first)) == brute(first)
    again.saved(str(tmp_path / "index"))
    assert result(line_dedup.load(spark, str(tmp_path / "index")), frame(spark, first)) == brute(first)
    assert line_dedup.delete(again, frame(spark, [(77777, "")])) is again
    entries = {n: sum(np.count_nonzero(np.frombuffer(r.slots, np.uint16)) + len(r.stash) // 8 for r in i.filters.collect())
               for n, i in (("index", index), ("again", again))}
    assert entries["index"] == entries["again"]


def test_empty_tables(spark):
    index = line_dedup.build(frame(spark, []))
    assert result(index, frame(spark, [])) == []
    rows = sample_rows(20)
    assert result(index, frame(spark, rows)) == [(i, len(t.split("\n")), 0, t) for i, t in sorted(rows, key=repr)]
    assert result(line_dedup.insert(index, frame(spark, rows)), frame(spark, rows)) == brute(rows)


@pytest.mark.parametrize("keys, room", [(3000, 3000), (3000, 500)])
def test_cuckoo_filter(keys, room):
    draw = np.random.default_rng(1)
    hi, lo = draw.integers(-2 ** 63, 2 ** 63 - 1, (2, keys))
    made = line_dedup.CuckooFilter.sized(room)
    made.insert(hi, lo)
    assert made.contains(hi, lo).all() and (len(made.stash) > 0) == (room < keys)
    loaded = line_dedup.CuckooFilter.loaded(*made.dumped())
    loaded.delete(hi[:1000], lo[:1000])
    assert loaded.contains(hi[1000:], lo[1000:]).all() and loaded.contains(hi[:1000], lo[:1000]).mean() < 0.1
    loaded.delete(hi[1000:], lo[1000:])
    assert not loaded.slots.any() and not loaded.stash
    other = draw.integers(-2 ** 63, 2 ** 63 - 1, (2, 100_000))
    if room == keys:
        assert made.contains(*other).mean() < 0.001
