"""Language ID, class model and importance resampling."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline.llm import class_lm, language, resampling
from faultline.llm.common import fold_of

SF = "/root/testdata/sf0.001"


def naive_phrases(text, training):
    """Greedy longest matches of ``text`` in any of the training parts."""
    i = n = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and any(text[i:j] in t for t in training):
            j += 1
        i = max(i + 1, j - 1)
        n += 1
    return n


def test_phrases_against_substring_search():
    draw = random.Random(2)
    parts = ["".join(draw.choice("abc ") for _ in range(60)).strip() or "a" for _ in range(4)]
    parts = [re.sub(" +", " ", p) for p in parts]
    model = language.fit([("xx", p) for p in parts])
    for _ in range(200):
        text = re.sub(" +", " ", "".join(draw.choice("abc d") for _ in range(draw.randint(1, 50))))
        if not any(c.isalpha() for c in text):
            continue
        names, scores = language.judge(model, [text])
        assert names == ["xx"]
        assert scores[0] == pytest.approx(1 - naive_phrases(text, parts) / len(text))


def test_segments_are_added_up():
    model = language.fit([("xx", "the cat sat on the mat and the dog"), ("yy", "der hund und die katze auf der matte")])
    names, _ = language.judge(model, ["the mat " * 2000, "die matte " * 2000, "THE CAT", None, "", "123 !!", "日本"])
    assert names[:3] == ["xx", "yy", "xx"] and names[3:6] == ["und"] * 3 and names[6] in ("xx", "yy")


def test_scripts_of_many_letters():
    draw = random.Random(8)
    scripts = {"aa": [chr(0x4E00 + i) for i in range(700)], "bb": [chr(0x4E00 + 600 + i) for i in range(700)]}
    phrases = {n: ["".join(draw.choices(cs, k=4)) for _ in range(900)] for n, cs in scripts.items()}
    text = lambda n, k: " ".join(draw.choice(phrases[n]) for _ in range(k))
    samples = [(n, text(n, 300)) for n in phrases for _ in range(8)] + [("en", "the cat sat on the mat " * 40)]
    model = language.fit(samples)
    texts = [text(n, 30) for n in phrases for _ in range(20)]
    names, scores = language.judge(model, texts)
    assert names == ["aa"] * 20 + ["bb"] * 20
    for i in (0, 25):
        assert scores[i] == pytest.approx(1 - naive_phrases(texts[i], [t for n, t in samples if n == names[i]]) / len(texts[i]))
    _, scores = language.judge(model, ["".join(draw.choices([chr(0xAC00 + i) for i in range(900)], k=200))])
    assert scores[0] == 0


def test_long_texts_are_learned_by_an_excerpt(spark):
    long = "der hund und die katze " * 1_000
    frame = spark.createDataFrame([(long, "de"), ("the cat and the dog", "en"), ("", "fr")], "text string, lang string")
    sample = language.sampled_texts(frame, F.lit(True))
    assert sample == [("de", long[:language.SAMPLE_TEXT]), ("en", "the cat and the dog")]


def test_language_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", F.lit("clash").alias("score"))
    held = fold_of(F.col("doc_id"), 3) == 1
    model = language.fit(language.sampled_texts(docs, ~held))
    out = language.identify(docs, model).where(held).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.98 and all(0 <= r.score <= 1 for r in out)
    extra = spark.createDataFrame([(1, None, None, "s"), (1, None, None, "s"), (None, "", "en", "s")], docs.schema)
    assert [(r.lang_pred, r.score) for r in language.identify(extra, model).collect()] == [("und", 0.0)] * 3
    assert language.identify(docs.limit(0), model).collect() == []
    nothing = language.fit(language.sampled_texts(docs, F.lit(False)))
    assert nothing is None
    assert {r.lang_pred for r in language.identify(docs.limit(3), nothing).collect()} == {"und"}


def brute_base(rows):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        ws = tokens(t)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        out.append((i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(base, 6)))
    return out


def class_rows(frame, **options):
    scored = class_lm.score_texts(frame.withColumn("held_out", fold_of(F.col("doc_id"), 5) == 1), ~F.col("held_out"), **options)
    return scored.collect()


@pytest.mark.parametrize("options", [{}, {"frequent": 40, "clustered": 20, "choices": 4, "rest": 3, "rounds": 3}])
def test_class_model_base_and_gain(spark, options):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(1000, None), (1001, ""), (1002, "\x1c İ \xa0x\x0bY"), (3, rows[3][1]), (None, "Null Id the")]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, score string")
    out = class_rows(frame, **options)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=repr)
    assert got == sorted(brute_base(rows), key=repr)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_class_model_is_a_distribution(spark):
    texts = ["a b a c", "b a d", "c c a b", "d a b a"] * 3
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    model, counts = class_lm.fit(frame, frequent=2, clustered=2, choices=2, rest=2, rounds=2)
    n = {r.word: r.n for r in counts.collect()}
    classes = {w: model.classes[model.codes[w.encode()]] if w.encode() in model.codes else 2 + class_lm.rest_class(w.encode(), 2) for w in n}
    width = len(model.pair_logs)
    for previous in range(width):
        p = sum(10 ** model.pair_logs[previous, classes[w]] * (c + 0.5) for w, c in n.items())
        p += 10 ** model.pair_logs[previous, width - 1] * (model.ends + 0.5)
        # Each class keeps half a count for words not seen, the unigram part half a count in all.
        unseen = (10 ** model.pair_logs[previous] * 0.5).sum() - (width - 1) * 0.5 * 0.1 / (model.train_tokens + 0.5 * (model.distinct + 1))
        assert p + unseen == pytest.approx(1.0)


def test_exchange_gains(spark):
    draw = random.Random(1)
    text = " ".join(f"{draw.choice('abcd')} {draw.choice('wxyz')}" for _ in range(400))
    frame = spark.createDataFrame([(text,)], "text string")
    model, _ = class_lm.fit(frame, frequent=8, clustered=8, choices=2, rest=1, rounds=8)
    of = {w.decode(): int(model.classes[i]) for w, i in model.codes.items()}
    assert len({of[c] for c in "abcd"}) == 1 and len({of[c] for c in "wxyz"}) == 1 and of["a"] != of["w"]


def brute_best(matrix, choices, now, after, before):
    """The class with the greatest likelihood of the class pairs after the move, tried one by one."""
    def moved(to):
        m = matrix.copy()
        for c in range(len(m)):
            m[now, c], m[to, c] = m[now, c] - after[c], m[to, c] + after[c]
            m[c, now], m[c, to] = m[c, now] - before[c], m[c, to] + before[c]
        return class_lm.likelihood(m)

    return max(range(choices), key=moved)


def test_every_word_is_clustered_and_scored_by_its_class(spark):
    """All words of training, once or often there, broadcast or joined: class by best gain, pairs and scores by brute force."""
    draw = random.Random(5)
    lower = [[f"{a}{i}{draw.choice('xyz')}{draw.choice('uv')}" for i in range(30)] for a in "pq"]
    texts = [" ".join(draw.choice(lower[i % 2][:draw.choice([3, 30])]) for i in range(draw.randint(0, 25))) for _ in range(120)]
    rows = [(i, t, i % 5 == 0) for i, t in enumerate([*texts, None, "new words p0 here"])]
    frame = spark.createDataFrame(rows, "doc_id int, text string, held boolean").repartition(3)
    for frequent in (6, 20, 1_000):
        options = {"frequent": frequent, "head": 4, "choices": 2, "rest": 3, "rounds": 2}
        model, counts = class_lm.fit(frame.where("NOT held").select("text"), **options)
        table = {r.word: (r.n, r.c) for r in counts.collect()}
        learned = [(t or "").split() for _, t, held in rows if not held]
        assert {w: n for w, (n, _) in table.items()} == Counter(w for t in learned for w in t) and len(table) == counts.count()
        assert {c for _, c in table.values()} <= {0, 1}
        # The suffix classes and the two classes of the head, from which all others moved at once.
        top = sorted(table, key=lambda w: (-table[w][0], w))[:4]
        start = {w: table[w][1] if w in top else 2 + class_lm.rest_class(w.encode(), 3) for w in table}
        ids = [[5, *[start[w] for w in t], 5] for t in learned]
        matrix = np.zeros((6, 6))
        for t in ids:
            np.add.at(matrix, (t[:-1], t[1:]), 1)
        sides = {w: np.zeros((2, 6)) for w in table}
        for t, i in zip(learned, ids):
            for at, w in enumerate(t, 1):
                sides[w][0, i[at + 1]] += 1
                sides[w][1, i[at - 1]] += 1
        for w in set(table) - set(top):
            assert table[w][1] == class_lm.best_class(matrix, start[w], *sides[w], 2), w
            # Without a neighbour of its own class the gain is that of the move itself.
            if not sides[w][:, start[w]].any():
                assert table[w][1] == brute_best(matrix, 2, start[w], *sides[w])
        of = lambda w: table[w][1] if w in table else 2 + class_lm.rest_class(w.encode(), 3)
        matrix = np.zeros((6, 6))
        for t in learned:
            t = [5, *map(of, t), 5]
            np.add.at(matrix, (t[:-1], t[1:]), 1)
        n, ends = sum(k for k, _ in table.values()), len(learned)
        size = [0.5 + sum(k + 0.5 for k, x in table.values() if x == c) for c in range(5)] + [1 + ends]
        follow = (matrix + class_lm.ADDED) / (matrix.sum(1, keepdims=True) + class_lm.ADDED * 6)

        def score(text):
            total, previous = 0.0, 5
            for w in [*(text or "").split(), None]:
                c, k = (5, ends) if w is None else (of(w), table.get(w, (0, 0))[0])
                p = class_lm.WEIGHT * follow[previous, c] * (k + 0.5) / size[c]
                total += math.log10(p + (1 - class_lm.WEIGHT) * (k + 0.5) / (n + ends + 0.5 * (len(table) + 2)))
                previous = c
            return total

        for out in (class_lm.score(frame, model, counts), class_lm.score_texts(frame, ~F.col("held"), **options)):
            got = {r.doc_id: r for r in out.collect()}
            assert len(got) == len(rows)
            for i, text, held in rows:
                words = (text or "").split()
                assert (got[i].held, got[i].n_tokens, got[i].n_known) == (held, len(words) + 1, sum(w in table for w in words) + 1)
                assert got[i].score == pytest.approx(score(text))


def test_pieces_of_codes_hold_whole_texts(monkeypatch):
    draw = random.Random(9)
    rare = [draw.sample(["x", "y", "z", "ü"], draw.randint(0, 4)) for _ in range(30)]
    codes = [[draw.randrange(5 + len(r)) for _ in range(draw.choice([0, 3, 40]))] for r in rare]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([np.array(c, np.int32).tobytes() for c in codes], pa.binary()), pa.array(rare, pa.list_(pa.string()))],
        names=["codes", "rare"]).slice(2)
    monkeypatch.setattr(class_lm, "PIECE_CODES", 50)
    got, sizes = [], []
    for piece, s in class_lm.sequences(iter([batch, batch.slice(0, 0)]), 5):
        words = [*range(5), *s.rare.to_pylist(), None]
        named = [words[c] for c in s.codes]
        assert [named[i] for i in s.starts] == [None] * (piece.num_rows + 1)
        got += [named[a + 1:b] for a, b in zip(s.starts[:-1], s.starts[1:])]
        sizes.append(len(named) - piece.num_rows - 1)
    assert got == [[c if c < 5 else r[c - 5] for c in cs] for cs, r in zip(codes[2:], rare[2:])]
    assert len(sizes) > 5 and max(sizes) <= 50


def test_class_model_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert class_rows(empty) == []
    model, counts = class_lm.fit(empty.select("text"))
    [row] = class_lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model, counts).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and row.base_score == pytest.approx(0.0)


LABELS = "doc_id long, quality int, toxic int"


def test_resampling_splits_good_from_bad(spark):
    draw = random.Random(4)
    good = [(i, " ".join(draw.choice(["the", "of", "cat", "dog", "and", "tree", "house"]) for _ in range(60))) for i in range(300)]
    bad = [(i, " ".join(draw.choice(["%%%", "|", "buy", "###"]) for _ in range(60))) for i in range(300, 360)]
    extra = [(400, None), (401, ""), (1, good[1][1]), (None, good[2][1])]
    docs = spark.createDataFrame([(*r, "c") for r in good + bad + extra], "doc_id long, text string, perturbed string")
    labels = spark.createDataFrame(
        [(i, 1, 0) for i in range(100)] + [(i, 0, 0) for i in range(300, 330)] + [(5, 0, 0), (6, None, None), (None, 1, 0), (7, 1, None)], LABELS)
    out = resampling.resample(docs, labels, resampling.good_label()).collect()
    assert len(out) == 364
    assert {r.doc_id for r in out if not r.sampled} == set(range(300, 360))
    assert {r.log_weight for r in out if r.doc_id in (400, 401)} == {0.0}
    unlabelled = resampling.resample(docs, labels.limit(0), resampling.good_label()).collect()
    assert all(r.sampled and r.log_weight == 0 for r in unlabelled)
    assert resampling.resample(docs.limit(0), labels, resampling.good_label()).collect() == []


def test_toxic_texts_of_good_quality_go(spark):
    draw = random.Random(5)
    plain, slurs = [f"w{i}" for i in range(300)], ["idiot", "scum", "trash", "moron", "clown"]
    docs = [[draw.choice(plain) for _ in range(draw.randint(50, 600))] for _ in range(600)]
    rude = set(range(0, 600, 6))
    for i in rude:
        for _ in range(3):
            docs[i][draw.randrange(len(docs[i]))] = draw.choice(slurs)
    rude = {i for i in rude if len(set(docs[i]) & set(slurs)) > 1}
    clean = {i for i, d in enumerate(docs) if not set(d) & set(slurs)}
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").repartition(3)
    # Half of the rows are labelled; ids 600 and more are labels without a document.
    labels = spark.createDataFrame(
        [(i, 1, int(i in rude)) for i in range(300) if i in rude | clean] + [(2, 1, None), (600, 1, 1), (None, 1, 1)], LABELS)
    out = resampling.resample(frame, labels, resampling.good_label(), toxic=resampling.toxic_label()).collect()
    kept = {r.doc_id for r in out if r.sampled}
    assert len(out) == 600 and len(kept & rude) <= 0.05 * len(rude) and len(kept & clean) >= 0.99 * len(clean)
    blind = resampling.resample(frame, labels, resampling.good_label()).collect()
    assert len({r.doc_id for r in blind if r.sampled} & rude) > 0.9 * len(rude)
    unjudged = resampling.resample(frame, labels.where("toxic = 0"), resampling.good_label(), toxic=resampling.toxic_label()).collect()
    assert len({r.doc_id for r in unjudged if r.sampled} & rude) > 0.9 * len(rude)


def test_bar_of_fewest_errors():
    scores, toxic = np.array([0.0, 1.0, 2.0, 3.0, 4.0]), np.array([True, False, False, True, True])
    assert resampling.best_bar(scores, toxic, np.ones(5)) == 2.5
    assert resampling.best_bar(scores, toxic, np.array([1, 1, 1, 1, 9.0])) == 2.5
    assert resampling.best_bar(scores, toxic, np.array([1, 1, 9, 1, 0.5])) == 2.5
    assert resampling.best_bar(scores, ~toxic, np.array([9, 1, 1, 9, 9.0])) == np.inf


def test_gumbel_top_k_follows_weights(spark):
    n = 3000
    rows = spark.createDataFrame([(t, i) for t in range(n) for i in range(4)], "t long, i long")
    weight = F.log(F.col("i") + 1.0)
    drawn = rows.withColumn("x", weight + resampling.gumbel(F.col("t").cast("string"), F.col("i").cast("string")))
    first = drawn.groupBy("t").agg(F.max_by("i", "x").alias("i")).groupBy("i").count().collect()
    for r in first:
        p = (r.i + 1) / 10
        assert abs(r["count"] / n - p) < 5 * math.sqrt(p * (1 - p) / n)


def test_kth_largest(spark):
    draw = random.Random(6)
    values = [draw.gauss(0, 1000) for _ in range(5000)] + [1e300, -1e300, 0.0, 0.0, 0.0] + [7.25] * 50
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 17, 2500, 5054, 5055, 9999):
        assert resampling.kth_largest(frame, k) == ordered[min(k, len(values)) - 1]
    assert resampling.kth_largest(frame, 0) is None and resampling.kth_largest(frame.limit(0), 3) is None
