"""Token counts, token files and sampled segmentations against the libraries and brute force."""

import gc
import io
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

from faultline.llm import segmentation, token_counts, token_files
from faultline.session import shared_dir

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "\n\t", "Hello, WORLD's it'll 12345 don't!!!", "aaaaaaa aaaaaaaaab ababab", "é e\u0301 ﬁ Ⅳ ½ ² ª",
    "<|startoftext|>a<|endoftext|><|endoftext|> b <|ENDOFTEXT|>", "\x1c a\x1db\x1f \x85 \xa0", "日本語 テキスト 한국어",
    "İstanbul ΣΑΣ ẞ ǅ", "emoji 👩‍👩‍👧 🙂🙂", "x" * 3000, "a b " * 4000, "\u2028line\u3000wide", "'s 's'T 'RE '", "\x00\x01 nul",
]


def documents(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], 2, "y"), (None, "null id", 3, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, start string"), rows


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_token_counts(spark):
    frame, rows = documents(spark)
    out = token_counts.token_counts(frame, VOCABULARY, limit=100).collect()
    tokens = library()
    want = [(i, len((t or "").encode()), n := len(tokens.encode(t or "", add_special_tokens=False).ids), n > 100) for i, t, _, _ in rows]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out), key=repr) == sorted(want, key=repr)
    assert out[0].start == "x"
    assert token_counts.token_counts(frame.limit(0), VOCABULARY).collect() == []


def test_counts_of_random_words():
    draw = random.Random(5)
    words = ["".join(draw.choice("abetinosr'é.!9") for _ in range(draw.randint(1, 14))) for _ in range(4000)]
    texts = [" ".join(words[i:i + 40]) for i in range(0, 4000, 40)]
    tokens = library()
    assert token_counts.Counter(VOCABULARY).count(texts) == [len(tokens.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_files_round_trip(spark):
    frame, rows = documents(spark)
    out = token_files.token_file_index(frame, VOCABULARY, end_id=2, file_rows=5).collect()
    tokens, want, start = library(), [], 0
    for i, text, _, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokens.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in out), key=lambda r: r[1]) == want


def test_token_file_format(spark):
    folder = shared_dir(spark, "format")
    docs = spark.createDataFrame([(2, "two words"), (None, "none"), (1, "")], "doc_id long, text string").coalesce(1)
    manifest = token_files.write_token_files(docs, VOCABULARY, folder, None, file_rows=10).collect()
    store, base = token_files.filesystem(folder)
    assert sum(m.documents for m in manifest) == 3
    for m in manifest:
        with store.open_input_file(f"{base}/{m.name}") as source:
            content = source.read()
        reader = token_files.FileReader(io.BytesIO(content), len(content))
        packed = b"".join(reader.ids(i) for i in range(len(reader)))
        # Any reader of the format sees the ids alone.
        assert zstandard.ZstdDecompressor().decompressobj().decompress(content) == reader.ids(0)
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True).read()
        assert whole == packed and len(packed) == 4 * m.tokens
        damaged = bytearray(content)
        at = int(reader.starts[len(reader) - 1]) + int(reader.table[len(reader) - 1, 0]) - 1
        damaged[at] ^= 255
        if len(reader.ids(len(reader) - 1)):
            with pytest.raises((ValueError, zstandard.ZstdError)):
                token_files.FileReader(io.BytesIO(bytes(damaged)), len(damaged)).ids(len(reader) - 1)
    empty = token_files.token_file_index(docs.limit(0), VOCABULARY)
    assert empty.collect() == []


@pytest.fixture(scope="module")
def lattices():
    return segmentation.Lattices(segmentation.Pieces(PIECES), 0.5)


def every_segmentation(lattices, text):
    """(ids, probability) of all segmentations, by recursion over the string."""
    pieces = lattices.pieces
    spelled = {p.replace(b" ", segmentation.BLANK.encode()).decode("utf-8", "ignore"): i for i, p in enumerate(pieces.text)
               if p and i not in set(pieces.byte_ids.tolist())}
    string = segmentation.BLANK + text.replace(" ", segmentation.BLANK)

    def split(rest):
        if not rest:
            yield (), 0.0
            return
        for n in range(1, min(16, len(rest)) + 1):
            options = []
            if rest[:n] in spelled:
                options = [((spelled[rest[:n]],), pieces.log_prob[spelled[rest[:n]]])]
            elif n == 1:
                data = rest[0].encode()
                options = [(tuple(pieces.byte_ids[b] for b in data), pieces.byte_log_prob * len(data))]
            for ids, score in options:
                for tail, more in split(rest[n:]):
                    yield ids + tail, score + more

    found = [(ids, lattices.alpha * score) for ids, score in split(string)]
    total = math.log(sum(math.exp(s) for _, s in found))
    return {ids: s - total for ids, s in found}


@pytest.mark.parametrize("text", ["the cat", "a", "ab\ncd", " é x", "東京 a"])
def test_all_segmentations_once_k_is_large(lattices, text):
    want = every_segmentation(lattices, text)
    [(paths, following)] = segmentation.top_segmentations(lattices, [text], np.array([7], np.uint64), len(want) + 3)
    got = {tuple(segmentation.ids_of(lattices, p.edges).tolist()): p.log_prob for p in paths}
    assert len(paths) == len(got) == len(want) and math.isinf(following)
    for ids, log_prob in want.items():
        assert got[tuple(int(i) for i in ids)] == pytest.approx(log_prob, abs=1e-9)
    values = [p.value for p in paths]
    assert values == sorted(values)


def test_samples_follow_the_law_of_drawing_without_replacement(lattices):
    text, k, n = "the on", 2, 6000
    want = every_segmentation(lattices, text)
    drawn = segmentation.top_segmentations(lattices, [text] * n, np.arange(1, n + 1, dtype=np.uint64), k)
    counts = Counter(tuple(tuple(segmentation.ids_of(lattices, p.edges).tolist()) for p in paths) for paths, _ in drawn)
    law = {}
    for a, b in itertools.permutations(want, 2):
        p, q = math.exp(want[a]), math.exp(want[b])
        law[tuple(int(i) for i in a), tuple(int(i) for i in b)] = p * q / (1 - p)
    for pair, p in law.items():
        assert abs(counts[pair] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
    # Weighted by their inverse inclusion scores the samples' probabilities add up to 1 without bias.
    sums = [sum(math.exp(p.log_prob - segmentation.log_inclusion(p.log_prob, y)) for p in paths) for paths, y in drawn]
    assert abs(np.mean(sums) - 1) < 5 * np.std(sums) / math.sqrt(n)


def test_segmentations_of_documents(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "clash"), (None, "null id", "clash"), (99, "under▁score", "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    sampled = segmentation.sample_segmentations(frame, PIECES, k=3)
    out = sampled.collect()
    assert all(r.round_trip for r in out)
    texts = {i: t for i, t, _ in rows}
    decoded = segmentation.decode_ids(sampled, PIECES).collect()
    assert all(r.decoded == (texts[r.doc_id] or "").replace("▁", " ") for r in decoded)
    by_row = Counter((r.doc_id, tuple(r.ids)) for r in out)
    assert all(n == (2 if i == 4 else 1) for (i, _), n in by_row.items())
    assert [(r.sample, r.ids, r.log_prob, r.log_inclusion) for r in out if r.doc_id == 1] == [(1, [], 0.0, 0.0)]
    again = segmentation.sample_segmentations(frame.repartition(5), PIECES, k=3).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    assert segmentation.sample_segmentations(frame.limit(0), PIECES).collect() == []
    assert segmentation.decode_ids(sampled.limit(1).select(F.lit(None).cast("array<int>").alias("ids")), PIECES).first().decoded is None


def test_memory_of_counts_is_bounded(monkeypatch):
    """Texts with letters beyond Latin fill the words alone; the memory is emptied all the same."""
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 300)
    made, library_counts = token_counts.Counter(VOCABULARY), library()
    for i in range(8):
        texts = [" ".join(f"слово{i}x{j}x{k}" for k in range(20)) for j in range(10)]
        assert made.count(texts) == [len(library_counts.encode(t, add_special_tokens=False).ids) for t in texts]
        assert len(made.words) <= 300 + 200 * 8 and len(made.chunks) <= 300 + 200


def test_memory_of_lattices_is_bounded():
    """Many units, and few long ones with many edges each."""
    rng = random.Random(4)
    lattices = segmentation.Lattices(segmentation.Pieces(public_tokenizers.path("piece_bpe_32k.model")), segmentation.ALPHA)
    most = 0
    for size in (6, 400):
        for _ in range(20):
            words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=size)) for _ in range(60_000 // size)]
            segmentation.top_segmentations(lattices, [" ".join(words)], np.array([1], np.uint64), 2)
            most = max(most, sum(c.size * c.buffer.itemsize for c in lattices.columns))
            assert len(lattices.start) <= 150_000
    assert most < 90_000_000


def test_rows_of_one_id_are_spread_over_files(spark):
    frame = spark.createDataFrame([(None, f"text number {i}") for i in range(200)] + [(7, f"seven {i}") for i in range(100)],
                                  "doc_id long, text string")
    folder = shared_dir(spark, "test-null-ids")
    manifest = token_files.write_token_files(frame, VOCABULARY, folder, 2, file_rows=20)
    sizes = [r.documents for r in manifest.collect()]
    assert sum(sizes) == 300 and max(sizes) <= 60
    found = sorted(token_files.read_token_files(manifest, folder).collect(), key=lambda r: (r.file, r.place))
    starts = np.cumsum([0, *[r.n_tokens for r in found]])
    assert [r.start for r in found] == starts[:-1].tolist() and [r.doc_id for r in found] == [None] * 200 + [7] * 100


def test_reading_files_joins_nothing(spark):
    frame, _ = documents(spark)
    plan = token_files.token_file_index(frame, VOCABULARY, 2, file_rows=5)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_variates_are_drawn_for_many_texts_at_once(monkeypatch):
    """Samples cost a number of array steps that does not grow with the number of texts."""
    lattices, calls, real = segmentation.Lattices(segmentation.Pieces(PIECES), 0.5), [], segmentation.uniform

    def counted(seeds):
        calls.append(len(seeds))
        return real(seeds)

    monkeypatch.setattr(segmentation, "uniform", counted)
    steps = []
    for n in (10, 200):
        calls.clear()
        segmentation.top_segmentations(lattices, ["the same text over and over"] * n, np.arange(n).astype(np.uint64), 2)
        steps.append(len(calls))
    assert steps[1] < 2 * steps[0]


def test_units_and_decoding_of_plain_texts():
    draw = random.Random(3)
    pieces = segmentation.Pieces(PIECES)
    texts = ["".join(draw.choice("ab Zé_9½²ª\n\t.,\x85\xa0ǅɏ▁") for _ in range(draw.randint(1, 40))) for _ in range(3000)]
    shown = [segmentation.BLANK + t.replace(" ", segmentation.BLANK) for t in texts]
    assert [segmentation.FINE_PLAIN_UNITS(t) for t in shown] == [segmentation.FINE_UNITS(t) for t in shown]
    assert all("".join(pieces.split(t)) == s for t, s in zip(texts, shown, strict=True))
    many = [np.array([draw.randrange(len(pieces.text)) for _ in range(draw.randint(0, 30))], np.int32) for _ in range(500)]
    assert list(pieces.decode_many(many)) == [pieces.decode(ids.tolist()) for ids in many]
    assert list(pieces.decode_many([])) == []


def test_words_are_encoded_together_without_special_strings(monkeypatch):
    """Ids of many pre-tokens come from one plain text, and cut at the ids that close a word they are those of each by itself."""
    draw = random.Random(8)
    words = ["'s", "'ll", "7", "!!!", "</", "w", "é", "ǆ", *{"".join(draw.choice("abetinosré") for _ in range(draw.randint(1, 12))) for _ in range(2500)}]
    encoder, shown = token_files.Encoder(VOCABULARY), []
    real = encoder.ids
    monkeypatch.setattr(encoder, "ids", lambda text: shown.append(text) or real(text))
    found = encoder.words_ids(words)
    assert len(shown) == -(-len(words) // 1_000) and not any(s in text for text in shown for s in encoder.specials)
    assert found == [real(w) for w in words]
    assert encoder.words_ids([]) == []


def test_encoding_leaves_the_collector_as_it_was():
    encoder = token_files.Encoder(VOCABULARY)
    for set_to in (gc.disable, gc.enable):
        set_to()
        before = gc.isenabled()
        assert encoder.encode(["a b", None]) and gc.isenabled() == before
