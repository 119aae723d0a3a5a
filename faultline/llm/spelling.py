"""Spelling variants: words one edit apart, found by PartEnum signatures of their letter multisets.

Method.  One inserted, deleted or replaced code point changes a word's multiset of letters, taken as a binary vector with one
dimension for each copy of a letter, by a Hamming distance of one or two.  The letters are partitioned into ``PARTS`` parts
of about equal information (greedily, by the entropy of their numbers in the words).  Two words of equal length
at distance two agree outside at most two parts, two words whose lengths differ by one agree outside one part: so the hashes of the letters
outside each pair of parts (equal lengths) and outside each part (lengths one apart) are exact signatures.  Words are
equi-joined on them by a shuffle, and pairs within a signature are verified code point by code point, in the task
that holds the signature; only verified pairs leave it.  A signature with more than ``HALVES_FROM`` words is first cut by the words' first
and second halves, of which an edit leaves one as it was; no pair is lost by that.

Bounds.  Texts become counts of words in the map tasks, so a word's share of the corpus costs nothing; all later steps grow with
the vocabulary.  A task holds the words of one signature and 2^20 pairs at a time.  The driver holds the histogram of
at most 256 letters.

Defined results.  A null text has no runs, a null ``doc_id`` counts as empty text in the hash, repeated rows count as
often as they occur, ties between near words of equal count go to the smaller in code-point order, an empty table gives
an empty result, other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, settled

#: Fixed values of the task: a run of letters, every 31st hash loses a code point.
LETTERS = r"[A-Za-zÀ-ÿ]"
DELETE_EVERY = 31

PARTS = 6
HALVES_FROM = 4096
PAIRS_AT_ONCE = 1 << 20
MOST_COPIES = 8

EQUAL, SHORT, LONG = 0, 1, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def noisy_word(doc_id: Column, run: Column) -> Column:
    """The run, without its code point h % length where 31 divides h, the CRC-32 of ``<doc_id>:<run>``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.char_length(run)))
    return F.when(h % DELETE_EVERY == 0, cut).otherwise(run)


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 7,
                least_count: int = 2) -> DataFrame:
    """word, n: the words of all texts with at least ``least_length`` code points and ``least_count`` occurrences."""
    found = F.regexp_extract_all(F.col("_text"), F.lit(f"({LETTERS}{{{least_length},}})"), F.lit(1))
    runs = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).select("_id", F.explode(found).alias("_run"))
    lower = F.when(F.col("_run").rlike("[A-Z]"), F.translate("_run", UPPER, LOWER)).otherwise(F.col("_run"))
    words = runs.select("_id", lower.alias("_run")).select(noisy_word(F.col("_id"), F.col("_run")).alias("word"))
    counts = words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least_count)


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The code points of all words end to end, the bounds of each word, and the words, one byte a code point."""
    coded = [w.encode("latin-1") for w in words.to_pylist()]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    return np.frombuffer(b"".join(coded), np.uint8), np.r_[0, np.cumsum(sizes)], coded


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((256, MOST_COPIES + 1), np.int64)
    for batch in batches:
        flat, bounds, _ = _letters(batch.column(0))
        rows = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        cells, copies = np.unique(rows * 256 + flat, return_counts=True)
        np.add.at(total, (cells % 256, np.minimum(copies, MOST_COPIES)), 1)
    letter, copies = np.nonzero(total)
    if len(letter):
        yield pa.RecordBatch.from_arrays(
            [pa.array(letter, pa.int32()), pa.array(copies, pa.int32()), pa.array(total[letter, copies])],
            names=["letter", "copies", "words"])


def letter_parts(words: DataFrame, parts: int = PARTS) -> np.ndarray:
    """The part of each of the 256 letters: heaviest entropy first, always into the lightest part."""
    found = words.select("word").mapInArrow(_histograms, "letter int, copies int, words long")
    rows = found.groupBy("letter", "copies").agg(F.sum("words").alias("words")).collect()
    size = words.count()
    weight = np.zeros(256)
    for letter in {r.letter for r in rows}:
        seen = np.array([r.words for r in rows if r.letter == letter], np.float64)
        shares = np.r_[seen, size - seen.sum()] / max(size, 1)
        shares = shares[shares > 0]
        weight[letter] = -(shares * np.log2(shares)).sum()
    part, load = np.zeros(256, np.int64), np.zeros(parts)
    for letter in np.argsort(-weight, kind="stable"):
        part[letter] = load.argmin()
        load[part[letter]] += weight[letter]
    return part


def _signatures(part: np.ndarray, parts: int):
    """Rows (signature, role, word, n) for each signature of each word."""
    left_out = list(itertools.combinations(range(parts), 2))
    numbers = mixed(np.arange(1, len(left_out) + parts + 1, dtype=np.uint64))
    letter_hash = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 20_000):
                piece = batch.slice(start, 20_000)
                flat, bounds, _ = _letters(piece.column(0))
                sizes = np.diff(bounds).astype(np.uint64)
                sums, letters = np.zeros((parts, len(sizes)), np.uint64), np.zeros((parts, len(sizes)), bool)
                for p in range(parts):
                    inside = part[flat] == p
                    sums[p] = np.add.reduceat(np.where(inside, letter_hash[flat], np.uint64(0)), bounds[:-1])
                    letters[p] = np.logical_or.reduceat(inside, bounds[:-1])
                whole = sums.sum(axis=0, dtype=np.uint64)
                out = []
                for no, (p, q) in enumerate(left_out):
                    # A replaced letter is in one of the two parts, so a word without letters there has no partner.
                    out.append((EQUAL, no, whole - sums[p] - sums[q], sizes, letters[p] | letters[q]))
                for p in range(parts):
                    out.append((SHORT, len(left_out) + p, whole - sums[p], sizes + np.uint64(1), np.ones(len(sizes), bool)))
                    out.append((LONG, len(left_out) + p, whole - sums[p], sizes, letters[p]))
                rows = [np.flatnonzero(has) for *_, has in out]
                codes = [
                    mixed(mixed(rest + numbers[no]) + length)[at]
                    for (_, no, rest, length, _), at in zip(out, rows, strict=True)
                ]
                roles = [np.full(len(at), role, np.int8) for (role, *_), at in zip(out, rows, strict=True)]
                taken = piece.take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(codes).view(np.int64)), pa.array(np.concatenate(roles)), *taken.columns],
                    names=["signature", "role", "word", "n"])

    return run


def _pairs(first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i with the ``count[i]`` rows from ``first[i]`` on, about PAIRS_AT_ONCE pairs at a time."""
    ends = np.cumsum(count)
    total, done, row = int(ends[-1]) if len(ends) else 0, 0, 0
    while done < total:
        # Whole rows as long as they fit, and parts of a row that alone is more.
        stop = min(done + PAIRS_AT_ONCE, total)
        last = int(np.searchsorted(ends, stop, "left"))
        rows = np.arange(row, last + 1)
        starts = np.maximum(ends[rows] - count[rows], done)
        sizes = np.minimum(ends[rows], stop) - starts
        left = np.repeat(rows, sizes)
        inside = np.arange(done, stop) - np.repeat(ends[rows] - count[rows], sizes)
        yield left, first[left] + inside
        done = stop
        row = last + (1 if ends[last] == stop else 0)


def _padded(words: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), width)


def _replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def _inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether the first words are the second ones without one code point: common start and common end cover them."""
    width = short.shape[1]
    start = np.where(short != long[:, :-1], np.arange(width), width).min(axis=1, initial=width)
    end = np.where(short != long[:, 1:], np.arange(width - 1, -1, -1), width).min(axis=1, initial=width)
    return start + end >= width


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal keys, one more than runs."""
    change = np.zeros(len(keys[0]), bool)
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    if len(change):
        change[0] = True
    return np.r_[np.flatnonzero(change), len(change)]


def _matched(kind: int, words: list[bytes], left: tuple[np.ndarray, np.ndarray],
             right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of row numbers within groups: ``left`` and ``right`` are row and group numbers, sorted by group."""
    rows_a, group_a = left
    rows_b, group_b = right
    if not len(rows_a) or not len(rows_b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = _padded([words[i] for i in rows_a], len(words[rows_a[0]]))
    b = a if kind == EQUAL else _padded([words[i] for i in rows_b], len(words[rows_b[0]]))
    ends = np.searchsorted(group_b, group_a, "right")
    first = np.arange(1, len(rows_a) + 1) if kind == EQUAL else np.searchsorted(group_b, group_a, "left")
    found_a, found_b = [], []
    for i, j in _pairs(first, ends - first):
        ok = (_replaced if kind == EQUAL else _inserted)(a[i], b[j])
        found_a.append(rows_a[i[ok]])
        found_b.append(rows_b[j[ok]])
    return np.concatenate(found_a or [rows_a[:0]]), np.concatenate(found_b or [rows_b[:0]])


def _halved(words: list[bytes], rows: np.ndarray, length: int, second: bool) -> list[bytes]:
    """The half of each word that an edit in the other half leaves: ``length`` is that of the longer words."""
    half = int(length) // 2
    return [words[i][len(words[i]) - (int(length) - half):] if second else words[i][:half] for i in rows]


def _group_numbers(*halves: list[bytes]) -> list[np.ndarray]:
    numbers: dict[bytes, int] = {}
    return [np.fromiter((numbers.setdefault(h, len(numbers)) for h in part), np.int64, len(part)) for part in halves]


def verified_pairs(signature: np.ndarray, role: np.ndarray, words: list[bytes],
                   halves_from: int = HALVES_FROM) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the near words within equal signatures; the rows come sorted by signature."""
    length = np.fromiter(map(len, words), np.int64, len(words)) + (role == SHORT)
    out = []
    bounds = _runs(signature)
    group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    big = np.diff(bounds)[group] > halves_from
    for kind in (EQUAL, SHORT):
        other = EQUAL if kind == EQUAL else LONG
        for width in np.unique(length[role == kind]):
            here = length == width
            sides = [np.flatnonzero(here & (role == r) & ~big) for r in (kind, other)]
            out.append(_matched(kind, words, *((rows, group[rows]) for rows in sides)))
            sides = [np.flatnonzero(here & (role == r) & big) for r in (kind, other)]
            for second in (False, True):
                numbers = _group_numbers(*([s + group[i].tobytes() for s, i in zip(_halved(words, rows, width, second), rows)]
                                           for rows in sides))
                dealt = []
                for rows, number in zip(sides, numbers, strict=True):
                    order = np.argsort(number, kind="stable")
                    dealt.append((rows[order], number[order]))
                out.append(_matched(kind, words, *dealt))
    a, b = (np.concatenate([pair[side] for pair in out] or [np.zeros(0, np.int64)]) for side in (0, 1))
    return a, b


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of each near pair (word, near, n) of rows sorted by signature; a signature may span batches."""

    def judged(table: pa.Table) -> pa.RecordBatch:
        words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
        a, b = verified_pairs(table.column("signature").to_numpy(), table.column("role").to_numpy(), words)
        texts, n = table.column("word").combine_chunks(), table.column("n").to_numpy()
        both, other = np.r_[a, b], np.r_[b, a]
        return pa.RecordBatch.from_arrays(
            [texts.take(pa.array(both)).cast(pa.string()), texts.take(pa.array(other)).cast(pa.string()), pa.array(n[other])],
            names=["word", "near", "near_n"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        codes = batch.column(0).to_numpy()
        # All but the last signature of the batch is complete.
        cut = int(np.searchsorted(codes, codes[-1], "left"))
        if cut:
            yield judged(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
            held = [batch.slice(cut)]
    if held:
        yield judged(pa.Table.from_batches(held))


def near_words(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """word, near, near_n: each near pair of ``words`` (word, n) in both directions, once."""
    part = letter_parts(words, parts)
    rows = words.select("word", "n").mapInArrow(_signatures(part, parts), "signature long, role byte, word string, n long")
    sorted_rows = rows.repartition("signature").sortWithinPartitions("signature")
    pairs = sorted_rows.mapInArrow(_verify, "word string, near string, near_n long")
    return pairs.groupBy("word", "near").agg(F.first("near_n").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following ``forms`` (word, form) ends.  Each round doubles the steps; a form is at least ``factor``
    times as frequent as its word, so a chain has a few steps and there is no cycle."""
    reached = settled(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = settled(
            reached.join(further, "root", "left").select(
                "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")),
            "spelling-roots")
        reached = after.select("word", "root")
        if after.where("_moved").isEmpty():
            return reached


def variant_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 7, least_count: int = 2,
                   factor: int = 10, parts: int = PARTS) -> DataFrame:
    """word, n, n_near, form, form_n, root for each word of the corpus.

    ``form`` is the most frequent near word, if it is at least ``factor`` times as frequent as the word.
    """
    words = settled(word_counts(docs, doc_id, text, least_length, least_count), "spelling-words")
    best = near_words(words, parts).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("_best"))
    is_form = -F.col("_best.m") >= factor * F.col("n")
    judged = settled(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("_best.near")).alias("form"),
        F.when(is_form, -F.col("_best.m")).alias("form_n")), "spelling-forms")
    ends = roots(judged.where("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
