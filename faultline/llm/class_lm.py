"""Class-based bigram model by exchange clustering, and texts scored with it.

Every word of the training texts belongs to one of ``choices`` classes.  The ``head`` most frequent words start in classes by their rank
and are then exchanged: in each round half of them move to the class that gains most in the likelihood of the class bigrams, all by the
same statistics of the round before; a round that does not gain is undone.  Meanwhile all other words belong to one of ``rest`` classes
by their last two letters.  Then each of them, however rare, moves to the class that gains most by the same measure, all by the
statistics of the last round, and the class bigrams are counted anew.  The rest classes are left to words that training does not
hold.  The end of a text is a class of its own.  (A caller who gives ``clustered`` has only as many words clustered; the others then
stay in their rest classes.)  With ``N`` training tokens, ``V`` distinct ones and ``c`` of a word,

    p(word | previous) = weight * p(class | previous class) * (c + 0.5) / S(class) + (1 - weight) * (c + 0.5) / (N + 0.5 (V + 1))

where ``S`` sums ``c + 0.5`` over the class and 0.5 for a word not seen.  As both terms hold ``c + 0.5``, a text's score is
the sum of ``log10(c + 0.5)`` over its tokens, in which alone a word's count matters, plus a sum over pairs of classes.

Texts are cut into words twice, to count them and to write them as codes; all else reads codes.  Counts and pairs are taken over all
training texts.  Pairs are counted between head words and rest classes, at most ``(head + rest + 1)**2`` numbers whatever the input; so
are the rows that exchange reads, each holding one word's neighbours.  Of any other word the neighbours' classes are counted, at most
``2 (choices + rest + 1)`` numbers a word and piece of texts.  Only the ``frequent`` most frequent words' counts and classes are sent
to the workers; those of all other words, few of all occurrences, are joined by word.

Defined results: a null or empty text is its end alone; with nothing to learn from every count is 0 and every class equally
likely; rows are scored one by one, repeated or not; words are runs without ASCII blanks, A-Z in lower case.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settled

FREQUENT, HEAD, CLASSES, REST, ROUNDS, WEIGHT, ADDED = 1 << 18, 4_096, 64, 64, 8, 0.9, 0.1
COUNT_FLUSH, PIECE_CODES = 400_000, 1_000_000
SCORED = "n_tokens long, known long, pair_score double, count_score double"
# Gains are taken for so many (word, neighbour's class) at a time; steps up to SMALL are looked up.
GAIN_ENTRIES, SMALL = 20_000, 16


def words_of(text: str | None) -> list[bytes]:
    """Tokens but the end: bytes.lower and bytes.split know ASCII only, as the definition asks."""
    return text.encode().lower().split() if text else []


def rest_class(word: bytes, rest: int) -> int:
    return zlib.crc32(word.decode()[-2:].encode()) % rest


def rest_classes(words: pa.Array, rest: int) -> np.ndarray:
    """``rest_class`` of many words: few different endings are hashed."""
    ends = pc.utf8_slice_codeunits(words, -2).dictionary_encode()
    known = np.array([zlib.crc32(e.encode()) % rest for e in ends.dictionary.to_pylist()], np.int64)
    return known[ends.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)


def count_words(texts: DataFrame) -> DataFrame:
    """word, n over the column ``text``; summed in the map tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
                if len(counts) > COUNT_FLUSH:
                    yield counted(counts)
                    counts = Counter()
        yield counted(counts)

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def counted(counts: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())],
        names=["word", "n"])


def most_frequent(counts: DataFrame, limit: int) -> list[tuple[str, int]]:
    """At most ``limit`` words, all those above some count, in order of count.  No sort of the vocabulary: a histogram
    of counts (4,096 classes at most) gives the bound."""
    scale = F.floor(F.log2(F.col("n").cast("double")) * 64).cast("int")
    found, least = 0, None
    for row in sorted(counts.groupBy(scale.alias("s")).count().collect(), key=lambda r: -r["s"]):
        if found + row["count"] > limit:
            break
        found, least = found + row["count"], row["s"]
    if least is None:
        return []
    rows = counts.where(scale >= least).collect()
    return sorted(((r["word"], r["n"]) for r in rows), key=lambda r: (-r[1], r[0]))


def coded(rows: DataFrame, codes: dict[bytes, int]) -> DataFrame:
    """``rows`` with ``row``, ``codes`` and ``rare`` instead of the text, as a written table.

    A word's code is its place in ``codes``; beyond these, codes count the text's other words, which ``rare`` lists.
    """
    shared = rows.sparkSession.sparkContext.broadcast(codes)
    kept = [c for c in rows.columns if c != "text"]
    schema = T.StructType([*rows.select(*kept).schema, *T.StructType.fromDDL("codes binary, rare array<string>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, known = shared.value.get, len(shared.value)
        for batch in batches:
            out, rare = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                ids = np.fromiter(map(code, words, repeat(-1)), np.int32, len(words))
                others: dict[bytes, int] = {}
                for i in np.flatnonzero(ids < 0).tolist():
                    ids[i] = known + others.setdefault(words[i], len(others))
                out.append(ids.tobytes())
                rare.append([w.decode() for w in others])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(out, pa.binary()), pa.array(rare, pa.list_(pa.string()))],
                names=[*kept, "codes", "rare"])

    written = rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
    return settled(written, "coded-texts")


@dataclass(frozen=True)
class Sequence:
    """Coded texts one after another: an end, the first text, an end, and so on.

    Codes are the frequent words, then these texts' ``rare`` words, then the end.  ``starts`` are the places of the ends, one more than texts.
    """

    codes: np.ndarray
    starts: np.ndarray
    rare: pa.Array
    #: Of each listed rare word of the texts: its place in ``rare``; and where each text's list begins.
    listed: np.ndarray
    lists: np.ndarray


def sequences(batches: Iterator[pa.RecordBatch], known: int) -> Iterator[tuple[pa.RecordBatch, Sequence]]:
    """Batches in pieces of at most ``PIECE_CODES`` codes, or of one longer text."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("codes")).to_numpy(zero_copy_only=False).astype(np.int64) // 4)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, done + PIECE_CODES, "right")))
            piece = batch.slice(start, end - start)
            yield piece, sequence(piece, known)
            start = end


def sequence(batch: pa.RecordBatch, known: int) -> Sequence:
    column = batch.column("codes").cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) // 4 if len(column) else np.zeros(1, np.int64)
    lengths = np.diff(at)
    total = int(at[-1] - at[0])
    ids = np.frombuffer(column.buffers()[2], np.int32, total, int(at[0]) * 4).copy() if total else np.zeros(0, np.int32)
    rare = batch.column("rare").cast(pa.large_list(pa.string()))
    lists = rare.offsets.to_numpy()
    found = rare.flatten().dictionary_encode()
    listed = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lists = lists - lists[0]
    text = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    others = np.flatnonzero(ids >= known)
    ids[others] = known + listed[ids[others] - known + lists[:-1][text[others]]]
    codes = np.full(len(ids) + len(lengths) + 1, known + len(found.dictionary), np.int32)
    codes[np.arange(len(ids)) + text + 1] = ids
    return Sequence(codes, np.r_[0, np.cumsum(lengths + 1)], found.dictionary, listed, lists)


def count_pairs(rows: DataFrame, items: np.ndarray, size: int, rest: int) -> DataFrame:
    """a, b, n: neighbouring items, where an item is a head word, a rest class or (the last) the end of a text."""
    shared = rows.sparkSession.sparkContext.broadcast(items)  # of the frequent words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for _, s in sequences(batches, len(known)):
            ids = np.r_[known, size - 1 - rest + rest_classes(s.rare, rest), size - 1][s.codes]
            yield paired(ids[:-1] * size + ids[1:], size)

    return rows.select("codes", "rare").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def paired(keys: np.ndarray, size: int) -> pa.RecordBatch:
    pairs, n = np.unique(keys, return_counts=True)
    return pa.RecordBatch.from_arrays(
        [pa.array((pairs // size).astype(np.int32)), pa.array((pairs % size).astype(np.int32)), pa.array(n.astype(np.int64))],
        names=["a", "b", "n"])


def class_matrix(pairs: DataFrame, classes: np.ndarray, width: int) -> np.ndarray:
    """Counts of class pairs: summed in the map tasks, ``width**2`` numbers at most come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width)
        for batch in batches:
            a, b, n = (batch.column(c).to_numpy() for c in ("a", "b", "n"))
            total += np.bincount(classes[a] * width + classes[b], n, width * width)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    out = np.zeros(width * width)
    for row in pairs.mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[row["cell"]] = row["n"]
    return out.reshape(width, width)


def plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(matrix: np.ndarray) -> float:
    """What the classes' choice changes of the log likelihood of class bigrams with word emission."""
    return float(plogp(matrix).sum() - plogp(matrix.sum(0)).sum() - plogp(matrix.sum(1)).sum())


def best_class(matrix: np.ndarray, now: int, after: np.ndarray, before: np.ndarray, choices: int) -> int:
    """The class (of the first ``choices``) in which a word with these neighbours' class counts serves best."""
    n = after.sum()
    rest = matrix.copy()
    rest[now] = np.maximum(rest[now] - after, 0)
    rest[:, now] = np.maximum(rest[:, now] - before, 0)
    margins = rest.sum(1)[:choices], rest.sum(0)[:choices]
    ac, bc = np.flatnonzero(after), np.flatnonzero(before)
    rows, columns = rest[:choices][:, ac], rest[bc][:, :choices]
    gain = (plogp(rows + after[ac]) - plogp(rows)).sum(1) + (plogp(columns + before[bc][:, None]) - plogp(columns)).sum(0)
    for margin in margins:
        gain -= plogp(margin + n) - plogp(margin)
    return int(gain.argmax())


def exchange(pairs: DataFrame, clustered: int, choices: int, rest: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of every item, and the class pairs.  ``pairs`` is read from a table; each word's neighbours are one row."""
    width = choices + rest + 1
    classes = np.r_[np.arange(clustered) % choices, choices + np.arange(rest + 1)]
    matrix = class_matrix(pairs, classes, width)
    neighbours = settled(
        pairs.select(F.col("a").alias("w"), F.struct("b", "n").alias("r"), F.lit(None).alias("l"))
        .unionByName(pairs.select(F.col("b").alias("w"), F.lit(None).alias("r"), F.struct(F.col("a").alias("b"), "n").alias("l")))
        .where(F.col("w") < clustered).groupBy("w")
        .agg(F.collect_list("r").alias("r"), F.collect_list("l").alias("l"))
        .select("w", F.col("r.b").alias("after"), F.col("r.n").alias("after_n"), F.col("l.b").alias("before"),
                F.col("l.n").alias("before_n")),
        "neighbours",
    )
    for turn in range(rounds):
        moved = classes.copy()
        for w, c in neighbours.where(F.col("w") % 2 == turn % 2).mapInArrow(
                move_words(classes, matrix, choices, width), "w int, c int").collect():
            moved[w] = c
        gained = class_matrix(pairs, moved, width)
        if likelihood(gained) > likelihood(matrix):
            classes, matrix = moved, gained
    return classes, matrix


def move_words(classes: np.ndarray, matrix: np.ndarray, choices: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, to = batch.to_pylist(), []
            for row in rows:
                sides = [
                    np.bincount(classes[np.array(row[side], np.int64)], np.array(row[f"{side}_n"], float), width)
                    for side in ("after", "before")
                ]
                to.append(best_class(matrix, int(classes[row["w"]]), *sides, choices))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["w"] for r in rows], pa.int32()), pa.array(to, pa.int32())], names=["w", "c"])

    return run


def neighbour_classes(rows: DataFrame, top: list[str], head: int, cells: np.ndarray, width: int, rest: int) -> DataFrame:
    """word, cells: how often each class is next to a word beyond the first ``head``, one row a word and piece of texts.

    A number of ``cells`` is a count times ``2 width`` plus the class, which for the class before the word is moved by ``width``.
    """
    shared = rows.sparkSession.sparkContext.broadcast((pa.array(top, pa.string()), cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = shared.value
        for _, s in sequences(batches, len(known)):
            classes = np.r_[known, width - 1 - rest + rest_classes(s.rare, rest), width - 1][s.codes]
            at = np.flatnonzero((s.codes >= head) & (s.codes < s.codes[0]))
            base = s.codes[at].astype(np.int64) * (2 * width)
            keys, n = np.unique(np.r_[base + classes[at + 1], base + width + classes[at - 1]], return_counts=True)
            starts = np.flatnonzero(np.r_[True, np.diff(keys // (2 * width)) > 0]) if len(keys) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(
                pa.array(np.r_[starts, len(keys)], pa.int32()), pa.array(n * (2 * width) + keys % (2 * width), pa.int64()))
            named = pa.concat_arrays([words, s.rare]).take(pa.array(keys[starts] // (2 * width)))
            yield pa.RecordBatch.from_arrays([named, lists], names=["word", "cells"])

    return rows.select("codes", "rare").mapInArrow(run, "word string, cells array<long>")


def exchange_others(parts: DataFrame, matrix: np.ndarray, choices: int, rest: int) -> DataFrame:
    """word, n, c: the class that each word of ``neighbour_classes`` moves to from its rest class."""
    width = len(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A word's rows follow each other; those of a batch's last word may go on in the next one.
        left = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if left is None else [left, batch]).combine_chunks()
            words = table.column("word").combine_chunks()
            cut = table.num_rows - 1
            while cut > 0 and words[cut - 1] == words[cut]:
                cut -= 1
            yield from moved(table.slice(0, cut))
            left = table.slice(cut).combine_chunks().to_batches()[0] if table.num_rows else None
        if left is not None:
            yield from moved(pa.Table.from_batches([left]))

    def moved(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        words = table.column("word").combine_chunks().dictionary_encode()
        lists = table.column("cells").combine_chunks()
        packed = lists.flatten().to_numpy()
        word = np.repeat(words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy()))
        keys, place = np.unique(word * (2 * width) + packed % (2 * width), return_inverse=True)
        n = np.bincount(place, packed // (2 * width), len(keys))
        now = choices + rest_classes(words.dictionary, rest)
        word = keys // (2 * width)
        to, step = np.zeros(len(now), np.int64), np.zeros(0, np.int64)
        starts = np.flatnonzero(np.r_[True, np.diff(word) > 0])
        # Pieces of whole words, of about GAIN_ENTRIES entries.
        for piece in np.split(starts, np.flatnonzero(np.diff(starts // GAIN_ENTRIES)) + 1):
            end = np.searchsorted(word, word[piece[-1]], "right")
            step = slice(piece[0], end)
            first = word[piece[0]]
            to[first:word[piece[-1]] + 1] = best_classes(
                matrix, choices, now[first:word[piece[-1]] + 1], word[step] - first, keys[step] % (2 * width), n[step])
        after = keys % (2 * width) < width
        total = np.bincount(word[after], n[after], len(now)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [words.dictionary, pa.array(total), pa.array(to.astype(np.int32))], names=["word", "n", "c"])

    grouped = parts.repartition("word").sortWithinPartitions("word")
    return grouped.mapInArrow(run, "word string, n long, c int")


def best_classes(matrix: np.ndarray, choices: int, now: np.ndarray, word: np.ndarray, cell: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``best_class`` of many words that are in none of the ``choices`` yet.

    Entries (word, cell, n) are sorted by word, and every word has some: ``cell`` is the class after it, or ``width`` and the class before it.
    """
    width, count = len(matrix), len(now)
    sides = np.zeros((count, 2 * width))
    sides[word, cell] = n
    after, before = sides[:, :width], sides[:, width:]
    # Of each cell: how often it is next to each of the choices.
    beside = np.r_[matrix[:choices].T, matrix[:, :choices]]
    small = np.arange(SMALL + 1)[:, None, None]
    looked = plogp(beside + small) - plogp(beside)
    gain = np.empty((len(word), choices))
    few = n <= SMALL
    gain[few] = looked[n[few].astype(np.int64), cell[few]]
    many = beside[cell[~few]]
    gain[~few] = plogp(many + n[~few, None]) - plogp(many)
    # Where a neighbour is of the word's own class, the word's own pairs are taken out first.
    own = np.flatnonzero(cell % width == now[word])
    if len(own):
        others = np.where((cell[own] < width)[:, None], before[word[own], :choices], after[word[own], :choices])
        left = np.maximum(beside[cell[own]] - others, 0)
        gain[own] = plogp(left + n[own, None]) - plogp(left)
    total = np.add.reduceat(gain, np.flatnonzero(np.r_[True, np.diff(word) > 0]))
    size = after.sum(1, keepdims=True)
    for margin in (matrix.sum(1)[:choices] - before[:, :choices], matrix.sum(0)[:choices] - after[:, :choices]):
        total -= plogp(margin + size) - plogp(margin)
    return total.argmax(1)


@dataclass(frozen=True)
class ClassModel:
    """Everything the scoring tasks need; its size is set by the parameters alone."""

    codes: dict[bytes, int]
    #: Of each code (a frequent word, then the rest classes, then the end): class and log10(c + 0.5), 0 for a rest class.
    classes: np.ndarray
    logs: np.ndarray
    #: log10 of what multiplies c + 0.5, for each pair of classes.
    pair_logs: np.ndarray
    rest: int
    train_tokens: int
    distinct: int
    ends: int


def fit(texts: DataFrame, **options) -> tuple[ClassModel, DataFrame]:
    """The model of the column ``text``, and the table of all words' counts and classes (word, n, c)."""
    model, counts, _ = _fit(texts.select("text", F.lit(True).alias("learn")), **options)
    return model, counts


def _fit(
    texts: DataFrame, frequent: int = FREQUENT, clustered: int | None = None, choices: int = CLASSES, rest: int = REST,
    rounds: int = ROUNDS, weight: float = WEIGHT, head: int = HEAD,
) -> tuple[ClassModel, DataFrame, tuple[DataFrame, DataFrame]]:
    """The model of the texts to ``learn`` from, all words' counts and classes, and all texts as ``coded`` and ``looked_up``."""
    totals = settled(count_words(texts.where("learn")), "word-counts")
    sums = totals.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    top = most_frequent(totals, frequent)
    head = min(head if clustered is None else clustered, len(top))
    rows = coded(texts, {w.encode(): i for i, (w, _) in enumerate(top)})
    learned = rows.where("learn")
    suffixes = rest_classes(pa.array([w for w, _ in top], pa.string()), rest)
    items = np.r_[np.arange(head), head + suffixes[head:]].astype(np.int64)
    pairs = settled(count_pairs(learned, items, head + rest + 1, rest), "word-pairs")
    classes, matrix = exchange(pairs, head, choices, rest, rounds)
    width, ends = len(matrix), int(matrix[:, -1].sum())
    train, distinct = int(sums["n"]) + ends, int(sums["v"]) + (ends > 0)

    of_code = np.r_[classes[:head], choices + suffixes[head:]].astype(np.int64)
    if clustered is None:
        parts = neighbour_classes(learned, [w for w, _ in top], head, of_code, width, rest)
        others = exchange_others(parts, matrix, choices, rest)
    else:
        others = totals
        if head:
            # The head words are the first of a total order, so the last one's place separates the others in SQL.
            w, n = top[head - 1]
            others = totals.where((F.col("n") < n) | ((F.col("n") == n) & (F.col("word") > w)))
        others = others.select("word", "n", (choices + suffix_class(F.col("word"), rest)).cast("int").alias("c"))
    inner = texts.sparkSession.createDataFrame(
        [(w, n, int(classes[i])) for i, (w, n) in enumerate(top[:head])], "word string, n long, c int")
    counts = settled(others.unionByName(inner), "word-classes")

    codes = {w.encode(): i for i, (w, _) in enumerate(top)}
    if top:
        # All words down to this count are frequent ones.
        for row in counts.where(F.col("n") >= top[-1][1]).select("word", "c").collect():
            of_code[codes[row["word"].encode()]] = row["c"]
    looked = looked_up(rows, of_code, counts, width, rest)
    if clustered is None:
        matrix = pair_matrix(learned, looked, of_code, width)
    emitted = np.full(width, 0.5)
    for row in counts.groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        emitted[row["c"]] += row["n"] + 0.5 * row["v"]
    emitted[-1] += ends + 0.5 * (ends > 0)
    follow = (matrix + ADDED) / (matrix.sum(1, keepdims=True) + ADDED * width)
    pair_logs = np.log10(weight * follow / emitted[None, :] + (1 - weight) / (train + 0.5 * (distinct + 1)))
    logs = [math.log10(n + 0.5) for _, n in top]
    model = ClassModel(
        codes, np.r_[of_code, np.arange(choices, width)],
        np.array([*logs, *[0.0] * rest, math.log10(ends + 0.5)]), pair_logs, rest, train, distinct, ends)
    return model, counts, (rows, looked)


def suffix_class(word: Column, rest: int) -> Column:
    """``rest_class`` in SQL."""
    return F.crc32(F.right(word, F.lit(2)).cast("binary")) % F.lit(rest)


def looked_up(rows: DataFrame, of_code: np.ndarray, counts: DataFrame, width: int, rest: int) -> DataFrame:
    """row, learn, times, ns, pairs of the coded texts with rare words: how often each of these is there, its count in training, and
    the pairs of classes (first times ``width`` plus second) of neighbours that are not both frequent."""
    shared = rows.sparkSession.sparkContext.broadcast(of_code)
    schema = "row long, learn boolean, rare array<string>, times array<long>, near array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        known = len(classes)
        for batch, s in sequences(batches, known):
            rare = (s.codes >= known) & (s.codes < s.codes[0])
            some = np.flatnonzero(rare[:-1] | rare[1:])
            # A text's own places of its rare words.
            place = np.zeros(len(s.rare), np.int64)
            near, times, data = [], [], batch.column("codes")
            bounds = np.searchsorted(some, s.starts)
            known_class = np.r_[classes, np.zeros(len(s.rare), np.int64), width - 1][s.codes]
            for i in range(batch.num_rows):
                words = s.listed[s.lists[i]:s.lists[i + 1]]
                place[words] = np.arange(len(words))
                at = some[bounds[i]:bounds[i + 1]]
                both = np.r_[at, at + 1]
                own = known_class[both]
                own[rare[both]] = width + place[s.codes[both][rare[both]] - known]
                near.append(own.astype(np.int32))
                ids = np.frombuffer(data[i].as_buffer(), np.int32)
                times.append(np.bincount(ids[ids >= known] - known, minlength=len(words)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("learn"), batch.column("rare"), pa.array(times, pa.list_(pa.int64())),
                 pa.array(near, pa.list_(pa.int32()))], names=["row", "learn", "rare", "times", "near"])

    def run_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = []
            for i in range(batch.num_rows):
                near = batch.column("near")[i].values.to_numpy()
                of = batch.column("cs")[i].values.to_numpy()
                near = np.r_[np.arange(width), of][near].astype(np.int32)
                pairs.append(near[:len(near) // 2] * width + near[len(near) // 2:])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("row", "learn", "times", "ns")], pa.array(pairs, pa.list_(pa.int32()))],
                names=["row", "learn", "times", "ns", "pairs"])

    some = rows.where(F.size("rare") > 0).select("row", "learn", "codes", "rare")
    unseen = F.lit(width - 1 - rest) + suffix_class(F.col("word"), rest)
    words = (
        some.select("row", F.posexplode("rare").alias("pos", "word")).join(counts, "word", "left")
        .groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
            "pos", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("c", unseen).cast("int").alias("c")))).alias("w"))
        .select("row", F.col("w.n").alias("ns"), F.col("w.c").alias("cs")))
    near = some.mapInArrow(run, schema).drop("rare")
    joined = near.join(words, "row").select("row", "learn", "times", "near", "ns", "cs")
    return settled(
        joined.mapInArrow(run_pairs, "row long, learn boolean, times array<long>, ns array<long>, pairs array<int>"), "rare-pairs")


def pair_matrix(rows: DataFrame, looked: DataFrame, of_code: np.ndarray, width: int) -> np.ndarray:
    """Counts of class pairs over the coded texts and their looked-up pairs."""
    shared = rows.sparkSession.sparkContext.broadcast(of_code)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width)
        for _, s in sequences(batches, len(shared.value)):
            total += np.bincount(frequent_pairs(s, shared.value, width)[0], minlength=width * width)
        yield celled(total)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width)
        for batch in batches:
            total += np.bincount(batch.column("pairs").flatten().to_numpy(), minlength=width * width)
        yield celled(total)

    def celled(total: np.ndarray) -> pa.RecordBatch:
        cells = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    parts = rows.select("codes", "rare").mapInArrow(frequent, "cell long, n double").unionByName(
        looked.where("learn").select("pairs").mapInArrow(rare, "cell long, n double"))
    out = np.zeros(width * width)
    for row in parts.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[row["cell"]] = row["n"]
    return out.reshape(width, width)


def frequent_pairs(s: Sequence, of_code: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of classes of neighbours that are frequent words or ends, and their places."""
    known = len(of_code)
    classes = np.r_[of_code, np.full(len(s.rare), -1), width - 1][s.codes]
    at = np.flatnonzero((classes[:-1] >= 0) & (classes[1:] >= 0))
    return classes[at] * width + classes[at + 1], at


def score(docs: DataFrame, model: ClassModel, counts: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text plus n_tokens, n_known, train_tokens, base_score and score."""
    rows, kept = _shaped(docs, text, F.lit(False))
    rows = coded(rows, model.codes)
    looked = looked_up(rows, model.classes[:len(model.codes)], counts, len(model.pair_logs), model.rest)
    return _score(rows, looked, model, kept)


def _shaped(docs: DataFrame, text: str, learn: Column) -> tuple[DataFrame, list[str]]:
    """kept, text and learn, and the columns that ``kept`` holds."""
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rest = [c for c in docs.columns if c != text and c not in added]
    kept = F.struct(*rest) if rest else F.struct(F.lit(0).alias("none"))
    return docs.select(kept.alias("kept"), F.col(text).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn")), rest


def _score(rows: DataFrame, looked: DataFrame, model: ClassModel, kept: list[str]) -> DataFrame:
    parts = scored_parts(rows, model)
    times = F.arrays_zip("times", "ns")
    known = F.aggregate(times, F.lit(0).cast("long"), lambda a, x: a + F.when(x["ns"] > 0, x["times"]).otherwise(0))
    logs = F.aggregate(times, F.lit(0.0), lambda a, x: a + x["times"] * F.log10(x["ns"] + F.lit(0.5)))
    rare = scored_pairs(looked.select("row", known.alias("rare_known"), logs.alias("rare_score"), "pairs"), model)
    total = math.log10(model.train_tokens + 0.5 * (model.distinct + 1))
    logs = F.col("count_score") + F.coalesce("rare_score", F.lit(0.0))
    pair_score = F.col("pair_score") + F.coalesce("rare_pair_score", F.lit(0.0))
    return parts.join(rare, "row", "left").select(
        *[F.col("kept")[c].alias(c) for c in kept], "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(total)).alias("base_score"), (logs + pair_score).alias("score"),
    )


def scored_pairs(looked: DataFrame, model: ClassModel) -> DataFrame:
    """``looked`` with the pairs' part of the score instead of the pairs."""
    shared = looked.sparkSession.sparkContext.broadcast(model.pair_logs)
    kept = [c for c in looked.columns if c != "pairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value.ravel()
        for batch in batches:
            pairs = batch.column("pairs")
            sums = summed(logs[pairs.flatten().to_numpy()], pairs.offsets.to_numpy() - pairs.offsets[0].as_py())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sums)], names=[*kept, "rare_pair_score"])

    return looked.mapInArrow(run, T.StructType([*looked.select(*kept).schema, T.StructField("rare_pair_score", T.DoubleType())]))


def summed(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``values`` between ``bounds``."""
    run = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return np.bincount(run, values, len(bounds) - 1).astype(float)


def scored_parts(rows: DataFrame, model: ClassModel) -> DataFrame:
    """What a coded text's score owes to frequent words and their pairs."""
    shared = rows.sparkSession.sparkContext.broadcast((model.classes, model.logs, model.pair_logs, len(model.codes), model.ends))
    schema = T.StructType([*rows.select("kept", "row").schema, *T.StructType.fromDDL(SCORED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, logs, pair_logs, known, ends = shared.value
        width = len(pair_logs)
        for batch, s in sequences(batches, known):
            pairs, at = frequent_pairs(s, classes[:known], width)
            sizes = np.diff(s.starts)
            # The token at a place is the second of the pair there; the first end is none of any text.
            counted = np.r_[logs[:known], np.zeros(len(s.rare)), logs[-1]][s.codes[1:]]
            rare = (s.codes[1:] >= known) & (s.codes[1:] < s.codes[0])
            text = np.repeat(np.arange(len(sizes)), sizes)
            out = {
                "n_tokens": sizes, "known": sizes - np.bincount(text[rare], minlength=len(sizes)) - (ends == 0),
                "pair_score": np.bincount(text[at], pair_logs.ravel()[pairs], len(sizes)).astype(float),
                "count_score": np.bincount(text, counted, len(sizes)).astype(float),
            }
            yield pa.RecordBatch.from_arrays(
                [batch.column("kept"), batch.column("row"), *[pa.array(v) for v in out.values()]], names=["kept", "row", *out])

    return rows.select("kept", "row", "codes", "rare").mapInArrow(run, schema)


def score_texts(docs: DataFrame, learn: Column, text: str = "text", **options) -> DataFrame:
    """Fits on the rows for which ``learn`` holds and scores all."""
    rows, kept = _shaped(docs, text, learn)
    model, _, (rows, looked) = _fit(rows, **options)
    return _score(rows, looked, model, kept)
