"""Language of texts by cross-parsing entropy.

Some labelled text of each language is held as a suffix automaton.  A text is cut greedily into phrases, each the
longest match found anywhere in the language's text; with ``c`` phrases over ``n`` characters, ``c * log2(length) / n``
estimates the bits a character costs for a reader of that language (Ziv and Merhav), and the language that needs fewest
wins.  ``score`` is 1 - c / n of the winner: near 0 where hardly two characters in a row are known, near 1 in long phrases.

Training reads a bounded sample: of each language's labelled rows the ones with the least hash in each of
``SAMPLE_ROWS`` hash classes, each text's first ``SAMPLE_TEXT`` characters, up to ``SAMPLE_CHARS`` together.  Every
text to be judged is read whole, in segments of ``SEGMENT`` characters whose phrases are added up; segments of many texts
advance together, one table look-up a character and language.  Every letter of training is a symbol of its own; the
``DENSE`` most frequent have a column of the table, transitions by the others (scripts of many letters) are a sorted list.
A letter unseen in training is a phrase by itself.

Defined results: texts that are null or have no letter, and all texts if nothing was learned, are ``und`` with score 0; equal
costs go to the first language by name; rows are judged one by one, so repeated rows and ids get equal results.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_pieces

SAMPLE_ROWS, SAMPLE_TEXT, SAMPLE_CHARS, SEGMENT, PIECE_CHARS = 96, 6_000, 24_000, 1_024, 4_000_000
DENSE = 250
UNKNOWN_LANGUAGE = "und"
#: Symbols: padding, anything that is no letter, letters unseen in training; then the letters of training.
PAD, GAP, STRANGE, FIRST_LETTER = 0, 1, 2, 3


@dataclass(frozen=True)
class LanguageModel:
    names: list[str]
    letters: str
    #: step[state * dense + symbol]: next state, or ~next where a new phrase begins there.
    step: np.ndarray
    starts: np.ndarray
    bits: np.ndarray
    #: Symbols from ``dense`` on: sorted state * width + symbol, the next states, and of each language and symbol where else it leads.
    rare_keys: np.ndarray
    rare_next: np.ndarray
    rare_fresh: np.ndarray

    @property
    def dense(self) -> int:
        return FIRST_LETTER + min(len(self.letters), DENSE)

    @property
    def width(self) -> int:
        return FIRST_LETTER + len(self.letters)


def sampled_texts(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """(lang, text) in the order of the sample.  Only hashes are grouped over all rows; then the chosen texts are fetched."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.substring(F.col(text), 1, SAMPLE_TEXT).alias("text"),
        F.xxhash64(F.col(text)).alias("hash"),
    ).where(F.char_length("text") > 0)
    chosen = rows.groupBy("lang", F.pmod("hash", F.lit(SAMPLE_ROWS)).alias("class")).agg(F.min("hash").alias("hash"))
    # At most SAMPLE_ROWS rows a language.
    texts = rows.join(F.broadcast(chosen), ["lang", "hash"]).groupBy("lang", "hash").agg(F.min("text").alias("text"))
    return [(r["lang"], r["text"]) for r in sorted(texts.collect(), key=lambda r: (r["lang"], r["hash"]))]


def fit(samples: list[tuple[str, str]]) -> LanguageModel | None:
    """The automata of the languages, as one table of transitions."""
    joined: dict[str, list[str]] = {}
    for name, text in samples:
        joined.setdefault(name, []).append(text.lower())
    budgeted = {}
    for name, texts in joined.items():
        chars, taken = 0, []
        for text in texts:
            if taken and chars + len(text) > SAMPLE_CHARS:
                continue
            taken.append(text)
            chars += len(text)
        if any(c.isalpha() for text in taken for c in text):
            budgeted[name] = taken
    if not budgeted:
        return None
    names = sorted(budgeted)
    counts: dict[str, int] = {}
    for texts in budgeted.values():
        for text in texts:
            for c in text:
                if c.isalpha():
                    counts[c] = counts.get(c, 0) + 1
    ordered = sorted(counts, key=lambda c: (-counts[c], c))
    letters = "".join(sorted(ordered[:DENSE]) + sorted(ordered[DENSE:]))
    width, dense = FIRST_LETTER + len(letters), FIRST_LETTER + min(len(letters), DENSE)
    tables, starts, bits, keys, nexts, elsewhere, offset = [], [], [], [], [], [], 0
    for name in names:
        parts = [symbols_of(t, letters)[0] for t in budgeted[name]]
        table, start, rare, fresh = phrase_table([p for p in parts if len(p)], width, dense)
        starts.append(offset + start)
        tables.append(np.where(table >= 0, table + offset, table - offset))
        bits.append(math.log2(sum(map(len, parts)) + 1))
        keys.append((rare[:, 0] + offset) * width + rare[:, 1])
        nexts.append(rare[:, 2] + offset)
        elsewhere.append(fresh - offset)
        offset += len(table)
    keys, nexts = np.concatenate(keys), np.concatenate(nexts)
    order = np.argsort(keys)
    return LanguageModel(
        names, letters, np.concatenate(tables).astype(np.int32).ravel(), np.array(starts, np.int32), np.array(bits),
        keys[order], nexts[order].astype(np.int32), np.stack(elsewhere).astype(np.int32))


def phrase_table(parts: list[np.ndarray], width: int, dense: int) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """Transitions of the suffix automaton of all parts, completed so that every symbol leads somewhere.

    A missing transition starts a new phrase from the root; a symbol that the root lacks is a phrase of its own.  After
    it, as before a text, stands the state added last (also returned), where any symbol starts a phrase.  Symbols from
    ``dense`` on are no columns: of them come the transitions (state, symbol, next) and where a missing one leads.
    """
    edges: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    for part in parts:
        last = 0
        for symbol in part.tolist():
            last = extend(edges, link, length, last, symbol)
    closed = len(edges)
    fresh = np.full(width, closed, np.int64)
    fresh[list(edges[0])] = list(edges[0].values())
    table = np.empty((closed + 1, dense), np.int64)
    table[:] = ~fresh[:dense]
    rare = []
    for state, out in enumerate(edges):
        for symbol, to in out.items():
            if symbol < dense:
                table[state, symbol] = to
            else:
                rare.append((state, symbol, to))
    table[:, PAD] = np.arange(closed + 1)
    return table, closed, np.array(rare, np.int64).reshape(-1, 3), ~fresh[dense:]


def extend(edges, link, length, last: int, symbol: int) -> int:
    """Adds one symbol to the (generalised) automaton and returns the state of the longest suffix."""
    if symbol in edges[last]:
        state = edges[last][symbol]
        if length[state] == length[last] + 1:
            return state
        return cloned(edges, link, length, last, symbol, state)
    state = len(edges)
    edges.append({})
    link.append(0)
    length.append(length[last] + 1)
    at = last
    while at >= 0 and symbol not in edges[at]:
        edges[at][symbol] = state
        at = link[at]
    if at >= 0:
        other = edges[at][symbol]
        link[state] = other if length[other] == length[at] + 1 else cloned(edges, link, length, at, symbol, other)
    return state


def cloned(edges, link, length, at: int, symbol: int, other: int) -> int:
    state = len(edges)
    edges.append(dict(edges[other]))
    link.append(link[other])
    length.append(length[at] + 1)
    link[other] = state
    while at >= 0 and edges[at].get(symbol) == other:
        edges[at][symbol] = state
        at = link[at]
    return state


def symbol_type(letters: str) -> type:
    return np.uint8 if FIRST_LETTER + len(letters) <= 256 else np.uint32


@functools.lru_cache(maxsize=2)
def symbol_table(letters: str) -> np.ndarray:
    """The symbol of each code point."""
    out = np.full(0x110000, GAP, symbol_type(letters))
    out[[i for i in range(0x110000) if chr(i).isalpha()]] = STRANGE
    for i, c in enumerate(letters):
        out[ord(c)] = FIRST_LETTER + i
    return out


def symbols_of(lowered: str, letters: str) -> tuple[np.ndarray, bool]:
    """Symbols with each run of non-letters as one gap, and whether there is a letter."""
    symbols = symbol_table(letters)[np.frombuffer(lowered.encode("utf-32-le", "replace"), np.uint32)]
    gap = symbols == GAP
    if len(symbols):
        symbols = symbols[~(gap & np.r_[False, gap[:-1]])]
    return symbols, not gap.all()


def judge(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    names, scores = [UNKNOWN_LANGUAGE] * len(texts), np.zeros(len(texts))
    parts, owners = [], []
    for i, text in enumerate(texts):
        symbols, lettered = symbols_of(text.lower(), model.letters) if text else (None, False)
        if lettered:
            parts.append(symbols)
            owners.append(i)
    if not parts:
        return names, scores
    sizes = np.array([len(p) for p in parts])
    lanes_of = -(-sizes // SEGMENT)
    first = np.r_[0, np.cumsum(lanes_of)[:-1]]
    grid = np.zeros((int(lanes_of.sum()), SEGMENT), symbol_type(model.letters))
    flat = grid.reshape(-1)
    for p, at in zip(parts, first * SEGMENT, strict=True):
        flat[at:at + len(p)] = p
    phrases = np.add.reduceat(cross_parse(model, grid), first, axis=0)
    costs = phrases * model.bits[None, :]
    best = costs.argmin(axis=1)
    for i, owner in enumerate(owners):
        names[owner] = model.names[best[i]]
    scores[owners] = np.clip(1 - phrases[np.arange(len(best)), best] / sizes, 0, 1)
    return names, scores


def cross_parse(model: LanguageModel, grid: np.ndarray) -> np.ndarray:
    """Phrases of each segment (row) in each language (column)."""
    dense, width = model.dense, model.width
    used = (grid != PAD).sum(axis=1)
    order = np.argsort(-used, kind="stable")
    columns = np.ascontiguousarray(grid[order].T)
    active = np.searchsorted(-used[order], -np.arange(grid.shape[1]), side="left")
    out = np.empty((len(grid), len(model.names)))
    for j, start in enumerate(model.starts):
        state = np.full(len(grid), start, np.int32)
        phrases = np.zeros(len(grid), np.int32)
        for t in range(int(used.max())):
            n = active[t]
            symbols = columns[t, :n]
            if width == dense:
                step = model.step[state[:n] * dense + symbols]
            else:
                step = model.step[state[:n] * dense + np.where(symbols < dense, symbols, STRANGE).astype(np.int32)]
                rare = np.flatnonzero(symbols >= dense)
                symbols = symbols[rare].astype(np.int64)
                keys = state[rare] * np.int64(width) + symbols
                at = np.minimum(np.searchsorted(model.rare_keys, keys), len(model.rare_keys) - 1)
                step[rare] = np.where(model.rare_keys[at] == keys, model.rare_next[at], model.rare_fresh[j, symbols - dense])
            new = step >> 31
            phrases[:n] -= new
            state[:n] = step ^ new
        out[order, j] = phrases
    return out


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score`` (columns of these names are replaced)."""
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN_LANGUAGE), "score": F.lit(0.0)})
    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE_CHARS a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for start, end in text_pieces(texts, PIECE_CHARS):
                names, scores = judge(shared.value, texts[start:end])
                piece = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=[*piece.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
