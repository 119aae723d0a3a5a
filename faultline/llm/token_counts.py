"""Token counts of texts by rank-synchronous merging of arrays.

All new pre-tokens of a batch are laid end to end in one array of symbols.  In each round every pre-token finds the rank
of its best adjacent pair (one segmented minimum), all occurrences of these pairs are merged at once (in a run
of one symbol every second one, from the left), and pre-tokens without a known pair leave with the number of symbols
left.  A pre-token needs as many rounds as it has different merges, so a batch ends after a few dozen whatever its size.
Counts of blank-separated chunks are remembered in a bounded cache.

Defined results: a null text counts as empty, 0 bytes and 0 tokens; special strings count as their one token; texts are
taken whole; rows stay as they are, repeated or not.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_words import PRE_TOKENS, byte_letters, is_plain
from .common import held, text_pieces

PIECE_CHARS, CACHE_WORDS, MERGE_WORDS = 2_000_000, 400_000, 50_000
NO_PAIR = np.iinfo(np.int64).max


class MergeTable:
    """Vocabulary ids of bytes and the merges as sorted pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, merges, ending = spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        letters = byte_letters()
        self.inner = np.array([vocabulary[c] for c in letters], np.int64)
        self.final = np.array([vocabulary[c + ending] for c in letters], np.int64)
        self.base = len(vocabulary)
        pairs = np.array([vocabulary[a] * self.base + vocabulary[b] for a, b in merges], np.int64)
        merged = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks, self.merged = pairs[order], order.astype(np.int64), merged[order]

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NO_PAIR if there is none) and merged symbol of each pair."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NO_PAIR), self.merged[at]

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each (non-empty) word."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        flat = self.inner[symbols]
        flat[ends - 1] = self.final[symbols[ends - 1]]
        out, owner = np.ones(len(words), np.int64), np.arange(len(words))
        while len(flat):
            starts = np.cumsum(sizes) - sizes
            word = np.repeat(np.arange(len(sizes)), sizes)
            ranks, merged = np.full(len(flat), NO_PAIR), np.zeros(len(flat), np.int64)
            inside = np.flatnonzero(word[:-1] == word[1:])
            ranks[inside], merged[inside] = self.find(flat[inside], flat[inside + 1])
            least = np.minimum.reduceat(ranks, starts)
            done = least == NO_PAIR
            out[owner[done]] = sizes[done]
            taken = (ranks == least[word]) & (ranks != NO_PAIR)
            taken = every_second(taken)
            flat = np.where(taken, merged, flat)
            keep = ~np.r_[False, taken[:-1]] & ~done[word]
            sizes = np.bincount(word[keep], minlength=len(sizes))[~done]
            flat, owner = flat[keep], owner[~done]
        return out


def every_second(taken: np.ndarray) -> np.ndarray:
    """Of each run of neighbouring marks the first, third and so on: pairs must not overlap."""
    at = np.arange(len(taken))
    run_start = np.maximum.accumulate(np.where(taken & ~np.r_[False, taken[:-1]], at, 0))
    return taken & ((at - run_start) % 2 == 0)


class Counter:
    """Counts tokens of texts with the files of one vocabulary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.table = MergeTable(path)
        self.library = Tokenizer.from_file(path)
        self.words: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    def count(self, texts: list[str | None]) -> list[int]:
        chunked: list[list[str] | None] = []
        odd: dict[int, list[str]] = {}
        out = [0] * len(texts)
        for i, text in enumerate(texts):
            if not text:
                chunked.append(None)
            elif is_plain(text, self.table.specials):
                chunked.append(text.split())
            else:
                chunked.append(None)
                odd[i], out[i] = self.split_odd(text)
        # Texts that are not plain fill the words alone.
        if max(len(self.chunks), len(self.words)) > CACHE_WORDS:
            self.chunks.clear()
            self.words.clear()
        fresh = set().union(*(c for c in chunked if c)).difference(self.chunks)
        parts = {c: PRE_TOKENS(c.lower()) for c in fresh}
        self.learn({p for ps in (*parts.values(), *odd.values()) for p in ps})
        count = self.words.__getitem__
        for chunk, ps in parts.items():
            self.chunks[chunk] = sum(map(count, ps))
        known = self.chunks.__getitem__
        for i, chunks in enumerate(chunked):
            if chunks:
                out[i] = sum(map(known, chunks))
        for i, ps in odd.items():
            out[i] += sum(map(count, ps))
        return out

    def split_odd(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens by the library, and the special strings found."""
        pieces, specials = [text], 0
        for special in self.table.specials:
            cut = [part.split(special) for part in pieces]
            specials += sum(len(c) - 1 for c in cut)
            pieces = [p for c in cut for p in c]
        letters = {c: b for b, c in enumerate(byte_letters())}
        out = []
        for piece in pieces:
            shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece)) if piece else []
            out += [bytes(letters[c] for c in s).decode("utf-8") for s, _ in shown]
        return out, specials

    def learn(self, words: set[str]) -> None:
        fresh = sorted(w for w in words if w and w not in self.words)
        for start in range(0, len(fresh), MERGE_WORDS):
            part = fresh[start:start + MERGE_WORDS]
            self.words.update(zip(part, self.table.counts([w.encode() for w in part]).tolist(), strict=True))


def counter(path: str) -> Counter:
    return held(("token_counts", path), lambda: Counter(path))


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 2_048) -> DataFrame:
    """``docs`` without the text plus n_bytes, n_tokens and over_limit (columns of these names are replaced)."""
    rest = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    docs = docs.select(*rest, text)
    schema = docs.select(*rest, F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            tokens: list[int] = []
            for start, end in text_pieces(texts, PIECE_CHARS):
                tokens += counter(path).count(texts[start:end])
            sizes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in rest], pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())],
                names=[*rest, "n_bytes", "n_tokens"])

    return docs.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
