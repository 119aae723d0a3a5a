"""Sampled segmentations of texts with the pieces of a SentencePiece model, without replacement, and decoding.

A text's lattice has a node between every two characters and an edge for every piece that spells the characters between
two nodes; a character without a piece is an edge of its bytes' pieces.  Pieces never cross from a letter into a blank, so the
lattice is a chain of units (blanks with a run of letters or of other characters; a line break), each of which is built
once and remembered.  A piece of rank r (BPE scores are negated ranks) has log probability ``-log(r + OFFSET)`` but for a constant; a
segmentation's weight is the product of its pieces' probabilities to the power ``alpha``.  Backward sums over the lattice
give every edge's probability given its node, so free sampling walks from node to node.

Gumbel top-k as perturbed A* search: the segmentations' Gumbel-perturbed log weights are never drawn one by one.  The
largest of all is Gumbel distributed and sits at a freely sampled path.  Given that, the segmentations that leave a path at one
of its nodes are a set of known weight whose largest value is again Gumbel distributed, cut off above by the path's.
The search keeps these sets, one a node of each path emitted so far, takes the one with the largest value, samples an edge
among its remaining ones and a free path from there, and splits the set at that path.  The first k paths taken are
exactly the k largest, all different.  With ``y = exp(-G)`` the cut-off variate is ``y = y_path + exponential / weight``.

``log_inclusion`` is log(1 - exp(-exp(log_prob - G))) with G the (k+1)-th largest value: the chance that a segmentation
of this probability is among the k, for weighting by its inverse.  All variates are hashes of the row key, the sample's
number and the place, so a row gets the same samples wherever and however often it is computed.

Defined results: null and empty texts have one segmentation, of no pieces, with log probability and log inclusion 0; a
text with fewer than k segmentations gets all, with log inclusion 0; rows with equal key and text get equal samples;
a null key counts as an empty one; U+2581 decodes to a blank, as in the library.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, mixed, text_pieces

SAMPLES, ALPHA, OFFSET, BYTE_COST, PIECE_CHARS, DECODED_IDS = 2, 0.2, 10.0, 4.0, 250_000, 1 << 18
#: What a worker remembers; long units have many edges, so both are bounded.
CACHE_UNITS, CACHE_EDGES = 120_000, 2_500_000
BLANK = "▁"
#: Units: blanks and what follows; or, where no piece goes from letters to others or back, blanks and a run of either.
COARSE_UNITS = re.compile(f"{BLANK}+[^{BLANK}\n]*|\n|[^{BLANK}\n]+").findall
LETTER = r"[^\W\d_²³¹]"
FINE_UNITS = re.compile(f"{BLANK}*{LETTER}+|{BLANK}*(?:[^\\w{BLANK}\n]|[\\d_²³¹])+|{BLANK}+|\n").findall
#: The same for texts of characters up to here, with the letters written out, which the matcher looks up in a bitmap.
LAST_PLAIN = 0x24F
_PLAIN = "".join(re.findall(LETTER, "".join(map(chr, range(LAST_PLAIN + 1)))))
FINE_PLAIN_UNITS = re.compile(f"{BLANK}*[{_PLAIN}]+|{BLANK}*[^{_PLAIN}{BLANK}\n]+|{BLANK}+|\n").findall
ODD = re.compile(f"[^\0-{chr(LAST_PLAIN)}]").search
CROSSING = re.compile(f"{LETTER}(?!{LETTER})[^{BLANK}]|(?!{LETTER})[^{BLANK}]{LETTER}").search
STEP, LAP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
#: Log weight from which on sets are drawn at once.  A variate is at least 2**-54, so one beyond has log y above 60.
HORIZON = -100.0
ADDED = "sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double, round_trip boolean"


def uniform(seeds: np.ndarray) -> np.ndarray:
    """In (0, 1), from the bits of the hashed seeds."""
    return ((mixed(mixed(seeds) + STEP) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


class Pieces:
    """The vocabulary: hashes of all beginnings of pieces, ids and log probabilities."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text: list[bytes] = [b""] * n
        self.byte_ids = np.zeros(256, np.int64)
        self.log_prob = np.zeros(n)
        spelled: dict[str, int] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.text[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                rank = -model.get_score(i)
                self.log_prob[i] = -math.log((rank if rank < n else n) + OFFSET)
                self.text[i] = piece.replace(BLANK, " ").encode()
                spelled[piece] = i
        coarse = any(map(CROSSING, spelled))
        self.units, self.plain_units = (COARSE_UNITS, COARSE_UNITS) if coarse else (FINE_UNITS, FINE_PLAIN_UNITS)
        self.byte_log_prob = -math.log(n + OFFSET) - BYTE_COST
        self.spelling = np.frombuffer(b"".join(self.text), np.uint8)
        self.sizes = np.fromiter(map(len, self.text), np.int64, n)
        self.starts = np.cumsum(self.sizes) - self.sizes
        values: dict[int, int] = {}
        for piece, i in spelled.items():
            key = np.uint64(0)
            for at, c in enumerate(piece):
                key = chained(np.array([key], np.uint64), np.array([ord(c)], np.uint64))[0]
                if at == len(piece) - 1:
                    values[int(key)] = i
                else:
                    values.setdefault(int(key), -1)
        ordered = sorted(values)
        # A last entry that no key passes, and where the keys with each beginning start: they are hashes, so a few steps find one.
        self.keys = np.array([*ordered, 2**64 - 1], np.uint64)
        self.ids = np.array([*[values[k] for k in ordered], values.get(2**64 - 1, -2)], np.int64)
        bits = max(1, len(ordered)).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.buckets = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def split(self, text: str) -> list[str]:
        """The units of a text."""
        if not text:
            return []
        return (self.units if ODD(text) else self.plain_units)(BLANK + text.replace(" ", BLANK))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a key begins some piece, and the piece it is (-1 if none)."""
        at = self.buckets[keys >> self.shift]
        low = np.flatnonzero(self.keys[at] < keys)
        while len(low):
            at[low] += 1
            low = low[self.keys[at[low]] < keys[low]]
        ids = self.ids[at]
        begun = (self.keys[at] == keys) & (ids >= -1)
        return begun, np.where(begun, ids, -1)

    def decode_many(self, many: list[np.ndarray]) -> Iterator[bytes]:
        """What each of many lists of ids decodes to, by gathering the bytes of all."""
        ids = np.concatenate(many) if many else np.zeros(0, np.int64)
        sizes = self.sizes[ids]
        parts = []
        for at in range(0, len(ids), DECODED_IDS):
            size = sizes[at:at + DECODED_IDS]
            ends = np.cumsum(size)
            places = np.repeat(self.starts[ids[at:at + DECODED_IDS]] - (ends - size), size)
            places += np.arange(len(places))
            parts.append(self.spelling[places].tobytes())
        content = b"".join(parts)
        bounds = np.r_[0, np.cumsum(sizes)][np.cumsum([0, *map(len, many)])].tolist()
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):
            yield content[start + content.startswith(b" ", start, end):end]

    def decode(self, ids: list[int]) -> bytes:
        out = b"".join(map(self.text.__getitem__, ids))
        return out[1:] if out.startswith(b" ") else out


def chained(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return mixed(keys * STEP + codes + LAP)


class Growing:
    """An array that grows at its end without being copied each time."""

    def __init__(self, kind):
        # Pages of zeros take no memory until they are written.
        self.buffer, self.size = np.zeros(1 << 22, kind), 0

    def add(self, new: np.ndarray) -> None:
        if self.size + len(new) > len(self.buffer):
            grown = np.zeros(3 * (self.size + len(new)) // 2, self.buffer.dtype)
            grown[:self.size] = self.buffer[:self.size]
            self.buffer = grown
        self.buffer[self.size:self.size + len(new)] = new
        self.size += len(new)

    def filled(self) -> np.ndarray:
        return self.buffer[:self.size]


class Lattices:
    """Nodes and edges of all remembered units.  The edges of a node are consecutive, long (and so likely) ones first."""

    def __init__(self, pieces: Pieces, alpha: float):
        self.pieces, self.alpha = pieces, alpha
        self.columns = [Growing(t) for t in (np.int64, np.int32, np.int32, np.float64, np.float64, np.bool_)]
        self.clear()

    def clear(self) -> None:
        self.start: dict[str, int] = {}
        for column in self.columns:
            column.size = 0
        self.columns[0].add(np.zeros(1, np.int64))
        self.first, self.to, self.piece, self.log_q, self.cum, self.closing = (c.filled() for c in self.columns)

    def nodes(self, units: list[str]) -> np.ndarray:
        return np.fromiter(map(self.start.__getitem__, units), np.int64, len(units))

    def learn(self, units: set[str]) -> None:
        fresh = list(units.difference(self.start))
        if not fresh:
            return
        codes = np.frombuffer("".join(fresh).encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
        starts = np.cumsum(sizes) - sizes
        unit = np.repeat(np.arange(len(fresh)), sizes)
        left = np.repeat(starts + sizes, sizes) - np.arange(len(codes))
        begin, length, piece = self.edges(codes, left)
        score = np.where(piece >= 0, self.pieces.log_prob[np.maximum(piece, 0)], 0.0)
        odd = np.flatnonzero(piece < 0)
        score[odd] = self.pieces.byte_log_prob * utf8_sizes(codes[begin[odd]])
        small = odd[codes[begin[odd]] < 128]
        piece[small] = self.pieces.byte_ids[codes[begin[small]].astype(np.int64)]
        score *= self.alpha
        # Runs of equal length are in order already, which the sort makes use of.
        source = begin + unit[begin]
        order = np.argsort(source, kind="stable")
        source, piece, score = source[order], piece[order], score[order]
        target = source + length[order]
        nodes = len(codes) + len(fresh)
        log_q = self.conditional(nodes, source, target, score, left[begin[order]])
        counts = np.bincount(source, minlength=nodes)
        firsts = np.cumsum(counts) - counts
        # Node by node, so that a unit's numbers do not depend on the units learned with it.
        cum = np.exp(log_q)
        for k in range(1, int(counts.max())):
            at = firsts[counts > k] + k
            cum[at] += cum[at - 1]
        cum[(firsts + counts - 1)[counts > 0]] = 2.0
        base, held = len(self.first) - 1, len(self.to)
        self.start.update(zip(fresh, (starts + np.arange(len(fresh)) + base).tolist(), strict=True))
        news = (np.r_[firsts[1:], len(target)] + held, target + base, piece, log_q, cum, counts[target] == 0)
        for column, new in zip(self.columns, news, strict=True):
            column.add(new)
        self.first, self.to, self.piece, self.log_q, self.cum, self.closing = (c.filled() for c in self.columns)

    def edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First character, length and piece of every edge; -1 - code point for a character without a piece."""
        out, at, length = [], np.arange(len(codes)), 1
        keys = np.zeros(len(codes), np.uint64)
        while len(at):
            keys = chained(keys, codes[at + length - 1])
            begun, piece = self.pieces.find(keys)
            if length == 1:
                piece = np.where(piece < 0, -1 - codes.astype(np.int64), piece)
                out.append((at, np.ones(len(at), np.int64), piece))
            else:
                whole = piece >= 0
                out.append((at[whole], np.full(int(whole.sum()), length), piece[whole]))
            go = begun & (left[at] > length)
            at, keys, length = at[go], keys[go], length + 1
        begin, lengths, piece = (np.concatenate(c) for c in zip(*reversed(out), strict=True))
        return begin, lengths, piece

    @staticmethod
    def conditional(nodes: int, source, target, score, left) -> np.ndarray:
        """Log probability of each edge given its node, by sums from the units' ends backwards.  ``source`` ascends."""
        beta, log_q = np.zeros(nodes), np.zeros(len(source))
        order = np.argsort(left.astype(np.uint16) if left.max(initial=0) < 1 << 16 else left, kind="stable")
        cuts = np.flatnonzero(np.diff(left[order])) + 1
        for part in np.split(order, cuts):
            value = score[part] + beta[target[part]]
            new = np.flatnonzero(np.r_[True, np.diff(source[part]) > 0])
            counts = np.diff(np.r_[new, len(part)])
            top = np.maximum.reduceat(value, new)
            total = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, counts)), new))
            beta[source[part][new]] = total
            log_q[part] = value - np.repeat(total, counts)
        return np.minimum(log_q, 0.0)

    def is_end(self, node: np.ndarray) -> np.ndarray:
        return self.first[node] == self.first[node + 1]

    def pick(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        edge = self.first[node]
        over = np.flatnonzero(u >= self.cum[edge])
        while len(over):
            edge[over] += 1
            over = over[u[over] >= self.cum[edge[over]]]
        return edge

    def walk(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Free paths from each node to its unit's end: edges in order, and how many each has."""
        state, active = nodes.copy(), np.flatnonzero(~self.is_end(nodes))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(active):
            edge = self.pick(state[active], uniform(seeds[active] + STEP * np.array([len(steps) + 1], np.uint64)))
            steps.append((active, edge))
            on = ~self.closing[edge]
            active, edge = active[on], edge[on]
            state[active] = self.to[edge]
        counts = np.zeros(len(nodes), np.int64)
        for who, _ in steps:
            counts[who] += 1
        offsets = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        for i, (who, edge) in enumerate(steps):
            out[offsets[who] + i] = edge
        return out, counts


def utf8_sizes(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)


@dataclass
class Path:
    """An emitted segmentation; ``log_y`` are the values of the sets that leave it at ``level`` or later."""

    edges: np.ndarray
    units: np.ndarray
    before: np.ndarray
    log_prob: float
    level: int
    log_y: np.ndarray
    value: float


@dataclass
class Search:
    """The A* search of one text."""

    key: np.uint64
    nodes: np.ndarray
    own: np.ndarray
    paths: list[Path] = field(default_factory=list)
    used: dict[tuple[int, int], list[int]] = field(default_factory=dict)

    def add(self, lattices: Lattices, edges, units, before, level: int, value: float) -> tuple[Search, int, int]:
        """A new path, which shares all edges before ``level`` with an earlier one; what ``open_sets`` is to draw of it."""
        log_prob = float(before[-1] + lattices.log_q[edges[-1]]) if len(edges) else 0.0
        self.paths.append(Path(edges, units, before, log_prob, level, np.zeros(0), value))
        return self, len(self.paths) - 1, level + int(np.count_nonzero(before[level:] >= HORIZON))

    def best(self, lattices: Lattices) -> tuple[float, int, int]:
        """Value, path and level of the best set; an infinite value if none is left.

        Sets beyond the horizon weigh so little that no variate brings them forward while a nearer one is left.
        """
        found = self.best_open()
        if math.isinf(found[0]):
            open_sets(lattices, [(self, p, len(path.edges)) for p, path in enumerate(self.paths)])
            found = self.best_open()
        return found

    def best_open(self) -> tuple[float, int, int]:
        found = (math.inf, 0, 0)
        for i, path in enumerate(self.paths):
            if len(path.log_y):
                at = int(path.log_y.argmin())
                found = min(found, (float(path.log_y[at]), i, path.level + at))
        return found

    def branch(self, lattices: Lattices, value: float, p: int, level: int, u: float, wait: float) -> int:
        """Takes an edge from the best set and leaves the rest of it with a new value, by two variates."""
        path = self.paths[p]
        edge = int(path.edges[level])
        used = self.used.setdefault((p, level), [edge])
        node = self.source(lattices, edge)
        free = [e for e in range(int(lattices.first[node]), int(lattices.first[node + 1])) if e not in used]
        weights = np.exp(lattices.log_q[free])
        chosen = min(int(np.searchsorted(np.cumsum(weights), u * weights.sum(), "right")), len(free) - 1)
        used.append(free[chosen])
        rest = float(weights.sum() - weights[chosen])
        rest_value = math.inf
        if len(free) > 1 and rest > 0:
            rest_value = float(np.logaddexp(value, math.log(-math.log(wait)) - float(path.before[level]) - math.log(rest)))
        path.log_y[level - path.level] = rest_value
        return free[chosen]

    @staticmethod
    def source(lattices: Lattices, edge: int) -> int:
        return int(np.searchsorted(lattices.first, edge, "right")) - 1


def draw(own: np.ndarray, places: np.ndarray, kind: int) -> np.ndarray:
    """Variates of texts by the seeds of a sample; ``kind`` keeps different uses apart."""
    return uniform(own + LAP * np.array([kind], np.uint64) + STEP * places.astype(np.uint64))


def open_sets(lattices: Lattices, asked: list[tuple[Search, int, int]]) -> None:
    """Draws the values of the sets that leave paths (of a search, by number) before their node, for many texts at once."""
    paths = [search.paths[p] for search, p, _ in asked]
    starts = [path.level + len(path.log_y) for path in paths]
    ends = [max(start, end) for start, (_, _, end) in zip(starts, asked, strict=True)]
    if starts == ends:
        return
    spans = list(zip(paths, starts, ends, strict=True))
    sizes = np.array(ends) - np.array(starts)
    bounds = np.cumsum(sizes)
    levels = np.arange(int(bounds[-1])) + np.repeat(np.array(starts) - (bounds - sizes), sizes)
    own = np.repeat(np.array([search.own[p] for search, p, _ in asked], np.uint64), sizes)
    edges = np.concatenate([path.edges[a:b] for path, a, b in spans])
    with np.errstate(divide="ignore", over="ignore"):
        weight = np.concatenate([path.before[a:b] for path, a, b in spans]) + np.log(-np.expm1(lattices.log_q[edges]))
        wait = np.log(-np.log(draw(own, levels, 1))) - weight
        log_y = np.logaddexp(np.repeat([path.value for path in paths], sizes), wait)
    for path, a, b in zip(paths, (bounds - sizes).tolist(), bounds.tolist(), strict=True):
        path.log_y = np.concatenate([path.log_y, log_y[a:b]]) if len(path.log_y) else log_y[a:b].copy()


def top_segmentations(lattices: Lattices, texts: list[str], keys: np.ndarray, k: int) -> list[tuple[list[Path], float]]:
    """For each text the k best perturbed segmentations in order, and the log y of the next (infinite if there is none)."""
    split = [lattices.pieces.split(t) for t in texts]
    if len(lattices.start) > CACHE_UNITS or len(lattices.to) > CACHE_EDGES:
        lattices.clear()
    lattices.learn(set().union(*split))
    own = mixed(keys[:, None] + STEP * np.arange(1, k + 1, dtype=np.uint64))
    searches = [Search(key, lattices.nodes(units), seeds) for key, units, seeds in zip(keys, split, own, strict=True)]
    values = draw(own[:, 0], np.zeros(len(own)), 3).tolist()
    opened = []
    for search, u, (edges, units) in zip(searches, values, walks(lattices, searches, [s.nodes for s in searches], 0), strict=True):
        log_q = lattices.log_q[edges]
        opened.append(search.add(lattices, edges, units, np.cumsum(log_q) - log_q, 0, math.log(-math.log(u))))
    open_sets(lattices, opened)
    for sample in range(1, k):
        bests = [(search, *search.best(lattices)) for search in searches]
        bests = [b for b in bests if not math.isinf(b[1])]
        seeds, levels = np.array([b[0].own[sample] for b in bests], np.uint64), np.array([b[3] for b in bests], np.int64)
        chosen, starts = [], []
        for (search, value, p, level), u, wait in zip(
                bests, draw(seeds, levels, 2).tolist(), draw(seeds, levels + 1, 2).tolist(), strict=True):
            edge = search.branch(lattices, value, p, level, u, wait)
            unit = int(search.paths[p].units[level])
            chosen.append((search, value, p, level, edge, unit))
            starts.append(np.concatenate([lattices.to[edge:edge + 1], search.nodes[unit + 1:]]))
        free = walks(lattices, [c[0] for c in chosen], starts, sample)
        opened = []
        for (search, value, p, level, edge, unit), (edges, units) in zip(chosen, free, strict=True):
            old = search.paths[p]
            edges = np.concatenate([old.edges[:level], [edge], edges])
            log_q = lattices.log_q[edges[level:]]
            before = np.concatenate([old.before[:level], old.before[level] + np.cumsum(log_q) - log_q])
            units = np.concatenate([old.units[:level], [unit], units + unit])
            opened.append(search.add(lattices, edges, units, before, level + 1, value))
        open_sets(lattices, opened)
    return [(s.paths, s.best(lattices)[0]) for s in searches]


def walks(lattices: Lattices, searches: list[Search], starts: list[np.ndarray], sample: int):
    """Free paths of many texts at once: for each, edges and the unit (counted from its first start) of every edge."""
    if not searches:
        return []
    sizes = np.array([len(s) for s in starts], np.int64)
    keys = np.repeat(np.array([s.key for s in searches], np.uint64), sizes)
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    seeds = mixed(mixed(keys + STEP * np.array([sample + 1], np.uint64)) + LAP * place.astype(np.uint64))
    edges, counts = lattices.walk(np.concatenate(starts).astype(np.int64), seeds)
    units = np.repeat(place, counts)
    ends = np.r_[0, np.cumsum(counts)][np.cumsum(sizes)]
    return zip(np.split(edges, ends[:-1]), np.split(units, ends[:-1]), strict=True)


def ids_of(lattices: Lattices, edges: np.ndarray) -> np.ndarray:
    """Piece ids; a character without a piece gives its bytes' ids."""
    pieces = lattices.piece[edges]
    if len(pieces) and pieces.min() < 0:
        byte_ids = lattices.pieces.byte_ids
        parts = [byte_ids[list(chr(-1 - p).encode())].tolist() if p < 0 else [p] for p in pieces.tolist()]
        pieces = np.array([i for part in parts for i in part], np.int64)
    return pieces.astype(np.int32)


def log_inclusion(log_prob: float, next_log_y: float) -> float:
    """log(1 - exp(-exp(log_prob + next_log_y)))."""
    x = log_prob + next_log_y
    if x < -30:
        return x
    return math.log(-math.expm1(-math.exp(min(x, 700.0))))


def lattices_of(path: str, alpha: float) -> Lattices:
    return held(("segmentation", path, alpha), lambda: Lattices(Pieces(path), alpha))


def sample_segmentations(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", k: int = SAMPLES,
                         alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """k rows for each document: ``docs`` without the text plus ADDED; ``round_trip`` tells that the ids decode to the text."""
    added = T.StructType.fromDDL(ADDED)
    rest = [c for c in docs.columns if c != text and c not in added.names]
    rows = docs.select(*rest, F.col(text).alias("_text"),
                       F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("_key"))
    schema = T.StructType([*[f for f in rows.schema if f.name in rest], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = lattices_of(path, alpha)
        for batch in batches:
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            keys = batch.column("_key").to_numpy().view(np.uint64)
            for start, end in text_pieces(texts, PIECE_CHARS):
                at: list[int] = []
                out: list[list] = [[] for _ in added]
                for i, (paths, following) in enumerate(top_segmentations(lattices, texts[start:end], keys[start:end], k)):
                    for number, one in enumerate(paths):
                        at.append(start + i)
                        row = (number + 1, ids_of(lattices, one.edges), one.log_prob, -one.value,
                               log_inclusion(one.log_prob, following))
                        for column, value in zip(out, row, strict=False):
                            column.append(value)
                wanted = [t.replace(BLANK, " ").encode() for t in texts[start:end]]
                out[5] = [decoded == wanted[i - start] for i, decoded in zip(at, lattices.pieces.decode_many(out[1]), strict=True)]
                yield sampled_batch(batch, rest, at, out, schema.names)

    return rows.mapInArrow(run, schema)


def sampled_batch(batch: pa.RecordBatch, rest: list[str], at: list[int], out: list[list], names: list[str]) -> pa.RecordBatch:
    where = pa.array(at, pa.int64())
    offsets = np.r_[0, np.cumsum([len(x) for x in out[1]])].astype(np.int32)
    flat = np.concatenate(out[1]) if out[1] else np.zeros(0, np.int32)
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
    return pa.RecordBatch.from_arrays(
        [*[batch.column(c).take(where) for c in rest], pa.array(out[0], pa.int32()), ids,
         *[pa.array(c, pa.float64()) for c in out[2:5]], pa.array(out[5], pa.bool_())],
        names=names)


def decode_ids(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` plus the text that the ids spell (null for null ids)."""
    rest = [c for c in rows.columns if c != out]
    schema = T.StructType([*[f for f in rows.select(*rest).schema], T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattices_of(path, ALPHA).pieces
        for batch in batches:
            texts = [None if x is None else pieces.decode(x).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(texts, pa.string())], names=schema.names)

    return rows.select(*rest).mapInArrow(run, schema)
