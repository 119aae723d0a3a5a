"""Exact nearest-neighbour join in two phases over a written index.

The index deals the incidents of a group to the cells of their nearest pivots, orders a cell by the distance to its pivot
(a segmented scan, so a cell may hold any share of all incidents) and cuts it into blocks of bounded size.  Its tables are the rows, the
blocks' and the groups' statistics; they are joined, not collected, so the number of groups is not bounded by the driver, which holds the pivots only.

A probe first searches its own cell (and the next ones, as long as these hold fewer than k incidents), which gives a true k-th
distance.  By the triangle inequality nothing nearer lies in a block whose distances to the pivot all differ from the probe's by
more than that; the second phase joins the probe with the other blocks.

Neighbouring blocks of a group stand on a shelf, a group has about ``SHELVES`` of them.  A probe is sent to a shelf once, with the
numbers of the blocks that it visits there, and a shelf's probes are dealt to at most about as many chunks.  So on data where nothing
can be pruned, a vector travels as often as there are shelves and chunks, not as there are blocks; only where a shelf would
pass ``SHELF_BYTES`` there are more.  A shelf and a chunk are one task's matrix products, of which at most k rows leave for each probe.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.operators.timeline import segmented_scan
from faultline.session import settled

SLACK = 1e-9
#: So many more candidates than asked for are ranked exactly rather than cut first.
FEW_HITS = 32
#: The product form of a distance is good to about 1e-8 of the vectors' spread.
ROUNDING = 1e-6
#: Shelves of a group, chunks of a shelf's probes, and the bytes of vectors (as floats) that either may have.
SHELVES, SHELF_BYTES = 16, 64 << 20
#: Tables with one row for each block or shelf are broadcast up to this many blocks, some 50 bytes each.
BROADCAST_BLOCKS = 50_000


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms == 0, 1.0, norms)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by the product form, about a common centre; callers allow for rounding."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    centre = b.mean(0)
    a, b = a - centre, b - centre
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


@dataclass(frozen=True)
class NeighbourIndex:
    """Written tables of a history: ``rows`` (grp, cell, block, iid, ivec), ``blocks`` (grp, cell, block, low, high, n, no, shelf),
    ``groups`` (grp, cells), one entry of at most as many cells as pivots for each group, and ``areas`` (grp, blocks)."""

    rows: DataFrame
    blocks: DataFrame
    groups: DataFrame
    areas: DataFrame
    pivots: np.ndarray
    grouped: bool
    cosine: bool
    few_blocks: bool

    def by_group(self, rows: DataFrame, groups: DataFrame) -> DataFrame:
        """Without groups, their table is one row."""
        return rows.join(groups if self.grouped and not self.few_blocks else F.broadcast(groups), "grp")

    def by_block(self, rows: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
        return rows.join(F.broadcast(blocks) if self.few_blocks else blocks, keys)

    @property
    def most_rows(self) -> int:
        """Vectors that a shelf or a chunk may hold."""
        return _most_rows(self.pivots)


def _most_rows(centres: np.ndarray) -> int:
    return max(1, SHELF_BYTES // (4 * max(1, centres.shape[1])))


def _group_column(group: str | None) -> Column:
    return F.lit("") if group is None else F.col(group).cast("string")


def build_index(
    incidents: DataFrame, incident_id: str = "incident_id", vector: str = "embedding", group: str | None = None,
    metric: str = "l2", pivots: int = 256, cell_rows: int = 1024, block_rows: int = 4096,
) -> NeighbourIndex:
    """The index of the incidents with a vector, for searches within the values of ``group`` (a null group meets nothing).

    A group of n incidents has n / ``cell_rows`` cells, at least one and at most ``pivots``.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    cosine = metric == "cosine"
    history = incidents.where(F.col(vector).isNotNull()).select(
        F.col(incident_id).alias("iid"), _group_column(group).alias("grp"), F.col(vector).alias("ivec")).where("grp IS NOT NULL")
    cells_wanted = max(1, min(pivots, history.count() // cell_rows))
    sampled = history.orderBy(F.xxhash64("iid"), "iid").limit(cells_wanted).select("ivec").toPandas()
    centres = _matrix(sampled["ivec"])
    centres = _unit(centres) if cosine else centres

    @F.pandas_udf("struct<cell:int,radius:double>")
    def assign(vectors: pd.Series, used: pd.Series) -> pd.DataFrame:
        points = _matrix(vectors)
        if not len(points):
            return pd.DataFrame({"cell": np.zeros(0, "int32"), "radius": np.zeros(0)})
        far = _distances(_unit(points) if cosine else points, centres)
        far[np.arange(len(centres))[None, :] >= used.to_numpy()[:, None]] = np.inf
        cell = far.argmin(1)
        return pd.DataFrame({"cell": cell.astype("int32"), "radius": far[np.arange(len(points)), cell]})

    sizes = history.groupBy("grp").agg(
        F.greatest(F.lit(1), F.least(F.lit(pivots), F.floor(F.count("*") / cell_rows))).cast("int").alias("used"))
    sized = history.join(sizes if group else F.broadcast(sizes), "grp")
    placed = sized.withColumn("_at", assign("ivec", "used")).select(
        "grp", "_at.cell", "_at.radius", "iid", "ivec", F.lit(1).cast("bigint").alias("n"))
    ordered = segmented_scan(placed, ["grp", "cell"], ["radius", "iid"], totals={"n": "n"})
    rows = settled(
        ordered.withColumn("block", F.floor((F.col("n") - 1) / block_rows)).select("grp", "cell", "block", "iid", "ivec", "radius"),
        "neighbour-rows")
    measured = rows.groupBy("grp", "cell", "block").agg(
        F.min("radius").alias("low"), F.max("radius").alias("high"), F.count("*").alias("n"))
    of_group, so_far = Window.partitionBy("grp"), Window.partitionBy("grp").orderBy("cell", "block")
    shelf_rows = F.greatest(F.lit(block_rows), F.least(F.lit(_most_rows(centres)), F.ceil(F.sum("n").over(of_group) / SHELVES)))
    blocks = settled(measured.select(
        "*", (F.row_number().over(so_far) - 1).alias("no"),
        F.floor((F.sum("n").over(so_far) - F.col("n")) / shelf_rows).cast("int").alias("shelf")), "neighbour-blocks")
    cells = blocks.groupBy("grp", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    groups = settled(
        cells.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("cell", "low", "high", "n"))).alias("cells")),
        "neighbour-groups")
    areas = settled(
        blocks.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("no", "shelf", "cell", "low", "high", "n"))).alias("blocks")),
        "neighbour-areas")
    return NeighbourIndex(
        rows.drop("radius"), blocks, groups, areas, centres, group is not None, cosine, blocks.count() <= BROADCAST_BLOCKS)


@dataclass(frozen=True)
class Found:
    """``rows`` (pid, iid, distance, rank), and how many distances were computed for how many probes in each phase."""

    rows: DataFrame
    work: DataFrame


def search(index: NeighbourIndex, probes: DataFrame, k: int = 5, probe_id: str = "probe_id", vector: str = "embedding",
           group: str | None = None, exclude_self: bool = False, chunk_rows: int = 4096) -> Found:
    """The k nearest incidents of each probe; of probes that share an id one is searched."""
    keep = k + 1 if exclude_self else k
    centres, cosine = index.pivots, index.cosine
    asked = probes.where(F.col(vector).isNotNull()).select(
        F.col(probe_id).alias("pid"), _group_column(group).alias("grp"), F.col(vector).alias("pvec")).where("grp IS NOT NULL")
    asked = asked.groupBy("pid").agg(F.min(F.struct("grp", "pvec")).alias("_p")).select("pid", "_p.*")

    @F.pandas_udf("array<float>")
    def to_pivots(vectors: pd.Series) -> pd.Series:
        points = _matrix(vectors)
        return pd.Series(list(_distances(_unit(points) if cosine else points, centres)) if len(points) else [], dtype=object)

    far_of = lambda place: F.get(F.col("far"), place["cell"]).cast("double")
    near_first = F.array_sort(F.transform("cells", lambda c: F.struct(far_of(c).alias("far"), c["cell"].alias("cell"), c["n"].alias("n"))))
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<int>").alias("own"))
    until_enough = F.aggregate(
        "near", start,
        lambda seen, c: F.when(seen["total"] >= keep, seen).otherwise(F.struct(
            (seen["total"] + c["n"]).alias("total"), F.concat(seen["own"], F.array(c["cell"])).alias("own"))),
        lambda seen: seen["own"])
    placed = index.by_group(asked.withColumn("far", to_pivots("pvec")), index.groups).withColumn("near", near_first)
    placed = settled(placed.select("pid", "grp", "pvec", "far", until_enough.alias("own")), "probes")

    in_own = lambda b: F.array_contains("own", b["cell"])
    first = _visits(index, placed.withColumn("bound", F.lit(float("inf"))), in_own)
    best = settled(_ranked(_meet(index, first, k, exclude_self, chunk_rows), k), "nearest")
    # Squared distances, or half of them for the cosine; without k incidents yet there is no bound.
    square = F.max("distance") * (2.0 if cosine else 1.0)
    bounds = best.groupBy("pid").agg(F.when(F.count("*") >= k, F.sqrt(F.greatest(square, F.lit(0.0)))).alias("bound"))
    reach = F.coalesce("bound", F.lit(float("inf")))

    def may_hold_nearer(b: Column) -> Column:
        limit = F.col("bound") + ROUNDING * (1 + far_of(b))
        return ~in_own(b) & (far_of(b) - b["high"] <= limit) & (b["low"] - far_of(b) <= limit)

    second = _visits(index, placed.join(bounds, "pid", "left").withColumn("bound", reach), may_hold_nearer)
    more = _meet(index, second, k, exclude_self, chunk_rows)
    rows = _ranked(best.drop("rank").unionByName(more), k)
    counted = [part.agg(F.lit(no).alias("phase"), F.count_distinct("pid").alias("probes"), F.coalesce(F.sum("n"), F.lit(0)).alias("distances"))
               for no, part in ((1, first), (2, second))]
    return Found(rows, counted[0].unionByName(counted[1]))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("pid").orderBy("distance", "iid"))
    return found.withColumn("rank", best).where(F.col("rank") <= k)


def _visits(index: NeighbourIndex, probes: DataFrame, visited: Callable[[Column], Column]) -> DataFrame:
    """(pid, grp, shelf, pvec, bound, blocks, n): a row for each probe and shelf, with the numbers and the size of the blocks it visits."""
    kept = ["pid", "grp", "pvec", "bound"]
    at_shelf = F.filter("open", lambda b: b["shelf"] == F.col("shelf"))
    return (
        index.by_group(probes, index.areas).withColumn("open", F.filter("blocks", visited))
        .select(*kept, "open", F.explode(F.array_distinct(F.transform("open", lambda b: b["shelf"]))).alias("shelf"))
        .select(*kept, "shelf", at_shelf.alias("here"))
        .select(*kept, "shelf", F.transform("here", lambda b: b["no"]).alias("blocks"),
                F.aggregate("here", F.lit(0).cast("bigint"), lambda total, b: total + b["n"]).alias("n"))
    )


def _meet(index: NeighbourIndex, visits: DataFrame, k: int, exclude_self: bool, chunk_rows: int) -> DataFrame:
    """(pid, iid, distance): at most k rows for each probe and shelf of ``visits``."""
    at = ["grp", "shelf"]
    fair = F.greatest(F.lit(chunk_rows), F.least(F.lit(index.most_rows), F.ceil(F.count("*") / SHELVES)))
    loads = settled(visits.groupBy(*at).agg(F.ceil(F.count("*") / fair).cast("int").alias("chunks")), "neighbour-loads")
    visiting = index.by_block(visits.select("pid", "pvec", "bound", "blocks", *at), loads, at).withColumn(
        "chunk", F.pmod(F.xxhash64("pid"), F.col("chunks")).cast("int"))
    numbers = index.blocks.select("grp", "cell", "block", "no", "shelf")
    placed = index.by_block(index.rows, numbers, ["grp", "cell", "block"])
    served = index.by_block(placed, loads, at).select(
        *at, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "no", "iid", "ivec")
    cosine, types = index.cosine, dict(visits.dtypes) | dict(index.rows.dtypes)

    def search_shelf(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _search(left, right, k, cosine, exclude_self)

    keys = [*at, "chunk"]
    return visiting.select(*keys, "pid", "pvec", "bound", "blocks").groupBy(*keys).cogroup(served.groupBy(*keys)).applyInPandas(
        search_shelf, f"pid {types['pid']}, iid {types['iid']}, distance double")


def nearest_incidents(
    probes: DataFrame,
    incidents: DataFrame,
    k: int = 5,
    probe_id: str = "probe_id",
    incident_id: str = "incident_id",
    vector: str = "embedding",
    group: str | None = None,
    metric: str = "l2",
    exclude_self: bool = False,
    pivots: int = 256,
    cell_rows: int = 1024,
    block_rows: int = 4096,
    chunk_rows: int = 4096,
) -> DataFrame:
    """(probe_id, incident_id, distance, rank): the k nearest incidents of each probe, ties by incident id.

    ``metric`` is ``l2`` (squared, the default) or ``cosine`` (1 - cosine).  With ``group``, a probe meets only incidents
    with the same value of that column (filter before the top-k, not after).  ``exclude_self`` (for a search
    of the incidents among themselves) drops the incident whose id equals the probe's.
    """
    index = build_index(incidents, incident_id, vector, group, metric, pivots, cell_rows, block_rows)
    found = search(index, probes, k, probe_id, vector, group, exclude_self, chunk_rows)
    return found.rows.select(F.col("pid").alias(probe_id), F.col("iid").alias(incident_id), "distance", "rank")


def _search(
    left: pd.DataFrame, right: pd.DataFrame, k: int, cosine: bool, exclude_self: bool, tile: int = 1024
) -> pd.DataFrame:
    """Top-k of one shelf for one chunk of probes: products with the blocks that each visits find the candidates, exact distances rank them."""
    if left.empty or right.empty:
        return _hits([], [], [])
    right = right.sort_values("no", kind="stable", ignore_index=True)
    targets, ids, points = _matrix(right["ivec"]), right["iid"].to_numpy(), _matrix(left["pvec"])
    if cosine:
        targets, points = _unit(targets), _unit(points)
    pids, bounds = left["pid"].to_numpy(), left["bound"].to_numpy()
    place = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    id_texts, pid_texts = np.array([str(i) for i in ids]), np.array([str(p) for p in pids])
    visited = [np.asarray(b, dtype=np.int64) for b in left["blocks"]]
    numbers, starts = np.unique(right["no"].to_numpy(), return_index=True)
    shelf = _Shelf(targets, [*starts, len(right)])
    found = []
    for at in range(0, len(left), tile):
        part = np.arange(at, min(at + tile, len(left)))
        visits = np.zeros((len(part), len(numbers)), bool)
        visits[np.repeat(np.arange(len(part)), [len(visited[p]) for p in part]),
               np.searchsorted(numbers, np.concatenate([visited[p] for p in part]))] = True
        asked = shelf.probes(points[part])
        # Of each probe of the tile: the k nearest so far, and their greatest distance.
        best, reached = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), np.full(len(part), np.inf)
        for no in range(len(numbers)):
            guests = np.flatnonzero(visits[:, no])
            if not len(guests):
                continue
            bound = bounds[part[guests]]
            limit = np.minimum(
                (bound + ROUNDING * (1 + bound + shelf.spread)) ** 2, reached[guests] + SLACK * (1 + reached[guests]))
            i, j = shelf.near(no, asked.of(guests), limit, k + 1 if exclude_self else k)
            i = guests[i]
            if exclude_self:
                other = id_texts[j] != pid_texts[part[i]]
                i, j = i[other], j[other]
            if len(i):
                exact = _exact(points, targets, part[i], j)
                best = _nearest(*(np.concatenate(c) for c in zip(best, (i, j, exact), strict=True)), place, k)
                full = np.flatnonzero(np.bincount(best[0], minlength=len(part)) == k)
                last = np.searchsorted(best[0], full, "right") - 1
                reached[full] = best[2][last]
        found.append((part[best[0]], *best[1:]))
    i, j, exact = (np.concatenate([f[c] for f in found]) for c in range(3))
    return _hits(pids[i], ids[j], exact / 2.0 if cosine else exact)


@dataclass(frozen=True)
class _Probes:
    """Vectors about a shelf's centre with a last entry of 1, in single precision, their squares, and what a product may be wrong by."""

    rows: np.ndarray
    squares: np.ndarray
    wrong: np.ndarray

    def of(self, some: np.ndarray) -> _Probes:
        return self if len(some) == len(self.rows) else _Probes(self.rows[some], self.squares[some], self.wrong[some])


class _Shelf:
    """A shelf's vectors about their centre, in single precision, with a last entry that makes a product with (a, 1) half of
    ``|a|**2 - |a - b|**2``."""

    def __init__(self, targets: np.ndarray, bounds: list[int]):
        # A vector with an entry that is no number is near to nothing and moves no other.
        whole = np.isfinite(targets).all(1)
        self.bounds, self.centre = bounds, targets[whole].mean(0) if whole.any() else np.zeros(targets.shape[1])
        here = targets - self.centre
        squares = (here * here).sum(1)
        self.spread = float(np.sqrt(squares[whole].max(initial=0.0)))
        self.rows = np.c_[here, -squares / 2].astype(np.float32)

    def probes(self, points: np.ndarray) -> _Probes:
        points = points - self.centre
        squares = (points * points).sum(1)
        # Rounding of the entries and of a sum of that many products, by the usual bound.
        wrong = (points.shape[1] + 8) * 2.0 ** -24 * (np.sqrt(squares) + self.spread) ** 2
        return _Probes(np.c_[points, np.ones(len(points))].astype(np.float32), squares, wrong)

    def near(self, no: int, probes: _Probes, limit: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place of a probe, number of a vector of the block) that hold all with a squared distance up to ``limit``, but of a
        probe with many such only those that may be among the ``need`` nearest.  Rounding is allowed for."""
        block = self.rows[self.bounds[no]:self.bounds[no + 1]]
        product = probes.rows @ block.T
        least = _below((probes.squares - limit) / 2 - probes.wrong)
        hits = product >= least[:, None]
        need = min(need, len(block))
        many = np.flatnonzero(np.count_nonzero(hits, axis=1) > need + FEW_HITS) if len(block) > need + FEW_HITS else []
        if len(many):
            kth = -np.partition(-product[many], need - 1, axis=1)[:, need - 1].astype(np.float64)
            least[many] = np.maximum(least[many], _below(kth - 2 * probes.wrong[many]))
            hits[many] = product[many] >= least[many, None]
        i, j = np.divmod(np.flatnonzero(hits), len(block))
        return i, self.bounds[no] + j


def _below(values: np.ndarray) -> np.ndarray:
    """In single precision, rounded down."""
    return np.nextafter(values.astype(np.float32), np.float32(-np.inf))


def _exact(points: np.ndarray, targets: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Squared distances of the pairs, a step at a time: copies of one incident may all tie at a bound."""
    out = np.zeros(len(i))
    for at in range(0, len(i), step):
        cut = slice(at, at + step)
        out[cut] = ((points[i[cut]] - targets[j[cut]]) ** 2).sum(1)
    return out


def _nearest(i: np.ndarray, j: np.ndarray, exact: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k pairs of each i with the least distance, ties by the id's place."""
    order = np.lexsort((place[j], exact, i))
    i, j, exact = i[order], j[order], exact[order]
    first = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, bool)
    rank = np.arange(len(i)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(i) else i
    best = rank < k
    return i[best], j[best], exact[best]


def _hits(pids: list, iids: list, distances: list) -> pd.DataFrame:
    """Ids as plain objects: an empty column of pandas strings has no Arrow array."""
    return pd.DataFrame({"pid": pd.Series(pids, dtype=object), "iid": pd.Series(iids, dtype=object),
                         "distance": np.asarray(distances, dtype=np.float64)})
