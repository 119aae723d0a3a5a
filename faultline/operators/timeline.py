"""As-of joins, previous values, running totals and rolling counts by a segmented prefix scan.

A window over one key puts all rows of that key into one task.  Here rows are dealt to parts by ranges of (key, order), of about
equal numbers of rows, and written as a table, so that a key of any size, one hour or even one instant of it is spread over as many
parts as it fills.  Within a part, ordinary windows run per key.  What a part inherits concerns only its first key: the
state of that key at the end of earlier parts, all of which end with it.  So each part is reduced to one summary row (its first and its
last key, and the last key's state), these rows are scanned, and the result, one row a part, is broadcast back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.session import settled

HOUR = 3600
DAY = 86400


@dataclass(frozen=True)
class Timeline:
    """Dated rows and the values they set from their time on; ``order`` breaks ties in time."""

    rows: DataFrame
    time: str
    values: dict[str, Column]
    order: tuple[str, ...] = ()


def _constant_key(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """A global time line is one key."""
    return (df, keys) if keys else (df.withColumn("_all", F.lit(0)), ["_all"])


def segmented_scan(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    last: dict[str, str] | None = None,
    totals: dict[str, str] | None = None,
    inclusive: bool = True,
    parts: int | None = None,
) -> DataFrame:
    """Rows with running values of their key in ``order``: the newest non-null instance, or the total, of a column.

    ``last`` and ``totals`` map new names to columns; a name may be its own column's.  Of rows that tie in ``order``, any may
    come first, so it should end with what tells them apart.  Without ``inclusive`` a row's own value does not count for
    itself.  ``parts`` fixes the number of parts; otherwise it is the session's, fewer where parts would be small.
    """
    last, totals = last or {}, totals or {}
    columns = rows.columns
    ranged = rows.repartitionByRange(*([parts] if parts else []), *keys, *order)
    # Ranges are drawn from a sample, so they hold for one evaluation only: the parts become a written table.
    table = settled(ranged.withColumn("_part", F.spark_partition_id()), "scan")
    key, place = F.struct(*keys), F.struct(*order)

    ends = table.groupBy("_part").agg(F.min(key).alias("_first"), F.max(key).alias("_final"))
    state = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(f"_s_{n}") for n, c in last.items()]
    state += [F.sum(c).alias(f"_s_{n}") for n, c in totals.items()]
    finals = (
        table.join(F.broadcast(ends.drop("_first")), "_part").where(key.eqNullSafe(F.col("_final")))
        .groupBy("_part", "_final").agg(*state)
    )
    names = [*last, *totals]
    # A part's first key meets the states of the earlier parts that end with it; a key has as many rows here as parts.
    states = [f"_s_{n}" for n in names]
    types = dict(finals.dtypes)
    known = finals.select(F.col("_final").alias("_first"), "_part", F.lit(1).alias("_end"), *states)
    asked = ends.select("_first", "_part", F.lit(0).alias("_end"), *[F.lit(None).cast(types[n]).alias(n) for n in states])
    earlier = Window.partitionBy("_first").orderBy("_part", "_end").rowsBetween(Window.unboundedPreceding, -1)
    inherited = known.unionByName(asked).select(
        "_first", "_part", "_end", *[F.last(f"_s_{n}", ignorenulls=True).over(earlier).alias(f"_s_{n}") for n in last],
        *[F.sum(f"_s_{n}").over(earlier).alias(f"_s_{n}") for n in totals]).where("_end = 0").drop("_end")

    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    local = table.select(
        *columns, "_part", *[F.last(c, ignorenulls=True).over(inside).alias(f"_w_{n}") for n, c in last.items()],
        *[F.sum(c).over(inside).alias(f"_w_{n}") for n, c in totals.items()])
    joined = local.join(F.broadcast(inherited), "_part", "left")
    carried = {n: F.when(key.eqNullSafe(F.col("_first")), F.col(f"_s_{n}")) for n in names}
    return joined.select(
        *[c for c in columns if c not in names],
        *[F.coalesce(F.col(f"_w_{n}"), carried[n]).alias(n) for n in last],
        *[(F.coalesce(F.col(f"_w_{n}"), F.lit(0)) + F.coalesce(carried[n], F.lit(0))).alias(n) for n in totals])


def _nulls(names: list[str], types: dict[str, str]) -> list[str]:
    return [f"cast(null AS {types[n]}) AS {n}" for n in names]


def _row(columns: list[str]) -> str:
    return "struct(" + ", ".join(f"`{c}`" for c in columns) + ") AS _row"


def _offered(line: Timeline, no: int, keys: list[str], bounds: DataFrame) -> DataFrame:
    """A time line's rows as far as the left side can see them, the early ones of each key reduced to one row.

    ``bounds`` has the first and last left time of each key: later rows are not seen at all, and of the rows before the first
    time only the newest values count.
    """
    names = list(line.values)
    present = " AND ".join(f"`{c}` IS NOT NULL" for c in [*[k for k in keys if k != "_all"], line.time])
    rows = line.rows.where(present)
    rows = rows.select(
        *[F.lit(0).alias(k) if k == "_all" else F.col(k) for k in keys], F.col(line.time).alias("_t"),
        F.struct(F.lit(0).alias("c"), *line.order).alias(f"_o{no}"), *[v.alias(n) for n, v in line.values.items()])
    # Without keys, the bounds are one row.
    seen = rows.join(F.broadcast(bounds) if keys == ["_all"] else bounds, keys).where("_t <= _until")
    newest = [F.max_by(n, F.when(F.col(n).isNotNull(), F.struct("_t", f"_o{no}"))).alias(n) for n in names]
    early = seen.where("_t < _since").groupBy(*keys).agg(F.max("_t").alias("_t"), F.max(f"_o{no}").alias(f"_o{no}"), *newest)
    return seen.where("_t >= _since").select(*keys, "_t", f"_o{no}", *names).unionByName(early)


def asof_join(
    left: DataFrame, timelines: list[Timeline], on: list[str], left_time: str, parts: int | None = None
) -> DataFrame:
    """Left rows with, for each value, its newest non-null instance at or before the left time.

    Any number of time lines is joined in one scan over the left rows.  Right rows of other keys, or later than the
    key's last left row, are left out first, and those before its first left row count as one.
    """
    keys = list(on) or ["_all"]
    left_rows = left.select(
        *on, *([] if on else [F.lit(0).alias("_all")]), F.col(left_time).alias("_t"), F.expr(_row(left.columns)))
    bounds = left_rows.groupBy(*keys).agg(F.min("_t").alias("_since"), F.max("_t").alias("_until"))
    offered = [_offered(line, i, keys, bounds) for i, line in enumerate(timelines)]
    types = {n: t for rows in [left_rows, *offered] for n, t in rows.dtypes} | {"_tie": "bigint"}
    ties = [f"_o{i}" for i in range(len(timelines))]
    names = [n for line in timelines for n in line.values]
    # Left rows of one instant see the same values, so any order among them will do; the hash deals them to parts.
    events = left_rows.selectExpr(
        *keys, "_t", "1 AS _kind", *_nulls(ties, types), "xxhash64(_row) AS _tie", "_row", *_nulls(names, types))
    for i, rows in enumerate(offered):
        own = {f"_o{i}", *timelines[i].values}
        events = events.union(rows.selectExpr(
            *keys, "_t", "0 AS _kind", *[n if n in own else _nulls([n], types)[0] for n in ties],
            *_nulls(["_tie", "_row"], types), *[n if n in own else _nulls([n], types)[0] for n in names]))
    scanned = segmented_scan(events, keys, ["_t", "_kind", *ties, "_tie"], last={n: n for n in names}, parts=parts)
    return scanned.where("_kind = 1").select("_row.*", *names)


def with_previous(
    df: DataFrame, keys: list[str], time: str, order: list[str], values: dict[str, Column], parts: int | None = None
) -> DataFrame:
    """Adds, for each value, its newest non-null instance among the strictly earlier rows of the key.

    Rows are ordered by (time, order).  Wrap a nullable value into a struct to get the plain previous row.
    """
    rows, keys = _constant_key(
        df.select(F.expr(_row(df.columns)), *keys, F.col(time).alias("_t"),
                  F.struct(*[F.col(c) for c in order]).alias("_o"), *[v.alias(n) for n, v in values.items()]),
        list(keys),
    )
    scanned = segmented_scan(rows, keys, ["_t", "_o"], last={n: n for n in values}, inclusive=False, parts=parts)
    return scanned.select("_row.*", *values)


def rolling_counts(
    df: DataFrame,
    keys: list[str],
    time: str,
    measures: dict[str, Column],
    lower_us: int,
    upper_us: int = 0,
    parts: int | None = None,
) -> DataFrame:
    """For each row, sums of integer measures over the rows of its key with time in (t + lower_us, t + upper_us].

    The sums depend on key and time alone, so rows of one instant are first added up.  Each such point becomes three
    events: its measures, and a reading of the running total at either end of its window.  The window's sum is the
    difference of the readings; it goes back to all rows of the point.  Rows need no id and may repeat; a row without
    time gets nulls.
    """
    names = list(measures)
    columns = df.columns
    rows = df.withColumns({f"_m{i}": m.cast("bigint") for i, m in enumerate(measures.values())}).withColumn(
        "_at", F.unix_micros(F.col(time)))
    rows, keys = _constant_key(rows, list(keys))
    points = rows.where("_at IS NOT NULL").groupBy(*keys, "_at").agg(
        *[F.coalesce(F.sum(f"_m{i}"), F.lit(0)).alias(n) for i, n in enumerate(names)])
    zeros = [F.lit(0).cast("bigint").alias(n) for n in names]

    def event(shift: int, sign: int, values: list) -> Column:
        # A reading counts the measures of its own instant, so it comes after them.
        return F.struct((F.col("_at") + F.lit(shift)).alias("_when"), F.lit(abs(sign)).alias("_read"), F.lit(sign).alias("_sign"),
                        *values)

    events = points.select(*keys, "_at", F.explode(F.array(
        event(0, 0, [F.col(n) for n in names]), event(upper_us, 1, zeros), event(lower_us, -1, zeros),
    )).alias("_e")).select(*keys, "_at", "_e.*")
    readings = segmented_scan(
        events, keys, ["_when", "_read", "_sign"], totals={n: n for n in names}, parts=parts).where("_sign <> 0")
    counted = readings.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_at").alias("_when")).agg(
        *[F.sum(F.col(n) * F.col("_sign")).alias(f"_c{i}") for i, n in enumerate(names)])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return rows.join(counted, [*same, F.col("_at") == F.col("_when")], "left").select(
        *columns, *[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)])


def last_rows(asked: DataFrame, numbered: DataFrame, keys: list[str], at: str, limit: int, name: str) -> DataFrame:
    """Adds ``name``: the values numbered ``at`` and below, at most ``limit``, newest first; null where ``at`` is.

    ``numbered`` has (keys, n, value), numbered from 1 without gaps in each key.  Numbers are dealt to blocks, each of which
    also holds the last values of the one before, so that any list is a slice of one block: values are not multiplied by the
    limit on their way, and an asking row meets one row.
    """
    size = 4 * limit
    block = F.floor(F.col("n") / size)
    held = numbered.select(*keys, "n", "value", F.explode(
        F.when(F.pmod("n", F.lit(size)) > size - limit, F.array(block, block + 1)).otherwise(F.array(block))).alias("_block"))
    held = held.groupBy(*keys, "_block").agg(F.sort_array(F.collect_list(F.struct("n", "value")), asc=False).alias("_held"))
    # Rows that ask for nothing meet nothing; they are spread over blocks that do not exist.
    nowhere = -1 - F.pmod(F.xxhash64(*asked.columns), F.lit(4096))
    placed = asked.withColumn("_block", F.coalesce(F.floor(F.col(at) / size), nowhere))
    upto = F.slice(F.filter("_held", lambda x: x["n"] <= F.col(at)), 1, limit)
    return placed.join(held, [*keys, "_block"], "left").select(*asked.columns, F.transform(upto, lambda x: x["value"]).alias(name))
