"""Recurrence as streaming state against a plain count: out of order, restarted, with a hot key."""

import datetime as dt
import random

import pytest

from faultline.session import shared_dir
from faultline.streaming import recurrence, streams

T0 = dt.datetime(2024, 1, 1)
DAYS = dt.timedelta(days=30)


def event_rows(n=240):
    draw = random.Random(8)
    rows = []
    for i in range(n):
        key = ("hot", "t", "c") if draw.random() < 0.5 else (draw.choice("ab"), "t", draw.choice(["c", None]))
        rows.append((i, *key, T0 + dt.timedelta(hours=draw.choice([0, 1, 24 * draw.randint(0, 70)]), milliseconds=draw.choice([0, 7]))))
    return rows


@pytest.mark.parametrize("spread", [1, 3])
def test_state_equals_counts_and_survives_a_restart(spark, spread):
    rows = sorted(event_rows(), key=lambda r: r[4])
    # Arrivals out of order, though within the delay.
    lots = [rows[:100], rows[100:101], rows[101:]]
    source, out, checkpoint = (shared_dir(spark, f"recurrence-{x}") for x in ("in", "out", "checkpoint"))
    schema = "event_id bigint, dag_id string, task_id string, error_category string, failed_at timestamp"
    for no, lot in enumerate(lots):
        mixed = lot[:]
        random.Random(no).shuffle(mixed)
        spark.createDataFrame(mixed, schema).coalesce(1).write.mode("append").json(source)
        # The query stops after each lot and starts again from its checkpoint.
        events = streams.stream_failures(spark, source)
        partials = recurrence.recurrence_partials(events, delay="80 days" if no < 2 else "1 hour", spread=spread)
        recurrence.run_recurrence(partials, out, checkpoint).awaitTermination()
    table = spark.read.schema(partials.schema).parquet(out)
    got = {int(r.event_key): r.recurrence_30d for r in recurrence.recurrence_counts(table, spread).collect()}
    end = max(r[4] for r in rows) - dt.timedelta(hours=1)
    want = {r[0]: sum(x[1:4] == r[1:4] and r[4] - DAYS <= x[4] < r[4] for x in rows)
            for r in rows if r[4] < end.replace(microsecond=end.microsecond // 1000 * 1000)}
    assert got == want and max(want.values()) > 20
    assert table.count() == spread * len(want)
