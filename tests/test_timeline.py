"""The timeline processor against the plain reading of the same states, over batches, restarts and out of order."""

import random
from datetime import datetime, timedelta

from raysheaf.streaming import timeline as tl
from raysheaf.streaming.metrics import run_available, stream_of

START = datetime(2024, 1, 1)
SCHEMA = "who long, at timestamp, v double"


def plain(rows, interval, above):
    out = []
    for who in {r[0] for r in rows}:
        mine = sorted(((r[1] - START) // timedelta(milliseconds=1), r[2]) for r in rows if r[0] == who)
        slots = {}
        for t, v in mine:
            slots.setdefault(t // interval, []).append(v)
        out += [(who, "snapshot", (k + 1) * interval, vs[-1], len(vs)) for k, vs in slots.items()]
        over = [i for i, (_, v) in enumerate(mine) if v > above]
        if over:
            out.append((who, "crossing", mine[over[0]][0], max(v for _, v in mine[: over[0] + 1]), 1))
    return sorted(out)


def run(spark, tmp_path, batches, interval, above, flush=True, **more):
    """Feed the batches, a restart after each, and read all that was put out."""
    path, out, offset = str(tmp_path / "in"), str(tmp_path / "out"), int(START.timestamp()) * 1000
    for i, rows in enumerate([*batches, None] if flush else batches):
        df = spark.createDataFrame(rows or [], SCHEMA)
        (df if rows is not None else tl.flush_row(df, "who", "at")).coalesce(1).write.mode("append").parquet(path)
        states = stream_of(spark, path, df.schema)
        with tl.timers(spark):
            run_available(tl.timeline(states, "who", "at", "v", interval, above, **more), lambda b, n: b.write.mode("append").parquet(out), str(tmp_path / "checkpoint"))
    got = spark.read.parquet(out).collect()
    return sorted((r.entity, r.kind, r.time_ms - offset, r.value, r.n) for r in got)


def test_timeline(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(5), START + timedelta(seconds=rng.randrange(4000)), float(rng.randrange(100))) for _ in range(150)]
    rows.sort(key=lambda r: r[1])
    batches = [rows[:60], rows[60:110], rows[110:]]
    for b in batches:
        rng.shuffle(b)
    assert run(spark, tmp_path, batches, 600_000, 80.0) == plain(rows, 600_000, 80.0)


def test_open_intervals_wait_and_late_rows_are_dropped(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    batches = [[(1, at(5), 1.0), (1, at(25), 9.0)], [(1, at(3), 99.0), (2, at(26), 4.0)]]  # the second row 3 is behind the watermark
    got = run(spark, tmp_path, batches, 10_000, 8.0, flush=False)
    assert got == [(1, "snapshot", 10_000, 1.0, 1)]


def test_idle_entities_are_forgotten(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    batches = [[(1, at(5), 9.0)], [(2, at(500), 0.0)], [(1, at(505), 9.5)], [(2, at(900), 0.0)]]
    got = run(spark, tmp_path, batches, 10_000, 8.0, idle=3)
    assert [g[:4] for g in got if g[1] == "crossing"] == [(1, "crossing", 5_000, 9.0), (1, "crossing", 505_000, 9.5)]

