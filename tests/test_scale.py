"""Steps that failed on larger tables: what they send, and how many rows, rounds and parts they need."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_graph import rates
from test_operators import wave_setup

from raysheaf.operators import decomposition, graph, grid, neighbours, spatial, sweep, voronoi
from raysheaf.streaming.timeline import Timeline


def scattered(spark, n):
    """Points in the unit box, far from a lattice."""
    axes = [F.pmod(F.col("id") * k, F.lit(1.0)).alias(a) for a, k in zip("xyz", (0.6180339, 0.7548776, 0.5698402), strict=True)]
    return spark.range(n).select("id", *axes)


def test_images_far_from_all_points_are_not_sent(spark):
    seen = []

    def provider(left, right, *args):
        seen.append(right.count())
        return spatial.radius_join(left, right, *args)

    points = scattered(spark, 200)
    found = spatial.periodic_haloes(points, 0.25, (1.0, 1.0, 1.0), "id", provider=provider)
    assert seen[0] < 700  # of 26 x 200 images
    every = points.alias("a").crossJoin(points.toDF("j", "u", "v", "w").alias("b"))
    for a, b in zip("xyz", "uvw", strict=True):
        every = every.withColumn(f"w{a}", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn(f"d{a}", F.col(a) - F.col(b) - F.col(f"w{a}"))
    assert found.count() == every.where("(wx <> 0 OR wy <> 0 OR wz <> 0) AND dx * dx + dy * dy + dz * dz < 0.0625").count() > 0


def test_crowded_buckets_are_dealt_out_and_merged(spark):
    rows = spark.range(60).select(F.lit(1).alias("b"), "id")
    one, two = neighbours.dealt(rows, rows.withColumnRenamed("id", "j"), ["b"], 8)
    assert one.groupBy("b", "__l", "__r").count().agg(F.max("count")).first()[0] < 30
    assert one.join(two, ["b", "__l", "__r"]).select("id", "j").distinct().count() == one.join(two, ["b", "__l", "__r"]).count() == 3600
    points = scattered(spark, 50)
    plan = spatial.radius_join(points, points, 0.2, (1.0, 1.0, 1.0))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan  # Spark takes an exploded side for small


def test_rows_meet_the_buckets_that_their_sphere_touches(spark):
    points = scattered(spark, 400)
    own = points.withColumn("radius", F.lit(0.02) * (1 + F.col("id") % 5))
    for sides in (None, (1.0, 1.0, 1.0)):
        pairs = neighbours.radius_join_by_row(own, points, "radius", sides)
        exploded = next(line for line in pairs._jdf.queryExecution().analyzed().toString().splitlines() if "filter(array" in line)
        assert "lambdafunction" in exploded
        d = [F.col(a) - F.col(b) for a, b in zip("xyz", "uvw", strict=True)]
        d = d if sides is None else [c - F.round(c) for c in d]
        want = own.crossJoin(points.toDF("j", "u", "v", "w")).where(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) < F.col("radius")).select("id", "j")
        got = pairs.select("l_id", "r_id")
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_boxes_carry_further_aggregates(spark):
    boxes = spatial.partition_boxes(scattered(spark, 30).withColumn("part", F.col("id") % 3), "part", ("x", "y"), n=F.count("*"))
    assert [r.n for r in boxes.collect()] == [10] * 3 and "Join" not in boxes._jdf.queryExecution().executedPlan().toString()


def test_waves_run_on_inside_of_a_task(spark):
    state, faces, dirs = wave_setup(spark, (40,), [(1, 0, 0)])
    want = rates(sweep.sweep(state, faces, dirs, strategy="grouped"))
    waves = sweep.sweep(state, faces, dirs, strategy="waves")
    assert waves._rounds == 1 and rates(waves) == want
    ranges = sweep.ranges_of(state, 7)
    assert sorted(r.n for r in ranges.groupBy("block").agg(F.count("*").alias("n")).collect()) == [6, 6, 7, 7, 7, 7]


def test_very_many_blocks_are_put_together(spark):
    state, faces, dirs = wave_setup(spark, (140,), [(1, 0, 0)])
    out = sweep.sweep(state, faces, dirs, blocks=state.select("cell_id", F.floor(F.col("cell_id") / 2).cast("int").alias("block")))
    assert out._rounds == 1 and rates(out) == rates(sweep.sweep(state, faces, dirs, strategy="grouped"))


def test_many_cuts_make_a_small_plan(spark):
    rows = spark.range(3000).select((F.col("id") * 7919 % 40).alias("hi"), ((F.col("id") * 104729) % (1 << 40) + (1 << 60)).alias("lo"))
    rows = rows.union(spark.createDataFrame([(None, 3), (4, None)], "hi long, lo long"))
    cuts = decomposition.load_cuts(rows, F.col("hi"), F.col("lo"), F.lit(1), 500).keys
    assert len(cuts) == 499
    owned = rows.withColumn("part", decomposition.part_of(F.col("hi"), F.col("lo"), cuts))
    assert len(owned._jdf.queryExecution().optimizedPlan().toString()) < 10_000
    assert all(r.part == (None if None in (r.hi, r.lo) else sum(c <= (r.hi, r.lo) for c in cuts)) for r in owned.collect())


def test_long_ways_cost_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "materialise", lambda df, name, f=graph.materialise: written.append(name) or f(df, name))
    ways = [(i, i + 1) for i in range(300)] + [(i, i + 1 if i < 379 else 300) for i in range(300, 380)]  # a tail and a cycle without way out
    ways += [(1000 + i, 1000 + (i + 1) % 90) for i in range(90)] + [(1000, 1045), (2000, 1007), (1020, 5)]  # a cycle with a chord and ways in and out
    edges = spark.createDataFrame([(0, a, b) for a, b in ways], "dir int, a long, b long")
    got = sorted((r.component, r.node) for r in graph.strong_components(edges).collect())
    assert got == [(300, i) for i in range(300, 380)] + [(1000, i) for i in range(1000, 1090)]
    assert len(written) < 80  # a round for each step of the tail before


def test_one_timer_stands_for_all_intervals_that_have_passed():
    from types import SimpleNamespace

    import pandas as pd

    held, known, timers = [], [], []
    task = Timeline(1000, 50.0)
    task.handle = SimpleNamespace(listTimers=lambda: iter(timers), registerTimer=timers.append)
    task.held = SimpleNamespace(appendList=held.extend, get=lambda: iter(held), put=lambda h: held.__setitem__(slice(None), h), clear=held.clear)
    task.known = SimpleNamespace(exists=lambda: bool(known), get=lambda: known[-1], update=known.append, clear=known.clear)
    list(task.handleInputRows((7,), iter([pd.DataFrame({"time_ms": [100 * i for i in range(40)], "value": [2.0 * i for i in range(40)]})]), None))
    assert timers == [1000]
    at = lambda v: SimpleNamespace(getExpiryTimeInMs=lambda: v, getCurrentWatermarkInMs=lambda: v)
    out = pd.concat(task.handleExpiredTimer((7,), at(3500), at(1000)))
    assert [tuple(r) for r in out[["kind", "time_ms", "value", "n"]].itertuples(index=False)] == [("snapshot", 1000, 18.0, 10), ("snapshot", 2000, 38.0, 10), ("crossing", 2600, 52.0, 1), ("snapshot", 3000, 58.0, 10)]
    assert timers == [1000, 4000] and len(held) == 10 and len(known) == 1


def test_coincident_points_fill_the_box_once(spark):
    points = spark.createDataFrame([(i, *p) for i, p in enumerate([(0.2, 0.3, 0.4), (0.7, 0.6, 0.5), (0.2, 0.3, 0.4), (0.7, 0.6, 0.5), (0.2, 0.3, 0.4)])], "particle_id long, x double, y double, z double")
    cells = {r.cell_id: r for r in voronoi.voronoi_cells(points, (0.0,) * 3, (1.0,) * 3).collect()}
    assert sorted(cells) == [0, 1, 2, 3, 4] and sum(c.volume for c in cells.values()) == pytest.approx(1.0)
    assert all(cells[i].volume == 0.0 and not cells[i].faces and not cells[i].infinite for i in (2, 3, 4))
    flat = voronoi.planar_cells(points, (0.0, 0.0), (1.0, 1.0))
    assert flat.count() == 5 and flat.agg(F.sum("area")).first()[0] == pytest.approx(1.0)


def test_a_cell_at_the_rim_is_cut_by_few_points(monkeypatch):
    others = np.random.default_rng(1).normal(size=(3000, 3))
    calls = []
    monkeypatch.setattr(voronoi.Polyhedron, "cut", lambda self, *a, f=voronoi.Polyhedron.cut: calls.append(a[0]) or f(self, *a))
    at = np.array([4.0, 3.0, 2.0])
    body, _ = voronoi.cell_of(at, others, np.arange(3000), (-6.0,) * 3, (6.0,) * 3)
    assert len(calls) < 300  # of 3000 that are near enough
    gap = np.sqrt(((body.corners[:, None] - others[None]) ** 2).sum(2)).min(1) - np.sqrt(((body.corners - at) ** 2).sum(1))
    assert gap.min() > -1e-9  # no corner is nearer to another point


def test_asymmetric_pairs_are_exchanged_once(spark):
    faces = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (1, 3), (4, 2), (5, 5), (6, None)], "cell_id long, neighbour_id long").withColumn("kind", F.lit("interior"))
    out = grid.asymmetric_pairs(faces)
    assert {tuple(r) for r in out.collect()} == {(1, 3, "reverse"), (3, 1, "forward"), (4, 2, "reverse"), (2, 4, "forward"), (6, None, "reverse"), (None, 6, "forward")}
    assert out.count() == 6 and out._jdf.queryExecution().sparkPlan().toString().count("Aggregate") <= 4  # a dozen before
