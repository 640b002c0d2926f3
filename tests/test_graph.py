"""Block sweeps, cycles and rings against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import wave_setup

from raysheaf.operators import graph, grid, sweep


def rates(df):
    return {(r.dir, r.cell_id): (round(r.incoming, 9), round(r.outgoing, 9)) for r in df.collect()}


@pytest.mark.parametrize("vector", [[(1, 0, 0), (-1, 2, 0.5)]])
def test_blocks_agree_with_one_task(spark, vector):
    counts = (4, 3, 2)
    state, faces, dirs = wave_setup(spark, counts, vector)
    fixed = spark.createDataFrame([(0, 3, 7.0), (0, 9, 2.0)], "dir int, cell_id long, fixed double")
    inflow = spark.createDataFrame([(0, 0, 1.5)], "dir int, cell_id long, inflow double")
    scattered = state.select("cell_id", (F.col("cell_id") * 5 % 3).cast("int").alias("block"))
    points = grid.cartesian_cells(spark, counts, 0.5)
    near = sweep.blocks_of(points, (0.0,) * 3, (2.0, 1.5, 1.0), capacity=6)
    assert near.select("block").distinct().count() == 4
    one = state.select("cell_id", F.lit(1).alias("block"))
    for blocks, more in ((scattered, {"fixed": fixed}), (near, {}), (one, {"inflow": inflow, "threshold": 2.0})):
        assert rates(sweep.sweep(state, faces, dirs, blocks=blocks, **more)) == rates(sweep.sweep(state, faces, dirs, strategy="grouped", **more))


def test_rounds_grow_with_blocks_and_not_with_cells(spark):
    rounds = {}
    for n, across in ((6, 2), (12, 2), (12, 4)):
        state, faces, dirs = wave_setup(spark, (n,), [(1, 0, 0)])
        out = sweep.sweep(state, faces, dirs, blocks=state.select("cell_id", F.floor(F.col("cell_id") * across / n).cast("int").alias("block")))
        rounds[n, across] = out._rounds
    assert rounds == {(6, 2): 2, (12, 2): 2, (12, 4): 4}


def test_blocks_report_a_cycle(spark):
    state, faces, dirs = wave_setup(spark, (4,), [(1, 0, 0)], periodic=True)
    ring = faces.withColumn("kind", F.lit("interior"))
    with pytest.raises(ValueError, match="cycle"):
        sweep.sweep(state, ring, dirs, blocks=state.select("cell_id", (F.col("cell_id") % 2).cast("int").alias("block")))
    wind = grid.downwind(ring, dirs).where("kind = 'interior'").select("dir", F.col("cell_id").alias("a"), F.col("neighbour_id").alias("b"))
    named = graph.strong_components(wind)
    assert sorted((r.component, r.node) for r in named.collect()) == [(0, i) for i in range(4)]
    assert sweep.sweep(state.limit(0), ring, dirs, blocks=state.select("cell_id", F.lit(0).alias("block"))).count() == 0


def plain_components(edges):
    nodes = sorted({v for e in edges for v in e})
    at = {v: i for i, v in enumerate(nodes)}
    reach = np.zeros((len(nodes),) * 2, dtype=bool)
    for a, b in edges:
        reach[at[a], at[b]] = True
    for k in range(len(nodes)):
        reach |= reach[:, [k]] & reach[[k], :]
    both = reach & reach.T
    return sorted((min(nodes[j] for j in np.flatnonzero(both[i])), v) for i, v in enumerate(nodes) if both[i].any())


def test_components(spark):
    rng = random.Random(3)
    graphs = {
        0: [(i, i + 1) for i in range(12)] + [(5, 2), (40, 40), (41, 42)],  # a cycle on a path, a loop
        1: [(rng.randrange(25), rng.randrange(25)) for _ in range(30)],
        2: [(i, (i + 1) % 6) for i in range(6)] + [(10 + i, 10 + (i + 1) % 6) for i in range(6)] + [(3, 13), (20, 0), (13, 30)],  # one cycle leads to another
        3: [(i, j) for i in range(6) for j in range(i)],  # none
        4: [(10, 11), (11, 10), (11, 1), (1, 2), (2, 1), (2, 0), (0, 3), (3, 0)],  # names come from the end
    }
    edges = spark.createDataFrame([(d, a, b) for d, e in graphs.items() for a, b in e] + [(1, None, 3)], "dir int, a long, b long")
    got = graph.strong_components(edges).collect()
    for d, e in graphs.items():
        assert sorted((r.component, r.node) for r in got if r.dir == d) == plain_components(e)
    assert graph.strong_components(edges.where("dir = 3")).count() == 0
    assert graph.strong_components(edges.limit(0)).count() == 0


def plain_rings(rings):
    out = []
    for items in rings:
        n, at = len(items), items.index(min(items))
        step = 1 if items[(at + 1) % n] <= items[at - 1] else -1
        out += [(min(items), rank, n, items[(at + step * rank) % n]) for rank in range(n)]
    return sorted(out)


def test_rings(spark):
    rng = random.Random(1)
    pool, rings = list(range(400)), []
    rng.shuffle(pool)
    for n in (3, 4, 5, 8, 33, 64, 2, 3, 100):
        rings.append([pool.pop() for _ in range(n)])
    pairs = [(ring[i], ring[(i + 1) % len(ring)]) for ring in rings for i in range(len(ring))]
    pairs = [p[:: rng.choice((1, -1))] for p in pairs] + pairs[:3] + [(None, 4)]
    rng.shuffle(pairs)
    out = graph.arranged_in_rings(spark.createDataFrame(pairs, "a long, b long"))
    got = {(r.ring, r.rank): r for r in out.collect()}
    assert sorted((r.ring, r.rank, r.n, r.item) for r in got.values()) == plain_rings(rings)
    assert all(got[ring, (rank + 1) % r.n].item == r.following for (ring, rank), r in got.items())
    square = spark.createDataFrame([(1, 3), (3, 2), (2, 4), (4, 1)], "a long, b long")
    corners = spark.createDataFrame([(1, 0.0, 0.0), (3, 2.0, 0.0), (2, 2.0, 3.0), (4, 0.0, 3.0)], "item long, x double, y double")
    assert [tuple(r) for r in graph.ring_areas(graph.arranged_in_rings(square), corners).collect()] == [(1, 4, 6.0)]
    assert graph.arranged_in_rings(square.limit(0)).count() == 0
    for wrong in ([(1, 2), (2, 3)], [(1, 2), (1, 3), (1, 4), (2, 3), (3, 4), (4, 2)]):
        with pytest.raises(ValueError, match="two partners"):
            graph.arranged_in_rings(spark.createDataFrame(wrong, "a long, b long"))
