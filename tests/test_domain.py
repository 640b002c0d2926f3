"""Decomposition, trees and neighbour joins against plain versions, clustered rows among them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from raysheaf.functions import keys as K
from raysheaf.operators import decomposition as D
from raysheaf.operators import neighbours, tree


def plain_cuts(keys, loads, parts, strict=True):
    order = sorted(range(len(keys)), key=lambda i: keys[i])
    total, cuts, cum, at = sum(loads), [], 0, 1
    for i in order:
        cum += loads[i]
        while at < parts and (cum * parts > at * total if strict else cum * parts >= at * total):
            cuts.append(keys[i])
            at += 1
    return cuts


@pytest.mark.parametrize("parts", [1, 7, 10, 50])
@pytest.mark.parametrize("scale", [(1.0,), (0.64, 1e-7, 1e-15)])
def test_decomposition_is_balanced(spark, parts, scale):
    values = [float(i) * s for s in scale for i in range(2500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    cuts = D.load_cuts(df, F.col("v"), F.lit(0), F.lit(1), parts)
    assert [c[0] for c in cuts.keys] == plain_cuts(values, [1] * len(values), parts)
    assert cuts.rounds <= 10
    owned = D.decomposed(df, F.col("v"), F.lit(0), F.lit(1), parts)
    assert D.load_imbalance(D.part_loads(owned, F.lit(1), parts)).first().imbalance < 0.05


def test_cuts_follow_the_load_and_order_pairs(spark):
    rng = np.random.default_rng(2)
    keys = [(int(a), int(b)) for a, b in zip(rng.integers(0, 5, 3000) * (1 << 60), rng.integers(0, 1 << 62, 3000), strict=True)]
    loads = [int(w) for w in rng.integers(0, 1000, 3000) ** 3]
    df = spark.createDataFrame([(*k, w) for k, w in zip(keys, loads, strict=True)], "hi long, lo long, w long").repartition(5)
    for parts in (2, 13):
        for strict in (True, False):
            assert D.load_cuts(df, F.col("hi"), F.col("lo"), F.col("w"), parts, bins=16, strict=strict).keys == plain_cuts(keys, loads, parts, strict)
    cuts = plain_cuts(keys, loads, 13)
    got = {(r.hi, r.lo): r.part for r in df.withColumn("part", D.part_of(F.col("hi"), F.col("lo"), cuts)).collect()}
    assert got == {k: sum(c <= k for c in cuts) for k in keys}


def test_decomposition_of_awkward_rows(spark):
    schema = "hi long, lo long, w long"
    empty = spark.createDataFrame([], schema)
    assert D.load_cuts(empty, F.col("hi"), F.col("lo"), F.col("w"), 4).keys == []
    assert [tuple(r) for r in D.part_loads(empty.withColumn("part", F.lit(0)), F.col("w"), 2).orderBy("part").collect()] == [(0, 0, 0), (1, 0, 0)]
    hot = spark.createDataFrame([(1, 1, 90), (2, 0, 5), (None, 3, 7), (3, 0, None)], schema)  # one key outweighs three parts
    assert D.load_cuts(hot, F.col("hi"), F.col("lo"), F.col("w"), 4).keys == [(1, 1), (1, 1), (1, 1)]
    owned = D.decomposed(hot, F.col("hi"), F.col("lo"), F.col("w"), 4)
    assert {r.hi: r.part for r in owned.collect()} == {1: 3, 2: 3, 3: 3, None: 0}


# ---- tree


def plain_tree(points, low, side, capacity, max_depth):
    """(depth, box) -> rows, by inserting one after the other."""
    nodes = {}

    def put(box, depth, rows):
        nodes[(depth, box)] = rows
        if len(rows) > capacity + 1 and depth < max_depth:
            size = side / 2 ** (depth + 1)
            children = {}
            for p in rows:
                at = tuple(b + size * (min(max(v, lo), lo + side * (1 - 1e-12)) >= b + size) for b, v, lo in zip(box, p, low, strict=True))
                children.setdefault(at, []).append(p)
            for at, some in children.items():
                put(at, depth + 1, some)

    if points:
        put(tuple(low), 0, points)
    return nodes


@pytest.mark.parametrize("capacity, max_depth, step", [(3, 6, 3), (0, 4, 1), (1, 9, 4), (1000, 5, 3)])
def test_tree(spark, capacity, max_depth, step):
    rng = np.random.default_rng(capacity)
    points = [tuple(map(float, p)) for p in np.concatenate([rng.random((150, 3)) * 4 - 1, 0.1 + rng.random((100, 3)) * 0.01, np.full((30, 3), 0.75), [[-3, 9, 0]]])]
    df = spark.createDataFrame([(*p, p[0] + 2 * p[1]) for p in points], "x double, y double, z double, m double")
    low, side = (-1.0, -1.0, -1.0), 4.0
    nodes = tree.build_tree(df, low, side, capacity, max_depth, {"m": (F.sum("m"), F.sum), "top": (F.max("z"), F.max)}, step=step)
    want = plain_tree(points, low, side, capacity, max_depth)
    got = {(r.depth, (r.low_x, r.low_y, r.low_z)): r for r in nodes.collect()}
    assert set(got) == set(want)
    for key, rows in want.items():
        assert (got[key].n, got[key].top) == (len(rows), max(p[2] for p in rows)) and got[key].m == pytest.approx(sum(p[0] + 2 * p[1] for p in rows))
        assert got[key].is_leaf == (len(rows) <= capacity + 1 or key[0] == max_depth) and got[key].size == side / 2 ** key[0]
    leaves = tree.leaves_of(df, nodes, low, side, max_depth).groupBy("leaf_depth", "leaf_path").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, leaves.collect())) == sorted((r.depth, r.path, r.n) for r in got.values() if r.is_leaf)
    whole = tree.search_tree(df.limit(1).select(F.lit(1).alias("q")), nodes, tree.everywhere)
    assert whole.count() == sum(r.is_leaf for r in got.values())


def test_tree_search_reaches_all_within(spark):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.random((200, 3)), 0.99 + rng.random((60, 3)) * 0.01])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "i long, x double, y double, z double")
    nodes = tree.build_tree(df, (0.0,) * 3, 1.0, 4, 7)
    leaves = {(r.leaf_depth, r.leaf_path) for r in tree.leaves_of(df, nodes, (0.0,) * 3, 1.0, 7).collect()}
    rows = {}
    for r in tree.leaves_of(df, nodes, (0.0,) * 3, 1.0, 7).collect():
        rows.setdefault((r.leaf_depth, r.leaf_path), []).append(r.i)
    asked = spark.createDataFrame([(q, 0.01 * q, 0.0, 0.005, 0.02 * q) for q in range(12)], "q long, a double, b double, c double, radius double")
    found = tree.search_tree(asked, nodes, tree.within_reach([F.col(c) for c in "abc"], F.col("radius"), (1.0, 1.0, 1.0)))
    for q in range(12):
        d = np.abs(points - np.array([0.01 * q, 0.0, 0.005]))
        near = set(np.flatnonzero(np.sqrt((np.minimum(d, 1 - d) ** 2).sum(1)) < 0.02 * q).tolist())
        reached = [(r.leaf_depth, r.leaf_path) for r in found.where(f"q = {q}").collect()]
        assert len(reached) == len(set(reached)) and near <= {i for k in reached for i in rows[k]}
        assert set(reached) <= leaves
    assert found.where("q = 1").count() < len(leaves) / 2
    assert tree.search_tree(asked, nodes.limit(0), tree.everywhere).count() == 0
    assert tree.build_tree(df.limit(0), (0.0,) * 3, 1.0, 4, 7).count() == 0


def test_morton(spark):
    rng = np.random.default_rng(1)
    cells = rng.integers(0, 1 << 20, (50, 3))
    df = spark.createDataFrame([tuple(map(int, c)) for c in cells], "a long, b long, c long").select("*", K.morton([F.col(c) for c in "abc"], 20).alias("key"))
    for r in df.collect():
        assert r.key == sum(((v >> b) & 1) << (3 * b + i) for b in range(20) for i, v in enumerate((r.a, r.b, r.c)))


def test_curve_fills_space_and_stays_near(spark):
    follow, digits = K.curve_states()
    assert len(follow) == len(digits) == 24 * 8
    walk = lambda cell, bits: _walk(follow, digits, cell, bits)
    by_key = {walk((x, y, z), 3): (x, y, z) for x in range(8) for y in range(8) for z in range(8)}
    assert sorted(by_key) == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(by_key[k], by_key[k + 1], strict=True)) == 1 for k in range(511))
    rng = np.random.default_rng(4)
    cells = [tuple(map(int, c)) for c in rng.integers(0, 1 << 42, (40, 3))] + [(0, 0, 0), ((1 << 42) - 1,) * 3]
    df = spark.createDataFrame(cells, "x long, y long, z long").select("*", K.curve_key(F.col("x"), F.col("y"), F.col("z")).alias("key")).select("*", "key.*")
    for r in df.collect():
        assert (r.hi << 63) + r.lo == walk((r.x, r.y, r.z), 42)
    keyed = K.with_curve_key(spark.createDataFrame([(0.5, -9.0, 0.1), (None, 0.0, 0.0)], "x double, y double, z double"), (0.0,) * 3, (1.0,) * 3)
    assert [r.hi is None for r in keyed.orderBy(F.col("x").desc()).collect()] == [False, True]
    plan = keyed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def _walk(follow, digits, cell, bits):
    state = key = 0
    for b in range(bits - 1, -1, -1):
        at = state * 8 + sum(((c >> b) & 1) << (2 - i) for i, c in enumerate(cell))
        key, state = key * 8 + digits[at], follow[at]
    return key


# ---- neighbours


def cluster(spark, n=300):
    """Half of all points in one tiny place."""
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.random((n // 2, 3)), 0.3 + rng.random((n - n // 2, 3)) * 1e-3])
    return p, spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")


@pytest.mark.parametrize("sides, block", [(None, 4096), (None, 10), ((1.0, 1.0, 1.0), 25), ((1.0, 2.0, 1.0), 4096)])
def test_radius_by_row(spark, sides, block):
    p, df = cluster(spark)
    radii = [[0.0004, 0.03, 0.26, 0.6, 0.0, None, 0.125][i % 7] for i in range(len(p))]
    own = df.join(spark.createDataFrame(list(enumerate(radii)), "id long, r double"), "id")
    d = p[:, None] - p[None]
    if sides:
        d -= np.array(sides) * np.round(d / np.array(sides))
    d = np.sqrt((d**2).sum(-1))
    want = {(i, j) for i, rad in enumerate(radii) if rad for j in np.flatnonzero(d[i] < rad).tolist()}
    pairs = [(r.l_id, r.r_id) for r in neighbours.radius_join_by_row(own, df, "r", sides, block=block).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert neighbours.radius_join_by_row(own.limit(0), df, "r", sides).count() == 0


def test_crowded_bucket_is_dealt_out(spark):
    _, df = cluster(spark, 400)
    out = neighbours.radius_join_by_row(df.withColumn("r", F.lit(0.0005)), df, "r", block=20)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "__l" in plan and "__r" in plan and "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("part_rows", [100_000, 40, 7])
def test_nearest_join_prunes_by_boxes(spark, part_rows):
    p, sites = cluster(spark)
    twins = spark.createDataFrame([(1000 + i, *map(float, p[i])) for i in range(20)] + [(2000, 0.5, None, 0.5)], "id long, x double, y double, z double")
    sites = sites.unionByName(twins)  # equal places: the smaller id is found
    rng = np.random.default_rng(8)
    q = np.concatenate([rng.random((80, 3)) * 3 - 1, np.full((60, 3), 0.3005), p[:30]])
    asked = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(q)] + [(999, 0.1, None, 0.2)], "q long, x double, y double, z double")
    d = np.sqrt(((q[:, None] - p[None]) ** 2).sum(-1))
    got = {r.q: (r.id, r.dist) for r in neighbours.nearest_join(asked, sites, "q", "id", part_rows=part_rows).collect()}
    assert {k: v[0] for k, v in got.items()} == dict(enumerate(d.argmin(1).tolist()))
    assert all(v[1] == pytest.approx(d[k].min(), abs=1e-15) for k, v in got.items())
    assert neighbours.nearest_join(asked, sites.limit(0), "q", "id").count() == 0
    assert neighbours.nearest_join(asked.limit(0), sites, "q", "id", part_rows=part_rows).count() == 0


def test_nearest_join_deals_out_queries(spark, monkeypatch):
    p, sites = cluster(spark, 120)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 10)
    asked = spark.range(200).selectExpr("id AS q", "0.3005 + id * 1e-6 AS x", "0.3D AS y", "0.3D AS z")
    got = {r.q: r.id for r in neighbours.nearest_join(asked, sites, "q", "id", part_rows=30).collect()}
    q = np.array([[0.3005 + i * 1e-6, 0.3, 0.3] for i in range(200)])
    assert got == dict(enumerate(np.sqrt(((q[:, None] - p[None]) ** 2).sum(-1)).argmin(1).tolist()))


def test_part_boxes_find_all_near(spark):
    rng = np.random.default_rng(6)
    low = rng.random((40, 3))
    high = low + rng.random((40, 3)) * 0.1
    boxes = neighbours._PartBoxes(np.arange(40), low, high)
    q, bound, own = rng.random((25, 3)), rng.random(25) * 0.4, np.arange(25)
    who, part = boxes.near(q, bound, own)
    gap = np.sqrt((np.maximum(np.maximum(low[None] - q[:, None], q[:, None] - high[None]), 0) ** 2).sum(-1))
    assert set(zip(who.tolist(), part.tolist(), strict=True)) == {(i, j) for i in range(25) for j in range(40) if gap[i, j] <= bound[i] and i != j}
