import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from raysheaf import schema
from raysheaf.functions import units as U
from raysheaf.operators import grid, metrics, spatial, sweep
from raysheaf.operators import voronoi as V
from raysheaf.sources import scan


def points(spark, n, seed=1338, side=1.0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.random((n, 3)) * side)], "particle_id long, x double, y double, z double")


def array(df):
    return np.array([(r.x, r.y, r.z) for r in df.orderBy(df.columns[0]).collect()])


@pytest.mark.parametrize("sizes, workers", [([100], 1), ([100], 2), ([100], 3), ([100, 200], 3), ([100, 200, 301], 4), ([100, 0, 100], 2), ([0], 6)])
def test_file_regions(sizes, workers):
    regions = scan.file_regions(sizes, workers)
    assert len(regions) == workers
    flat = [(f, i) for pieces in regions for f, a, b in pieces for i in range(a, b)]
    assert flat == [(f, i) for f, n in enumerate(sizes) for i in range(n)]
    assert all(sum(b - a for _, a, b in pieces) == sum(sizes) // workers for pieces in regions[:-1])


def test_chunk_bounds(spark):
    rows = [tuple(r)[1:] for r in scan.chunk_bounds(spark, 0, 450, 100).orderBy("chunk").collect()]
    assert rows == [(0, 100), (100, 200), (200, 300), (300, 400), (400, 450)]
    assert scan.chunk_bounds(spark, 5, 5, 100).count() == 0


def test_schema_checks(spark):
    df = spark.createDataFrame([(1, 2.0)], "cell_id long, mass double")
    si = scan.convert_units(df, {"mass": (U.SOLAR_MASS, U.MASS)})
    assert si.first().mass == pytest.approx(2 * U.SOLAR_MASS) and si.schema["mass"].metadata["dimension"]["mass"] == 1
    wanted = schema.T.StructType([schema.field("mass", schema.D, U.MASS)])
    schema.check_schema(si, wanted)
    with pytest.raises(ValueError):
        schema.check_schema(si, schema.T.StructType([schema.field("mass", schema.D, U.TIME)]))
    with pytest.raises(ValueError):
        schema.check_schema(df, schema.PARTICLES)
    with pytest.raises(ValueError):
        scan.convert_units(df, {"mass": (1.0, U.MASS)}, {"mass": U.LENGTH})
    vector = spark.createDataFrame([([1.0, 2.0, 3.0],)], "p array<double>")
    assert tuple(scan.vector_columns(vector, "p").first()) == (1.0, 2.0, 3.0)


def test_scans(spark, tmp_path):
    for n in (3, 12):
        spark.range(n).write.parquet(f"{tmp_path}/snapshot={n:03d}")
        spark.range(n).write.parquet(f"{tmp_path}/part{n}.parquet")
    assert [n for n, _ in scan.snapshot_dirs(spark, str(tmp_path))] == [3, 12]
    paths = scan.resolve_paths(spark, str(tmp_path))
    assert len(paths) == 2 and scan.read_columns(spark, paths, ["id"]).count() == 15
    sources = scan.explicit_sources(spark, [((0.1, 0.2, 0.3), 5.0)])
    registry = scan.Registry()
    registry.register("sources", lambda: sources.limit(0))
    registry.register("sources", lambda: sources)
    assert registry.read("sources").count() == 1
    stars = spark.createDataFrame([(1, 0.5), (2, -0.5), (3, 0.0)], "star_id long, formation_a double")
    assert [r.star_id for r in scan.formed_stars(stars).collect()] == [1]


@pytest.mark.parametrize("radius, sides", [(0.15, None), (0.2, (1.0, 1.0, 1.0))])
def test_radius_join_equals_brute_force(spark, radius, sides):
    df = points(spark, 150)
    p = array(df)
    d = p[:, None] - p[None]
    if sides:
        d -= np.round(d)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.sqrt((d**2).sum(-1)) < radius), strict=True)}
    got = {(r.l_particle_id, r.r_particle_id) for r in spatial.radius_join(df, df, radius, sides).collect()}
    assert got == want
    if sides:
        with pytest.raises(ValueError):
            spatial.radius_join(df, df, 0.5, sides)


def test_nearest_join_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    sites = np.concatenate([rng.random((60, 3)) * 0.05, [[9.0, 9.0, 9.0], [9.0, 9.0, 9.0]]])  # a cluster, and far away twins
    queries = rng.random((80, 3)) * 10
    s = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(sites)], "site long, x double, y double, z double")
    q = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(queries)], "q long, x double, y double, z double")
    d = np.sqrt(((queries[:, None] - sites[None]) ** 2).sum(-1))
    got = {r.q: (r.site, r.dist) for r in spatial.nearest_join(q, s, "q", "site").collect()}
    assert {k: v[0] for k, v in got.items()} == dict(enumerate(d.argmin(1).tolist()))
    assert all(v[1] == pytest.approx(d[k].min()) for k, v in got.items())
    assert spatial.nearest_join(q, s.limit(0), "q", "site").count() == 0


@pytest.mark.parametrize("parts", [1, 7, 10, 50])
def test_balance(spark, parts):
    values = [float(i) for i in range(500)] + [i * 1e-5 for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "key double")
    owned = df.withColumn("part", spatial.owner_of(F.col("key"), spatial.range_cuts(df, "key", parts)))
    assert spatial.imbalance(owned, "part").first().imbalance < 0.11  # parts of 20 rows, give or take a cut's own row


def test_remap_and_sources(spark):
    now = points(spark, 40).withColumn("temperature", F.lit(100.0))
    old = now.select(F.col("particle_id").alias("old"), *(F.col(a) / 2 for a in "xyz"), (F.col("particle_id") * 10.0).alias("temperature")).toDF("old", "x", "y", "z", "temperature")
    out = {r.particle_id: r.temperature for r in spatial.remap(now, old, "particle_id", "old", ["temperature"], rescale=2.0).collect()}
    assert out == {i: max(100.0, i * 10.0) for i in range(40)}


def wave_setup(spark, counts, vector, periodic=False):
    cells = grid.cartesian_cells(spark, counts, 0.5)
    faces = grid.cartesian_faces(cells, counts, 0.5, periodic)
    dirs = grid.directions(spark, vector)
    state = cells.select("cell_id", (F.col("cell_id") % 5 / 10).alias("tau"), (F.col("cell_id") % 3 + 1.0).alias("source"))
    return state, faces, dirs


@pytest.mark.parametrize("vector", [[(1, 1, 1)], [(1, 0, 0), (-1, 2, 0.5)]])
def test_sweep_strategies_agree_and_conserve(spark, vector):
    state, faces, dirs = wave_setup(spark, (3, 4, 2), vector)
    one = sweep.sweep(state, faces, dirs, strategy="grouped")
    two = sweep.sweep(state, faces, dirs, strategy="waves")
    rates = lambda df: {(r.dir, r.cell_id): (round(r.incoming, 9), round(r.outgoing, 9)) for r in df.collect()}
    assert rates(one) == rates(two) and len(rates(one)) == 24 * len(vector)
    for r in sweep.conservation(one, state, faces, dirs).collect():
        assert r.emitted == pytest.approx(r.absorbed + r.escaped)


@pytest.mark.parametrize("strategy", ["grouped", "waves"])
def test_cells_that_are_not_swept_go_on_sending(spark, strategy):
    state, faces, dirs = wave_setup(spark, (5,), [(1, 0, 0)])
    fixed = spark.createDataFrame([(0, 0, 7.0), (0, 3, 2.0)], "dir int, cell_id long, fixed double")
    out = {r.cell_id: (r.incoming, r.outgoing) for r in sweep.sweep(state, faces, dirs, fixed=fixed, strategy=strategy).collect()}
    tau, own = [i % 5 / 10 for i in range(5)], [i % 3 + 1.0 for i in range(5)]
    one = (7.0 + own[1]) * math.exp(-tau[1])
    two = (one + own[2]) * math.exp(-tau[2])
    want = {0: (0.0, 7.0), 1: (7.0, one), 2: (one, two), 3: (two, 2.0), 4: (2.0, (2.0 + own[4]) * math.exp(-tau[4]))}
    assert all(out[i] == pytest.approx(want[i]) for i in range(5))


def test_sweep_along_a_ray_is_attenuation(spark):
    n = 12
    cells = grid.cartesian_cells(spark, (n,), 1.0)
    faces = grid.cartesian_faces(cells, (n,), 1.0)
    state = cells.select("cell_id", F.lit(0.25).alias("tau"), F.when(F.col("cell_id") == 0, 1.0).otherwise(0.0).alias("source"))
    out = {r.cell_id: r.outgoing for r in sweep.sweep(state, faces, grid.directions(spark, 1)).collect()}
    assert all(out[i] == pytest.approx(math.exp(-0.25 * (i + 1))) for i in range(n))


def test_sweep_threshold_cycle_and_periodic(spark):
    state, faces, dirs = wave_setup(spark, (4,), [(1, 0, 0)], periodic=True)
    first = sweep.sweep(state, faces, dirs)
    inflow = sweep.periodic_inflow(first, faces, dirs)
    assert [r.cell_id for r in inflow.collect()] == [0]
    second = {r.cell_id: r.incoming for r in sweep.sweep(state, faces, dirs, inflow=inflow).collect()}
    assert second[0] == pytest.approx(inflow.first().inflow)
    assert sweep.sweep(state, faces, dirs, threshold=100.0).agg(F.sum("outgoing")).first()[0] == 0.0
    ring = faces.withColumn("kind", F.lit("interior"))
    with pytest.raises(Exception, match="cycle"):
        sweep.sweep(state, ring, dirs).collect()
    with pytest.raises(ValueError, match="cycle"):
        sweep.sweep(state, ring, dirs, strategy="waves")
    assert grid.non_periodic(faces).where("kind = 'periodic'").count() == 0


def test_grid_is_symmetric(spark):
    cells = grid.cartesian_cells(spark, (3, 3))
    faces = grid.cartesian_faces(cells, (3, 3))
    assert grid.asymmetric_pairs(faces).count() == 0
    assert grid.asymmetric_pairs(faces.where("not (cell_id = 0 and neighbour_id = 1)")).count() == 2
    assert faces.count() == 36 and faces.where("kind = 'boundary'").count() == 12


def test_directions(spark):
    for n, ndim in ((1, 3), (84, 3), (8, 2)):
        v = np.array([(r.dx, r.dy, r.dz) for r in grid.directions(spark, n, ndim).collect()])
        assert len(v) == n and np.allclose((v**2).sum(1), 1.0)
    spread = np.array([(r.dx, r.dy, r.dz) for r in grid.directions(spark, 84).collect()])
    assert np.abs(spread.mean(0)).max() < 0.02
    axes = grid.directions(spark, [(1, 0, 0), (0, 1, 0), (0, 0, 1)])
    tilted = grid.directions(spark, [(0, 2, 0.1), (3, 0.2, 0), (0, 0, 1)])
    assert {r.dir: r.to for r in sweep.aligned(axes, tilted).collect()} == {0: 1, 1: 0, 2: 2}
    values = spark.createDataFrame([(7, 0, 1.0), (7, 1, 2.0)], "cell_id long, dir int, value double")
    assert {r.dir: r.value for r in sweep.rebin(values, axes, tilted).collect()} == {1: 1.0, 0: 2.0}


def test_voronoi_golden_cell():
    p = np.array([(0, 0, 0), (0.6, 0.1, 0.1), (0.1, 0.5, 0.1), (0.1, 0.1, 0.4), (0.1, 0.1, 0.1)])
    body, final = V.cell_of(p[4], p[:4], np.arange(4), (-5.0,) * 3, (5.0,) * 3)
    volume, faces = V.faces_of(body, p[4], dict(enumerate(p)))
    assert final and volume == pytest.approx(0.0703125)
    areas = sorted(f["area"] for f in faces)
    assert areas == pytest.approx([0.28125, 0.28125, 0.28125, 0.4871392896287468]) and all(f["neighbour_id"] is not None for f in faces)
    assert len({tuple(np.round(c, 9)) for _, corners in body.faces for c in corners}) == 4
    normal = next(f for f in faces if f["neighbour_id"] == 0)
    assert [normal[f"n{a}"] for a in "xyz"] == pytest.approx([-1 / math.sqrt(3)] * 3)


def test_voronoi_fills_the_box(spark):
    df = points(spark, 60)
    cells = V.voronoi_cells(df, (0.0,) * 3, (1.0,) * 3).cache()
    assert cells.count() == 60 and cells.agg(F.sum("volume")).first()[0] == pytest.approx(1.0)
    faces = V.faces_table(cells)
    assert grid.asymmetric_pairs(faces).count() == 0
    p, probe = array(df), points(spark, 30, seed=5)
    near = {r.particle_id: r.cell_id for r in V.containing_cell(probe, cells.select("cell_id", "x", "y", "z"), "particle_id", "cell_id").collect()}
    assert near == {i: int(((p - q) ** 2).sum(1).argmin()) for i, q in enumerate(array(probe))}


def test_tetrahedra_are_delaunay():
    p = np.random.default_rng(2).random((25, 3))
    tetras = V.tetrahedra(p, (-50.0,) * 3, (51.0,) * 3)
    assert tetras
    for t in tetras:
        a = p[list(t)]
        centre = np.linalg.solve(2 * (a[1:] - a[0]), (a[1:] ** 2).sum(1) - (a[0] ** 2).sum())
        radius = np.linalg.norm(a[0] - centre)
        rest = np.delete(p, list(t), axis=0)
        assert (np.linalg.norm(rest - centre, axis=1) > radius - 1e-9).all()


def test_row_index_and_prefix(spark):
    df = spark.createDataFrame([(k, 2 * k) for k in (5, 0, 9000, 4096, 70000)], "k long, v long")
    assert {r.k: r.row_index for r in scan.with_row_index(df, "k").collect()} == {0: 0, 5: 1, 4096: 2, 9000: 3, 70000: 4}
    assert {r.k: r.prefix for r in metrics.exclusive_prefix(df, "k", "v").collect()} == {0: 0, 5: 0, 4096: 10, 9000: 8202, 70000: 26202}


def test_relative_change(spark):
    rows = spark.createDataFrame([(1.0, 0.5), (0.0, 0.0), (0.0, 1.0), (1e-9, 2e-9)], "a double, b double")
    got = [r[0] for r in rows.select(metrics.relative_change(F.col("a"), F.col("b"), 1e-6)).collect()]
    assert got[0] == 0.5 and got[1] == 0.0 and got[2] == pytest.approx(1 / np.finfo(float).eps) and got[3] == 0.0


def test_adjacency_of_edges_turns_the_first_normal(spark):
    edges = spark.createDataFrame([(10, 20, 2.0, 1.0, 0.0, 0.0, False, False), (10, 99, 1.0, 0.0, 1.0, 0.0, True, False), (98, 99, 1.0, 0.0, 0.0, 1.0, False, False)], "id1 long, id2 long, area double, nx double, ny double, nz double, periodic1 boolean, periodic2 boolean")
    ids = spark.createDataFrame([(10, 0), (20, 1)], "external_id long, cell_id long")
    rows = {(r.cell_id, r.neighbour_id, r.kind, r.nx, r.ny) for r in grid.adjacency_of_edges(edges, ids).collect()}
    assert rows == {(0, 1, "interior", -1.0, 0.0), (1, 0, "interior", 1.0, 0.0), (0, None, "periodic", 0.0, -1.0)}


def test_tetrahedra_relations(spark):
    p = np.random.default_rng(3).random((15, 3))
    quads = sorted(V.tetrahedra(p, (-50.0,) * 3, (51.0,) * 3))
    table = spark.createDataFrame([(i, list(q)) for i, q in enumerate(quads)], "tetra_id long, p array<int>")
    want = {(i, j) for i, a in enumerate(quads) for j, b in enumerate(quads) if i < j and len(set(a) & set(b)) == 3}
    got = V.adjacent(table).collect()
    assert {(r.a, r.b) for r in got} == want and all(r.opposite_a not in r.face and r.opposite_b not in r.face for r in got)
    around = {r.point: r.tetras for r in V.incident(table).collect()}
    assert all(around[x] == [i for i, q in enumerate(quads) if x in q] for x in around)
    assert {r.tetra_id for r in V.around_edge(table, *quads[0][:2]).collect()} == {i for i, q in enumerate(quads) if set(quads[0][:2]) <= set(q)}


def test_rotations(spark):
    from raysheaf.functions import geometry as G

    for seed in range(100):
        m = G.random_rotation(seed)
        assert np.linalg.det(m) == pytest.approx(1.0) and np.allclose(m @ m.T, np.eye(3))
    assert np.allclose(G.rotation((0, 0, 2), math.pi / 2) @ [1, 0, 0], [0, 1, 0])
    turned = G.rotated(grid.directions(spark, [(1, 0, 0)]), G.rotation((0, 0, 1), math.pi / 2)).first()
    assert (turned.dx, turned.dy, turned.dz) == pytest.approx((0.0, 1.0, 0.0))


def test_range_load_and_box_overlap(spark):
    df = spark.range(10)
    assert spatial.load_in_range(df, "id", 2, 5).first().load == 4
    lit = lambda *v: [F.lit(float(x)) for x in v]
    meet = lambda a, b: df.limit(1).select(spatial.boxes_may_meet(lit(a), lit(b), lit(0.1), lit(0.1), (1.0,))).first()[0]
    assert meet(0.05, 0.95) and not meet(0.1, 0.5)
