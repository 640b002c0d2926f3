"""Registered queries for operators that the headline queries don't reach: scans, snapshots, boxes, predicates, grids, streams."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import keys as K
from ..functions import physics as P
from ..functions import predicates
from ..functions import units as U
from ..operators import grid, levels, metrics, spatial, sweep
from ..operators import snapshots as S
from ..operators import voronoi as V
from ..schema import describe
from ..session import materialise, scratch_path
from ..sources import scan
from ..sources import tables as T
from .params import Parameters, command_line, si
from .queries import _FACE_SQL, _NH, _REC, _WAVES, C_SQL, P_SQL, S_SQL, V_SQL, _diagonal, _digits, _edges, _grid, _sig, query, r
from .simulation import derived_outputs

# ---- scans


@query("SELECT unnest(['benchmark', 'conversations', 'customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier']) AS name")
def resolved_paths(spark, d):
    names = [p.rsplit("/", 1)[-1].removesuffix(".parquet") for p in scan.resolve_paths(spark, d)]
    return spark.createDataFrame([(n,) for n in names], "name string")


@query("""WITH s AS (SELECT 0 AS file, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 1, (SELECT count(*) FROM region) UNION ALL SELECT 2, (SELECT count(*) FROM supplier)),
f AS (SELECT *, sum(n) OVER (ORDER BY file) - n AS begin, sum(n) OVER () AS total FROM s),
w AS (SELECT *, worker, worker * (total // 4) AS low, CASE worker WHEN 3 THEN total ELSE (worker + 1) * (total // 4) END AS high FROM f, range(4) t(worker))
SELECT worker, file, (greatest(low, begin) - begin)::BIGINT AS start, (least(high, begin + n) - begin)::BIGINT AS stop FROM w WHERE greatest(low, begin) < least(high, begin + n)""")
def file_regions(spark, d):
    sizes = [T.table(spark, d, n).count() for n in ("nation", "region", "supplier")]
    rows = [(w, *piece) for w, pieces in enumerate(scan.file_regions(sizes, 4)) for piece in pieces]
    return spark.createDataFrame(rows, "worker long, file int, start long, stop long")


@query("SELECT c_custkey, c_nationkey FROM customer")
def projected_scan(spark, d):
    return scan.read_columns(spark, [f"{d}/customer.parquet"], ["c_custkey", "c_nationkey"])


@query("SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[64]::DOUBLE AS last FROM embeddings")
def vector_components(spark, d):
    e = T.table(spark, d, "embeddings").select("vec_id", "embedding", F.element_at("embedding", -1).cast("double").alias("last"))
    out = scan.vector_columns(e, "embedding", ("x", "y"))
    return out.select("vec_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "last")


@query(f"WITH {P_SQL} SELECT particle_id, density, temperature AS internal_energy, 0.25::DOUBLE AS xhii FROM particles")
def gas_columns(spark, d):
    raw = T.particles(spark, d).select(
        F.col("particle_id").alias("PartType0/ParticleIDs"), F.col("density").alias("PartType0/Density"), F.col("temperature").alias("PartType0/InternalEnergy"), F.col("xhii").alias("PartType0/ElectronAbundance")
    )
    return scan.gas_columns(raw, 0.25).select("particle_id", "density", "internal_energy", "xhii")


@query("SELECT p_partkey, p_size, p_retailprice, (SELECT count(*) FROM part) AS n FROM part")
def spawned_columns(spark, d):
    part = T.table(spark, d, "part")
    out, n = scan.spawned({"size": part.select("p_partkey", "p_size"), "price": part.select("p_partkey", "p_retailprice")}, "p_partkey")
    return out.withColumn("n", F.lit(n).cast("long"))


@query("""SELECT * FROM (VALUES ('own', 5.0::DOUBLE, 1, 0, 0), ('external', round(0.5::DOUBLE ** 1 * 0.7::DOUBLE ** -1 * 0.01 * 3.0, 12), 1, 0, 0), ('velocity', round(0.01::DOUBLE * 2.0, 12), 1, -1, 0)) t(name, factor, length, time, mass)""")
def unit_factors(spark, d):
    scalings = dict.fromkeys(("scaling_length", "scaling_time", "scaling_mass", "scaling_temperature", "scaling_h", "scaling_a"), 0)
    other = dict.fromkeys(("length_scaling", "velocity_scaling", "mass_scaling", "a_scaling", "h_scaling"), 0)
    found = {
        "own": U.own_factor(scalings | {"scaling_length": 1, "scale_factor_si": 5.0}),
        "external": U.external_factor(other | {"length_scaling": 1, "a_scaling": 1, "h_scaling": -1, "to_cgs": 3.0}, 0.5, 0.7),
        "velocity": U.external_factor(other | {"velocity_scaling": 1, "to_cgs": 2.0}, 1.0, 1.0),
    }
    rows = [(n, round(f, 12), int(k.length), int(k.time), int(k.mass)) for n, (f, k) in found.items()]
    return spark.createDataFrame(rows, "name string, factor double, length int, time int, mass int")


@query("SELECT * FROM nation")
def registered_table(spark, d):
    tables = scan.Registry()
    tables.register("cells", lambda: T.table(spark, d, "region"))
    tables.register("cells", lambda: T.table(spark, d, "nation"))  # the last one counts
    return tables.read("cells")


@query("SELECT * FROM (VALUES (0::BIGINT, 1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE, 5e48::DOUBLE), (1, 0.5, 0.25, 0.0, 1e50)) t(source_id, x, y, z, rate)")
def listed_sources(spark, d):
    return scan.explicit_sources(spark, [((1, 2, 3), 5e48), ((0.5, 0.25, 0), 1e50)])


@query("SELECT c_custkey, (c_custkey % 90 - 5) / 100.0 AS formation_a FROM customer WHERE c_custkey % 90 > 5")
def formed_stars(spark, d):
    stars = T.table(spark, d, "customer").select("c_custkey", ((F.col("c_custkey") % 90 - 5) / 100.0).alias("formation_a"))
    return scan.formed_stars(stars)


@query("SELECT * FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) t(name, kind)")
def column_listing(spark, d):
    return spark.createDataFrame([(n, k) for n, k, _ in describe(T.table(spark, d, "nation"))], "name string, kind string")


# ---- snapshots, series and parameters


@query(f"WITH {P_SQL} SELECT particle_id, x, density, temperature + 1 AS temperature, 0.5::DOUBLE AS scale_factor, 7.0::DOUBLE AS time FROM particles")
def snapshot_round_trip(spark, d):
    path = scratch_path(spark, "snapshots")
    rows = T.particles(spark, d).select("particle_id", "x", "density", "temperature", "xhii")
    for number in range(2):
        state = rows.withColumn("temperature", F.col("temperature") + number)
        S.write_snapshot(state, path, number, {"scale_factor": 0.5, "time": 7.0 * number}, ["x", "density", "temperature"], files=2)
    told = S.read_attributes(spark, path, 1)  # the latest one is read by default
    return S.read_snapshot(spark, path).select("particle_id", "x", "density", "temperature", F.lit(told["scale_factor"]).alias("scale_factor"), F.lit(told["time"]).alias("time"))


@query("SELECT * FROM (VALUES (0, 'snapshot=0000', 3), (1, 'snapshot=0001', 3), (12, 'snapshot=0012', 3)) t(number, name, files)")
def snapshot_files(spark, d):
    path = scratch_path(spark, "snapshots")
    rows = T.particles(spark, d).select("particle_id", "temperature")
    for number in (0, 1, 12):
        S.write_snapshot(rows, path, number, {"time": 1.0}, files=3, padding=4)
    found = scan.snapshot_dirs(spark, path)
    files = [len([p for p in scan.resolve_paths(spark, f"{p}/dynamic")]) for _, p in found]
    return spark.createDataFrame([(n, p.rsplit("/", 1)[-1], k) for (n, p), k in zip(found, files, strict=True)], "number int, name string, files int")


@query("SELECT * FROM (VALUES ('panic', true, 1), ('overwrite', false, 1), ('delete', false, 0)) t(policy, raised, left_over)")
def output_policies(spark, d):
    out = []
    for policy in ("panic", "overwrite", "delete"):
        path = scratch_path(spark, "policy")
        S.write_snapshot(T.table(spark, d, "region").withColumnRenamed("r_regionkey", "particle_id"), path, 0, {"time": 0.0})
        try:
            S.prepare(spark, path, policy)
            raised = False
        except FileExistsError:
            raised = True
        left = 0 if policy == "delete" else len(scan.snapshot_dirs(spark, path))
        out.append((policy, raised, left))
    return spark.createDataFrame(out, "policy string, raised boolean, left_over int")


@query("SELECT 'count' AS metric, n_regionkey::BIGINT AS step, n_regionkey * 10.0::DOUBLE AS time_elapsed, count(*)::DOUBLE AS val FROM nation GROUP BY n_regionkey")
def time_series_table(spark, d):
    series = S.TimeSeries(spark, scratch_path(spark, "series"))
    counts = T.table(spark, d, "nation").groupBy("n_regionkey").count().collect()
    for row in sorted(counts):
        series.append(row.n_regionkey, {"time_elapsed": row.n_regionkey * 10.0}, {"count": row["count"]})
    return series.read().select("metric", "step", "time_elapsed", "val")


_YAML = """
sweep: {directions: 84, max_timestep: 1 Myr, periodic: true}
output: {time_between_snapshots: 2 kyr}
box: {size: 3 kpc}
visualization: {}
extra: {a: 1}
"""


@query("""SELECT * FROM (VALUES ('directions', '32'), ('periodic', 'True'), ('num_timestep_levels', '1'), ('padding', '3'), ('unused', 'extra'), ('verbose', '2'), ('box', '[0.0, 3.0]')) t(name, val)""")
def parameters_in_use(spark, d):
    told = command_line(["run.yml", "sweep/directions:32", "box/size:3", "-vv"])
    p = Parameters(_YAML)
    for o in told.overrides:
        p.override(o)
    own, out = p.section("sweep"), p.section("output")
    low, high = G.box_of(p.section("box").size)
    rows = [("directions", own.directions), ("periodic", own.periodic), ("num_timestep_levels", own.num_timestep_levels), ("padding", out.snapshot_padding), ("unused", ",".join(p.unused())), ("verbose", told.verbose), ("box", [low[0], high[0]])]
    return spark.createDataFrame([(n, str(v)) for n, v in rows], "name string, val string")


@query(f"""SELECT * FROM (VALUES ('4000 kpc h^-1 a^1', round(log10(4000 * 1e3 * {U.PARSEC!r} * 0.5 / 0.7), 9)), ('2e-3 g / cm^3', round(log10(2e-3 * 1e-3 / 1e-6), 9)), ('2 kyr', round(log10(2e3 * {U.YEAR!r}), 9)), ('12.5', round(log10(12.5), 9))) t(text, val)""")
def parsed_quantities(spark, d):
    texts = ["4000 kpc h^-1 a^1", "2e-3 g / cm^3", "2 kyr", "12.5"]
    rows = [(t, round(math.log10(U.parse_quantity(t).physical(0.5, 0.7).value), 9)) for t in texts]
    assert si("2 kyr", U.TIME) == U.parse_quantity("2 kyr").value
    return spark.createDataFrame(rows, "text string, val double")


@query("SELECT * FROM (VALUES ('sweep', 2.0::DOUBLE, 4.0::DOUBLE, 2), ('chemistry', 5.0, 5.0, 1), ('cells', 7.0, NULL, NULL)) t(category, average, total, num_calls)")
def performance_numbers(spark, d):
    p = S.Performance()
    for name, seconds in (("sweep", 1.0), ("sweep", 3.0), ("chemistry", 5.0)):
        p.record(name, seconds)
    p.record_number("cells", 7)
    rows = [(k, v["average"], v["total"], v["num_calls"]) if isinstance(v, dict) else (k, float(v), None, None) for k, v in p.summary().items()]
    return spark.createDataFrame(rows, "category string, average double, total double, num_calls int")


# ---- columns


@query("SELECT o_orderkey, o_totalprice * 2 AS twice, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
def select_filter_derive(spark, d):
    o = T.table(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice > 1000").withColumn("twice", F.col("o_totalprice") * 2)
    return o.withColumnRenamed("o_orderpriority", "priority").drop("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


@query(f"WITH {P_SQL} SELECT particle_id, greatest(x - 0.5, 0) AS rate FROM particles")
def positive_rates(spark, d):
    return T.particles(spark, d).select("particle_id", P.positive(F.col("x") - 0.5).alias("rate"))


@query(f"WITH {P_SQL} SELECT particle_id, round(1 + (x + 1) / 4, 9) AS ux, round(1 + (z + 1) / 4, 9) AS uz FROM particles")
def unit_coordinates(spark, d):
    ux, _, uz = G.unit_coordinates([F.col(a) for a in "xyz"], (-1.0, -1.0, -1.0), 4.0)
    return T.particles(spark, d).select("particle_id", r(ux).alias("ux"), r(uz).alias("uz"))


@query(f"""WITH {V_SQL} SELECT vec_id, round(sqrt(x * x + y * y + z * z), 9) AS len, round(x * 1 + y * 2 - z, 9) AS dot,
round(y * -1 - z * 2, 9) AS cx, round(z * 1 - x * -1, 9) AS cy, round(x * 2 - y * 1, 9) AS cz, round(x / sqrt(x * x + y * y + z * z), 9) AS ux FROM vectors""")
def vector_algebra(spark, d):
    a, b = [F.col(c) for c in "xyz"], [F.lit(v) for v in (1.0, 2.0, -1.0)]
    cx, cy, cz = (r(c) for c in G.cross(a, b))
    return T.vectors(spark, d).select("vec_id", r(G.length(a)).alias("len"), r(G.dot(a, b)).alias("dot"), cx.alias("cx"), cy.alias("cy"), cz.alias("cz"), r(G.normalised(a)[0]).alias("ux"))


@query(f"""WITH {P_SQL}, b AS (SELECT particle_id % 7 AS part, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM particles GROUP BY 1)
SELECT part, round((hx - lx) * (hy - ly) * (hz - lz), 9) AS volume, round(greatest(hx - lx, hy - ly, hz - lz), 9) AS longest, round((lx + hx) / 2, 9) AS centre_x,
lx >= 0.1 AND ly >= 0 AND lz >= 0 AND hx <= 1 AND hy <= 1 AND hz <= 1 AS inside, lx >= -1 AND ly >= -1 AND lz >= -1 AND hx <= 2 AND hy <= 2 AND hz <= 2 AS inside_tripled FROM b""")
def box_measures(spark, d):
    boxes = spatial.partition_boxes(T.particles(spark, d).withColumn("part", F.col("particle_id") % 7), "part")
    low, high = [F.col(f"min_{a}") for a in "xyz"], [F.col(f"max_{a}") for a in "xyz"]
    m = G.box_measures(low, high)
    tripled = G.tripled_box(*G.cube(1.0))
    return boxes.select(
        "part", r(m["volume"]).alias("volume"), r(m["longest"]).alias("longest"), r(m["centre_0"]).alias("centre_x"), G.box_inside(low, high, (0.1, 0.0, 0.0), (1.0, 1.0, 1.0)).alias("inside"), G.box_inside(low, high, *tripled).alias("inside_tripled")
    )


@query(f"""WITH {P_SQL}, b AS (SELECT min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_, min(z) AS az, max(z) AS bz FROM particles),
o AS (SELECT p.*, b.*, (CASE WHEN x < (ax + bx) / 2 THEN 0 ELSE 1 END + CASE WHEN y < (ay + by_) / 2 THEN 0 ELSE 2 END + CASE WHEN z < (az + bz) / 2 THEN 0 ELSE 4 END)::INT AS octant FROM particles p, b)
SELECT octant, count(*) AS n, CASE WHEN octant & 1 = 0 THEN any_value(ax) ELSE any_value((ax + bx) / 2) END AS lx, CASE WHEN octant & 2 = 0 THEN any_value(ay) ELSE any_value((ay + by_) / 2) END AS ly,
  CASE WHEN octant & 4 = 0 THEN any_value(az) ELSE any_value((az + bz) / 2) END AS lz FROM o GROUP BY 1""")
def octant_boxes(spark, d):
    """The octants of the box around all particles and how many lie in each."""
    p = T.particles(spark, d)
    box = spatial.bounding_box(p).first()  # one row
    low, high = (tuple(box[f"{k}_{a}"] for a in "xyz") for k in ("min", "max"))
    centre = [(a + b) / 2 for a, b in zip(low, high, strict=True)]
    counts = p.groupBy(G.octant([F.col(a) for a in "xyz"], centre).alias("octant")).agg(F.count("*").alias("n"))
    parts = spark.createDataFrame([(n, *map(float, one)) for n, (one, _) in enumerate(G.sub_boxes(low, high))], "octant int, lx double, ly double, lz double")
    return counts.join(F.broadcast(parts), "octant")


@query(f"WITH {S_SQL} SELECT source_id, round(x - 0.1, 9) AS lx, round(x + 0.1, 9) AS hx, round(z - 0.1, 9) AS lz, round(z + 0.1, 9) AS hz FROM stars")
def search_boxes(spark, d):
    low, high = G.box_around([F.col(a) for a in "xyz"], 0.1)
    return T.stars(spark, d).select("source_id", r(low[0]).alias("lx"), r(high[0]).alias("hx"), r(low[2]).alias("lz"), r(high[2]).alias("hz"))


@query("SELECT true AS encloses, 4 AS corners, -1.0::DOUBLE AS least")
def enclosing_simplex(spark, d):
    simplex = G.encompassing_simplex((0, 0, 0), (1, 2, 2))
    inside = all(predicates.contains(simplex, c) for c in G.corners((0, 0, 0), (1, 2, 2)))
    return spark.createDataFrame([(inside, len(simplex), float(simplex.min()))], "encloses boolean, corners int, least double")


@query(f"""WITH {S_SQL} SELECT a.source_id AS a, b.source_id AS b FROM stars a, stars b WHERE a.source_id < b.source_id
AND abs((a.x - b.x) - round(a.x - b.x)) <= 0.1 AND abs((a.y - b.y) - round(a.y - b.y)) <= 0.1 AND abs((a.z - b.z) - round(a.z - b.z)) <= 0.1""")
def overlapping_boxes(spark, d):
    s = T.stars(spark, d).drop("rate")
    test = spatial.boxes_may_meet([F.col(f"l_{c}") for c in "xyz"], [F.col(f"r_{c}") for c in "xyz"], [0.05] * 3, [0.05] * 3, [1.0] * 3)
    near = spatial.radius_join(s, s, 0.18, (1.0, 1.0, 1.0)).where(F.col("l_source_id") < F.col("r_source_id"))
    return near.where(test).select(F.col("l_source_id").alias("a"), F.col("r_source_id").alias("b"))


@query("SELECT p_partkey, p_partkey % 30 AS ix, p_partkey // 30 % 30 AS iy FROM part")
def hilbert_inverse(spark, d):
    points = T.table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 30).alias("ix"), (F.floor(F.col("p_partkey") / 30) % 30).alias("iy"))

    def run(batches):
        for pdf in batches:
            x, y = K.hilbert2_inverse(K.hilbert2(pdf["ix"].to_numpy(np.uint64), pdf["iy"].to_numpy(np.uint64)))
            yield pdf.assign(ix=x.astype(np.int64), iy=y.astype(np.int64))

    return points.mapInPandas(run, "p_partkey long, ix long, iy long")


@query("SELECT o_orderkey, o_orderkey // 2 + o_custkey // 2 AS middle, least(o_custkey + 1, 1023) AS successor FROM orders")
def key_arithmetic(spark, d):
    o = T.table(spark, d, "orders")
    return o.select("o_orderkey", K.midpoint(F.col("o_orderkey"), F.col("o_custkey")).alias("middle"), K.successor(F.col("o_custkey"), 10).alias("successor"))


@query(f"WITH {P_SQL} SELECT count(*) AS n, true AS in_order, 8 AS parts FROM particles")
def points_in_key_order(spark, d):
    rows = K.sorted_by_key(T.particles(spark, d).select("particle_id", "x", "y", "z"), (0.0, 0.0, 0.0), 1.0, 8).withColumn("part", F.spark_partition_id())
    ranges = materialise(rows, "ordered").groupBy("part").agg(F.count("*").alias("n"), F.min(F.struct("hi", "lo")).alias("low"), F.max(F.struct("hi", "lo")).alias("high")).orderBy("part").collect()
    in_order = all(tuple(a.high) < tuple(b.low) for a, b in zip(ranges, ranges[1:], strict=False))
    return spark.createDataFrame([(sum(x.n for x in ranges), in_order, len(ranges))], "n long, in_order boolean, parts int")


@query("""SELECT c_custkey, (c_custkey // 100) AS hi, (c_custkey % 100) AS lo, CASE WHEN (c_custkey // 100, c_custkey % 100) >= (7, 20) THEN 2 WHEN (c_custkey // 100, c_custkey % 100) >= (1, 50) THEN 1 ELSE 0 END AS part FROM customer""")
def owner_of_pair(spark, d):
    c = T.table(spark, d, "customer").select("c_custkey", F.floor(F.col("c_custkey") / 100).alias("hi"), (F.col("c_custkey") % 100).alias("lo"))
    return c.withColumn("part", spatial.owner_of_pair(F.col("hi"), F.col("lo"), [(1, 50), (7, 20)]))


@query("SELECT round, greatest(0, 5 - greatest(1, round))::INT AS lowest, greatest(greatest(0, 5 - greatest(1, round)), 2)::INT AS floored, n FROM (SELECT event_id % 7 AS round, count(*) AS n FROM events GROUP BY 1)")
def level_floors(spark, d):
    rows = T.table(spark, d, "events").groupBy((F.col("event_id") % 7).alias("round")).agg(F.count("*").alias("n"))
    rows = rows.withColumn("lowest", levels.lowest_at(5, F.col("round")))
    return rows.select("round", "lowest", levels.floored(F.col("lowest"), 2).alias("floored"), "n")


_AFTER = f"((sinh((2 / (3 * sqrt(0.6911::DOUBLE)) * asinh(sqrt(0.6911 / 0.308983 * 0.2::DOUBLE ** 3)) / ({U.HUBBLE!r} * 0.6774) + s) * {U.HUBBLE!r} * 0.6774 * 1.5 * sqrt(0.6911::DOUBLE))) ** 2 / (0.6911 / 0.308983)) ** (1.0 / 3)"


@query(f"SELECT s AS time_elapsed, round({_AFTER}, 9) AS scale_factor, round(1 / ({_AFTER}) - 1, 7) AS redshift FROM (SELECT n * 3.15576e16::DOUBLE AS s FROM range(5) t(n))")
def elapsed_times(spark, d):
    specs = [U.Cosmology(a=0.2).time_spec(n * 3.15576e16) for n in range(5)]
    return spark.createDataFrame([(s["time_elapsed"], round(s["scale_factor"], 9), round(s["redshift"], 7)) for s in specs], "time_elapsed double, scale_factor double, redshift double")


@query(f"WITH {P_SQL} SELECT particle_id, {_sig(f'{_REC} * {_NH} * x * x')} AS recombination_rate FROM (SELECT particle_id, temperature * 10 AS temperature, density, 0.005 + 0.99 * xhii AS x FROM particles)")
def derived_rates(spark, d):
    p = T.particles(spark, d).select("particle_id", (F.col("temperature") * 10).alias("temperature"), (F.col("density") * 1e-20).alias("density"), (0.005 + 0.99 * F.col("xhii")).alias("xhii"))
    return p.select("particle_id", _digits(derived_outputs(1.0)["recombination_rate"]()).alias("recombination_rate"))


# ---- joins, order, groups


@query("SELECT c_custkey, c_acctbal, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def entity_join(spark, d):
    c, o = T.table(spark, d, "customer"), T.table(spark, d, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").groupBy("c_custkey", "c_acctbal").agg(F.count("o_orderkey").alias("n"))


@query(f"WITH {_edges.__globals__['_EDGES']} SELECT count(*) AS n FROM good")
def connection_count(spark, d):
    return scan.decode_connections(_edges(spark, d)).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS load FROM orders WHERE o_orderkey BETWEEN 100 AND 700")
def load_in_range(spark, d):
    return spatial.load_in_range(T.table(spark, d, "orders"), "o_orderkey", 100, 700)


@query("SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS nth FROM part ORDER BY p_size, p_partkey LIMIT 100")
def first_in_order(spark, d):
    p = T.table(spark, d, "part").select("p_partkey", "p_size").withColumn("key", F.col("p_size").cast("long") * 1_000_000_000 + F.col("p_partkey"))
    return scan.with_row_index(p, "key", 64, "nth").orderBy("nth").limit(100).select("p_partkey", "p_size", "nth")


@query(f"WITH {S_SQL} SELECT floor(x * 4)::BIGINT AS bx, floor(y * 4)::BIGINT AS by, count(*) AS n, round(sum(rate), 6) AS total FROM stars WHERE rate > 0 GROUP BY 1, 2")
def bucket_aggregates(spark, d):
    bx, by = G.bucket([F.col("x"), F.col("y")], (0.0, 0.0), 0.25)
    return T.stars(spark, d).where("rate > 0").groupBy(bx.alias("bx"), by.alias("by")).agg(F.count("*").alias("n"), r(F.sum("rate"), 6).alias("total"))


# ---- grids and sweeps


@query(f"WITH {C_SQL}, {_FACE_SQL} SELECT CASE WHEN neighbour_id IS NULL THEN 'boundary' ELSE 'interior' END AS kind, count(*) AS n FROM faces GROUP BY 1")
def non_periodic_faces(spark, d):
    cells = T.cells(spark, d)
    height = cells.agg(F.max("iz")).first()[0] + 1
    return grid.non_periodic(grid.cartesian_faces(cells, (10, 10, height), periodic=True)).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT n AS cell_id, n % 3 AS ix, n // 3 % 4 AS iy, n // 12 AS iz, (n % 3) * 0.5 AS x, (n // 12) * 0.5 AS z, 0.125::DOUBLE AS volume FROM range(60) t(n)")
def cartesian_cells(spark, d):
    return grid.cartesian_cells(spark, (3, 4, 5), 0.5).select("cell_id", "ix", "iy", "iz", "x", "z", "volume")


@query(f"""WITH {C_SQL}, {_FACE_SQL}, o AS (SELECT cell_id, (cell_id * 13 % 4) AS owner, cell_id % 3 AS level FROM cells)
SELECT DISTINCT least(a.owner, b.owner) AS a, greatest(a.owner, b.owner) AS b FROM faces f JOIN o a USING (cell_id) JOIN o b ON f.neighbour_id = b.cell_id WHERE a.owner <> b.owner AND a.level >= 1 AND b.level >= 1""")
def remote_dependencies(spark, d):
    cells, faces, _ = _grid(spark, d)
    owners = cells.select("cell_id", (F.col("cell_id") * 13 % 4).alias("owner"))
    return grid.remote_dependencies(faces, owners, cells.select("cell_id", (F.col("cell_id") % 3).alias("level")), 1)


@query(f"WITH {_WAVES.format(cells=C_SQL)} SELECT cell_id, round(incoming, 6) AS incoming, round(outgoing, 6) AS outgoing FROM w")
def diagonal_sweep_in_waves(spark, d):
    state, faces, dirs = _diagonal(spark, d)
    out = sweep.sweep(state, faces, dirs, strategy="waves")
    return out.select("cell_id", r(F.col("incoming"), 6).alias("incoming"), r(F.col("outgoing"), 6).alias("outgoing"))


@query(f"""WITH {_WAVES.format(cells=C_SQL)}, s AS (SELECT 0 AS ix, iy, iz, outgoing / 3 AS part FROM w WHERE ix = 9 UNION ALL SELECT ix, 0, iz, outgoing / 3 FROM w WHERE iy = 9
UNION ALL SELECT ix, iy, 0, outgoing / 3 FROM w, n WHERE iz = nz - 1)
SELECT ix + 10 * iy + 100 * iz AS cell_id, round(sum(part), 6) AS inflow FROM s GROUP BY 1""")
def periodic_inflow(spark, d):
    cells = T.cells(spark, d)
    height = cells.agg(F.max("iz")).first()[0] + 1
    faces = grid.cartesian_faces(cells, (10, 10, height), periodic=True)
    state, _, dirs = _diagonal(spark, d)
    out = sweep.periodic_inflow(sweep.sweep(state, faces, dirs), faces, dirs)
    return out.select("cell_id", r(F.col("inflow"), 6).alias("inflow"))


_LINES = """
SELECT a.cell_id, b.src / 6 * exp(-abs(a.before - b.before) + CASE WHEN sgn < 0 THEN a.tau - b.tau ELSE 0 END) AS part
FROM l a JOIN l b ON a.axis = b.axis AND a.line = b.line, (VALUES (1), (-1)) s(sgn) WHERE (a.i - b.i) * sgn > 0"""


@query(f"""WITH {C_SQL}, x AS (SELECT *, 0 AS axis, ix AS i, iy * 1000000 + iz AS line FROM cells UNION ALL SELECT *, 1, iy, ix * 1000000 + iz FROM cells UNION ALL SELECT *, 2, iz, ix * 1000000 + iy FROM cells),
l AS (SELECT cell_id, src, tau, axis, i, line, coalesce(sum(tau) OVER (PARTITION BY axis, line ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x),
p AS ({_LINES}) SELECT c.cell_id, round(coalesce(sum(part), 0), 6) AS rate FROM cells c LEFT JOIN p USING (cell_id) GROUP BY 1""")
def photon_rate_along_axes(spark, d):
    cells, faces, _ = _grid(spark, d)
    dirs = grid.directions(spark, [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)])
    out = sweep.photon_rate(sweep.sweep(cells.select("cell_id", "tau", F.col("src").alias("source")), faces, dirs))
    return out.select("cell_id", r(F.col("rate"), 6).alias("rate"))


@query(f"""WITH {S_SQL}, v AS (SELECT source_id, CASE WHEN x > 0.5 THEN 0 WHEN y > 0.5 THEN 1 ELSE 2 END AS dir, rate FROM stars)
SELECT source_id AS cell_id, CASE dir WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END AS dir, rate AS value FROM v""")
def rotated_directions(spark, d):
    old = grid.directions(spark, [(1, 0, 0), (0, 1, 0), (0, 0, 1)])
    turned = G.rotated(grid.directions(spark, [(1, 0, 0), (0, -1, 0), (0, 0, 1)]), G.rotation((0, 0, 1), math.pi / 2))  # along y, along x, along z
    values = T.stars(spark, d).select(F.col("source_id").alias("cell_id"), F.when(F.col("x") > 0.5, 0).when(F.col("y") > 0.5, 1).otherwise(2).alias("dir"), F.col("rate").alias("value"))
    return sweep.rebin(values, old, turned)


# ---- predicates, cells and haloes


def _triangles(spark, d):
    s = T.stars(spark, d).select("source_id", "x", "y", "z")
    one, two = (s.select((F.col("source_id") - i).alias("source_id"), *(F.col(a).alias(f"{a}{i}") for a in "xyz")) for i in (1, 2))
    four = s.select((F.col("source_id") - 3).alias("source_id"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    return s.join(one, "source_id").join(two, "source_id").join(four, "source_id")


_TRIANGLES = f"""WITH {S_SQL}, t AS (SELECT s.source_id, s.x, s.y, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, q.x AS qx, q.y AS qy
FROM stars s JOIN stars a ON a.source_id = s.source_id + 1 JOIN stars b ON b.source_id = s.source_id + 2 JOIN stars q ON q.source_id = s.source_id + 3),
u AS (SELECT *, (x1 - x) * (y2 - y) - (x2 - x) * (y1 - y) AS turn, x - qx AS ax, y - qy AS ay, x1 - qx AS bx, y1 - qy AS b_, x2 - qx AS cx, y2 - qy AS cy FROM t),
v AS (SELECT *, ax * (b_ * (cx * cx + cy * cy) - cy * (bx * bx + b_ * b_)) - ay * (bx * (cx * cx + cy * cy) - cx * (bx * bx + b_ * b_)) + (ax * ax + ay * ay) * (bx * cy - cx * b_) AS lift FROM u)"""


@query(f"""{_TRIANGLES} SELECT source_id, sign(turn)::INT AS turn, (sign(turn) * sign(lift))::INT AS in_circle,
round(x + ((y2 - y) * ((x1 - x) ** 2 + (y1 - y) ** 2) - (y1 - y) * ((x2 - x) ** 2 + (y2 - y) ** 2)) / (2 * turn), 6) AS centre_x FROM v WHERE abs(turn) > 1e-6""")
def triangle_predicates(spark, d):
    def run(batches):
        for pdf in batches:
            out = []
            for t in pdf.itertuples():
                corners = [(t.x, t.y), (t.x1, t.y1), (t.x2, t.y2)]
                if abs((t.x1 - t.x) * (t.y2 - t.y) - (t.x2 - t.x) * (t.y1 - t.y)) > 1e-6:
                    out.append((t.source_id, predicates.orientation(corners), predicates.in_sphere(corners, (t.qx, t.qy)), round(float(predicates.circumcentre(corners)[0]), 6)))
            yield pd.DataFrame(out, columns=["source_id", "turn", "in_circle", "centre_x"])

    return _triangles(spark, d).mapInPandas(run, "source_id long, turn int, in_circle int, centre_x double")


@query(f"""WITH {V_SQL} SELECT vec_id, round((x * 3 - y) / 5, 6) AS a, round((y * 2 + x * -1) / 5, 6) AS b FROM vectors""")
def linear_solutions(spark, d):
    def run(batches):
        for pdf in batches:
            found = [predicates.solve([[2.0, 1.0], [1.0, 3.0]], [x, y]) for x, y in zip(pdf["x"], pdf["y"], strict=True)]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "a": [round(float(f[0]), 6) for f in found], "b": [round(float(f[1]), 6) for f in found]})

    return T.vectors(spark, d).select("vec_id", "x", "y").mapInPandas(run, "vec_id long, a double, b double")


@query("SELECT n::INT AS n, round(n / 2.0 * sin(2 * pi() / n), 9) AS area FROM range(3, 9) t(n)")
def polygon_areas(spark, d):
    rows = []
    for n in range(3, 9):
        turns = 2 * math.pi * np.random.default_rng(n).permutation(n) / n  # corners in any order
        corners = np.stack([np.cos(turns), np.sin(turns), np.zeros(n)], axis=1)
        rows.append((n, round(V.polygon_area(V.around(corners, np.array([0.0, 0.0, 1.0]))), 9)))
    return spark.createDataFrame(rows, "n int, area double")


def _strip(spark, d):
    key = F.col("p_partkey")
    return T.table(spark, d, "part").select(key.alias("tetra_id"), F.array(key, key + 1, key + 2, key + 3).alias("p"))


@query("SELECT point, array_to_string(list_sort(list(p_partkey)), ',') AS tetras FROM (SELECT p_partkey, p_partkey + unnest([0, 1, 2, 3]) AS point FROM part) GROUP BY 1")
def incident_tetrahedra(spark, d):
    return V.incident(_strip(spark, d)).select("point", F.array_join(F.transform("tetras", lambda t: t.cast("string")), ",").alias("tetras"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_partkey AS opposite_a, b.p_partkey + 3 AS opposite_b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def adjacent_tetrahedra(spark, d):
    return V.adjacent(_strip(spark, d)).select("a", "b", "opposite_a", "opposite_b")


@query("SELECT p_partkey AS tetra_id FROM part WHERE p_partkey BETWEEN 8 AND 10")
def tetrahedra_around_edge(spark, d):
    return V.around_edge(_strip(spark, d), 10, 11).select("tetra_id")


_IMAGES = f"""WITH {S_SQL}, o AS (SELECT unnest([-1, 0, 1]) AS w), i AS (SELECT source_id, a.w AS wx, b.w AS wy, c.w AS wz, x + a.w AS x, y + b.w AS y, z + c.w AS z FROM stars, o a, o b, o c WHERE NOT (a.w = 0 AND b.w = 0 AND c.w = 0)),
h AS (SELECT s.source_id AS a, i.source_id AS b, wx, wy, wz, sqrt((s.x - i.x) ** 2 + (s.y - i.y) ** 2 + (s.z - i.z) ** 2) AS dist FROM stars s, i)"""


@query(f"{_IMAGES} SELECT a, b, wx, wy, wz, round(dist, 9) AS dist FROM h WHERE dist < 0.15")
def periodic_haloes(spark, d):
    out = spatial.periodic_haloes(T.stars(spark, d), 0.15, (1.0, 1.0, 1.0), "source_id")
    return out.select(F.col("l_source_id").alias("a"), F.col("r_source_id").alias("b"), *(F.col(f"r_w{a}").alias(f"w{a}") for a in "xyz"), r(F.col("dist")).alias("dist"))


@query(f"{_IMAGES} SELECT a, b, wx, wy, wz FROM h WHERE dist < 0.1")
def wrapped_images(spark, d):
    out = spatial.wrapped_image(T.stars(spark, d), 0.1, (1.0, 1.0, 1.0), "source_id")
    return out.select(F.col("l_source_id").alias("a"), F.col("r_source_id").alias("b"), "wx", "wy", "wz")


@query(f"WITH {C_SQL}, {_FACE_SQL} SELECT cell_id AS id FROM cells WHERE cell_id % 5 = 0 AND cell_id IN (SELECT neighbour_id FROM faces WHERE cell_id % 5 <> 0)")
def relevant_haloes(spark, d):
    cells, faces, _ = _grid(spark, d)
    haloes = cells.where("cell_id % 5 = 0").select("cell_id")
    return spatial.relevant_haloes(haloes, faces.where("cell_id % 5 <> 0")).select(F.col("cell_id").alias("id"))


@query("SELECT count(*) AS cells, 1.0::DOUBLE AS volume, 0 AS infinite, 0 AS asymmetric FROM supplier")
def periodic_voronoi(spark, d):
    points = T.stars(spark, d).select(F.col("source_id").alias("particle_id"), "x", "y", "z")
    cells = materialise(V.periodic_cells(points, (0.0,) * 3, (1.0,) * 3), "cells")
    faces = V.faces_table(cells).where("kind <> 'boundary'").withColumn("kind", F.lit("interior")).where("cell_id <> neighbour_id")
    return cells.agg(F.count("*").alias("cells"), r(F.sum("volume"), 6).alias("volume"), F.sum(F.col("infinite").cast("int")).cast("int").alias("infinite")).withColumn("asymmetric", F.lit(grid.asymmetric_pairs(faces).count()))


@query("SELECT count(*) AS cells, 1728.0::DOUBLE AS volume FROM embeddings")
def voronoi_volume(spark, d):
    points = T.vectors(spark, d).select(F.col("vec_id").alias("particle_id"), "x", "y", "z")
    return V.voronoi_cells(points, (-6.0,) * 3, (6.0,) * 3).agg(F.count("*").alias("cells"), r(F.sum("volume"), 6).alias("volume"))


@query("SELECT count(*) AS cells, 1.0::DOUBLE AS area, 4.0::DOUBLE AS border FROM supplier")
def planar_voronoi(spark, d):
    points = T.stars(spark, d).select(F.col("source_id").alias("particle_id"), "x", "y")
    cells = materialise(V.planar_cells(points, (0.0, 0.0), (1.0, 1.0)), "cells")
    border = F.aggregate("faces", F.lit(0.0), lambda acc, f: acc + F.when(f["neighbour_id"].isNull(), f["area"]).otherwise(0.0))
    return cells.agg(F.count("*").alias("cells"), r(F.sum("area"), 6).alias("area"), r(F.sum(border), 6).alias("border"))


# ---- streams


def _stream(spark, d):
    """The events as a stream of files, written one after the other in order of time."""
    from ..streaming.metrics import stream_of

    path = scratch_path(spark, "stream")
    events = T.table(spark, d, "events").select("event_id", "user_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    for part in range(3):
        own = F.least(F.floor(F.dayofmonth("ts") / 11), F.lit(2)) == part
        events.where(own).coalesce(1).write.mode("append").parquet(path)
    return stream_of(spark, path, events.schema)


@query("SELECT user_id AS entity, min(epoch_us(ts)) // 1000000 AS first_time FROM events WHERE value > 50 GROUP BY 1")
def streamed_first_crossings(spark, d):
    from ..streaming.metrics import first_crossings, run_available

    states = _stream(spark, d).withColumn("seconds", F.unix_micros("ts") / 1_000_000.0)
    out = scratch_path(spark, "crossings")
    run_available(first_crossings(states, "user_id", "seconds", "value", 50.0), lambda batch, n: batch.write.mode("append").parquet(out), scratch_path(spark, "checkpoint"))
    found = spark.read.parquet(out).groupBy("entity").agg(F.min("first_time").alias("first_time"))
    return found.select("entity", F.floor("first_time").alias("first_time"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS begin, round(sum(value * (1 + user_id % 3)) / sum(1 + user_id % 3), 9) AS average, count(*) AS n FROM events GROUP BY 1")
def streamed_averages(spark, d):
    from ..streaming.metrics import run_available, windowed_averages

    states = _stream(spark, d).withColumn("weight", 1 + F.col("user_id") % 3)
    out = scratch_path(spark, "averages")
    run_available(windowed_averages(states, "ts", "1 day", "value", "weight"), lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out), scratch_path(spark, "checkpoint"), "update")
    last = spark.read.parquet(out).groupBy("begin").agg(F.max_by(F.struct("average", "n"), "batch").alias("s"))  # a window's last update counts
    return last.select(F.col("begin").cast("timestamp_ntz").alias("begin"), r(F.col("s.average")).alias("average"), "s.n")


@query("SELECT * FROM (VALUES (0, 'total', 30.0::DOUBLE), (1, 'total', 60.0)) t(step, name, val)")
def metric_registry(spark, d):
    registry = metrics.Registry()
    registry.register("total", lambda cells: cells.agg(F.sum("v")).first()[0])
    rows = []
    for step in range(2):
        cells = spark.range(1, 5).select((F.col("id") * 3.0 * (step + 1)).alias("v"))
        rows += [(step, name, float(v)) for name, v in registry.values(cells).items()]
    return spark.createDataFrame(rows, "step int, name string, val double")
