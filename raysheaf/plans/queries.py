"""Registered queries over the test tables, each with the same question in DuckDB's SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import keys as K
from ..functions import physics as P
from ..functions import units as U
from ..operators import grid, levels, metrics, neighbours, solver, spatial, sweep
from ..operators import snapshots as S
from ..operators import voronoi as V
from ..sources import scan
from ..sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
P_SQL, C_SQL, S_SQL, V_SQL = T.PARTICLES_SQL, T.CELLS_SQL, T.STARS_SQL, T.VECTORS_SQL


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(c, digits: int = 9):
    """Rounded, so that the order of floating sums doesn't show."""
    return F.round(c, digits)


# ---- scans and projections


@query(f"WITH {P_SQL} SELECT particle_id, x * 3.0857e16 AS x, density * 1.988477e30 AS density FROM particles")
def scan_project_units(spark, d):
    df = T.particles(spark, d).select("particle_id", "x", "density")
    return scan.convert_units(df, {"x": (U.PARSEC, U.LENGTH), "density": (U.SOLAR_MASS, U.MASS)})


@query("""
WITH a AS (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_partkey) - 1 AS row_index FROM part),
     b AS (SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_suppkey) - 1 AS row_index FROM supplier)
SELECT row_index, p_partkey, p_retailprice, s_suppkey, s_acctbal FROM a JOIN b USING (row_index)""")
def column_zip_by_index(spark, d):
    left = T.table(spark, d, "part").select("p_partkey", "p_retailprice")
    right = T.table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return scan.zip_by_index(left, right, "p_partkey", "s_suppkey")


@query("""WITH n AS (SELECT count(*) AS n FROM orders), r AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row, o_totalprice FROM orders)
SELECT row // 400 AS chunk, row // 400 * 400 AS chunk_start, least(row // 400 * 400 + 400, any_value(n)) AS chunk_end, count(*) AS n, round(sum(o_totalprice), 3) AS total FROM r, n GROUP BY 1""")
def chunk_bounds(spark, d):
    """Orders in chunks of 400 rows: the chunks' bounds and what lies in them."""
    orders = scan.with_row_index(T.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    chunks = scan.chunk_bounds(spark, 0, orders.count(), 400)
    held = orders.groupBy(F.floor(F.col("row_index") / 400).alias("chunk")).agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 3).alias("total"))
    return chunks.join(held, "chunk")


@query(f"WITH {P_SQL} SELECT count(*) AS n, count(DISTINCT particle_id) AS ids FROM particles")
def row_count(spark, d):
    return T.particles(spark, d).agg(F.count("*").alias("n"), F.count_distinct("particle_id").alias("ids"))


@query(f"""WITH {P_SQL} SELECT particle_id, round(temperature * 1.0e5 / (1 + xhii) * ({U.GAMMA - 1!r} * {U.PROTON_MASS!r} / {U.BOLTZMANN!r}), 6) AS t FROM particles""")
def particle_temperature(spark, d):
    return T.particles(spark, d).select("particle_id", r(P.temperature_of(F.col("temperature") * 1.0e5, F.col("xhii")), 6).alias("t"))


@query(f"WITH {P_SQL} SELECT particle_id, greatest(1e-10::DOUBLE, least(0.76::DOUBLE * xhii, 1 - 1e-10::DOUBLE)) AS fraction, 0.0::DOUBLE AS initial FROM particles")
def ionized_fraction_clamp(spark, d):
    return T.particles(spark, d).select("particle_id", P.fraction_of_electrons(F.col("xhii")).alias("fraction"), F.coalesce(F.lit(None).cast("double"), F.lit(0.0)).alias("initial"))


@query(f"WITH {P_SQL} SELECT particle_id, density * volume AS mass, round(cbrt(3 * volume / (4 * pi())), 9) AS size FROM particles")
def cell_mass(spark, d):
    return T.particles(spark, d).select("particle_id", (F.col("density") * F.col("volume")).alias("mass"), r(G.cell_size_of_volume(F.col("volume"))).alias("size"))


@query(f"WITH {P_SQL} SELECT particle_id, round((x + 0.7 + 0.5) - floor(x + 0.7 + 0.5) - 0.5, 9) AS wx, round((y - 3.2 + 0.5) - floor(y - 3.2 + 0.5) - 0.5, 9) AS wy FROM particles")
def periodic_wrap(spark, d):
    p = T.particles(spark, d)
    return p.select("particle_id", r(G.wrap(F.col("x") + 0.7, -0.5, 0.5)).alias("wx"), r(G.wrap(F.col("y") - 3.2, -0.5, 0.5)).alias("wy"))


@query(f"""WITH {P_SQL}, q AS (SELECT particle_id, x - 0.9 AS dx, y - 0.1 AS dy, z - 0.5 AS dz FROM particles),
m AS (SELECT particle_id, CASE WHEN dx > 0.5 THEN dx - 1 WHEN dx < -0.5 THEN dx + 1 ELSE dx END AS dx,
             CASE WHEN dy > 0.5 THEN dy - 1 WHEN dy < -0.5 THEN dy + 1 ELSE dy END AS dy,
             CASE WHEN dz > 0.5 THEN dz - 1 WHEN dz < -0.5 THEN dz + 1 ELSE dz END AS dz FROM q)
SELECT particle_id, round(sqrt(dx * dx + dy * dy + dz * dz), 9) AS dist FROM m""")
def min_image_distance(spark, d):
    point, to = [F.col(a) for a in "xyz"], [F.lit(v) for v in (0.9, 0.1, 0.5)]
    return T.particles(spark, d).select("particle_id", r(G.periodic_distance(point, to, (1.0, 1.0, 1.0))).alias("dist"))


@query(f"""WITH {S_SQL}, o AS (SELECT unnest([-1, 0, 1]) AS w)
SELECT source_id, a.w AS wx, b.w AS wy, c.w AS wz, round(x + a.w, 9) AS x, round(y + b.w, 9) AS y, round(z + c.w, 9) AS z
FROM stars, o a, o b, o c""")
def periodic_images(spark, d):
    out = G.images(T.stars(spark, d).drop("rate"), (1.0, 1.0, 1.0))
    return out.select("source_id", "wx", "wy", "wz", *(r(F.col(a)).alias(a) for a in "xyz"))


_OCT = "(CASE WHEN x < {0} THEN 0 ELSE 1 END + CASE WHEN y < {1} THEN 0 ELSE 2 END + CASE WHEN z < {2} THEN 0 ELSE 4 END)"


@query(f"""WITH {P_SQL}, a AS (SELECT *, {_OCT.format(0.5, 0.5, 0.5)} AS oct1 FROM particles),
b AS (SELECT oct1, CASE WHEN x < 0.25 + 0.5 * (oct1 & 1) THEN 0 ELSE 1 END + CASE WHEN y < 0.25 + 0.5 * ((oct1 >> 1) & 1) THEN 0 ELSE 2 END
             + CASE WHEN z < 0.25 + 0.5 * ((oct1 >> 2) & 1) THEN 0 ELSE 4 END AS oct2 FROM a)
SELECT oct1, oct2, count(*) AS n FROM b GROUP BY ROLLUP (oct1, oct2)""")
def octant_rollup_counts(spark, d):
    point = [F.col(a) for a in "xyz"]
    one = T.particles(spark, d).withColumn("oct1", G.octant(point, (0.5, 0.5, 0.5)))
    centres = [0.25 + 0.5 * F.shiftright("oct1", i).bitwiseAND(1) for i in range(3)]
    return one.withColumn("oct2", G.octant(point, centres)).rollup("oct1", "oct2").agg(F.count("*").alias("n"))


@query(f"""WITH {P_SQL}, b AS (SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM particles)
SELECT *, round((max_x - min_x) * (max_y - min_y) * (max_z - min_z), 9) AS fill_fraction, (max_x - min_x) * (max_y - min_y) * (max_z - min_z) < 0.8 AS poorly_filled FROM b""")
def bbox_fill_fraction(spark, d):
    box = spatial.fill_fraction(spatial.bounding_box(T.particles(spark, d)), (0, 0, 0), (1, 1, 1))
    return box.withColumn("fill_fraction", r(F.col("fill_fraction")))


@query(f"""WITH {P_SQL} SELECT particle_id,
  round(greatest(0, 0.25 - x, x - 0.5) ** 2 + greatest(0, 0.25 - y, y - 0.5) ** 2 + greatest(0, 0.25 - z, z - 0.5) ** 2, 9) AS d2,
  x BETWEEN 0.25 AND 0.5 AND y BETWEEN 0.25 AND 0.5 AND z BETWEEN 0.25 AND 0.5 AS inside FROM particles""")
def point_to_box_distance(spark, d):
    point, low, high = [F.col(a) for a in "xyz"], (0.25,) * 3, (0.5,) * 3
    return T.particles(spark, d).select("particle_id", r(G.distance_to_box_squared(point, low, high)).alias("d2"), G.inside(point, low, high).alias("inside"))


@query(f"""WITH {P_SQL}, b AS (SELECT min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_, min(z) AS az, max(z) AS bz FROM particles)
SELECT CASE WHEN n & 1 = 0 THEN ax ELSE bx END AS cx, CASE WHEN n & 2 = 0 THEN ay ELSE by_ END AS cy, CASE WHEN n & 4 = 0 THEN az ELSE bz END AS cz FROM range(8) t(n), b""")
def box_corners(spark, d):
    """The corners of the box around all particles."""
    box = spatial.bounding_box(T.particles(spark, d)).first()  # one row
    low, high = (tuple(box[f"{k}_{a}"] for a in "xyz") for k in ("min", "max"))
    return spark.createDataFrame([tuple(map(float, c)) for c in G.corners(low, high)], "cx double, cy double, cz double")


# ---- adjacency from edges

_EDGES = """edges AS (SELECT l_partkey AS id1, l_suppkey AS id2, l_extendedprice AS area, l_discount AS nx, l_tax AS ny, l_quantity AS nz,
  (CASE WHEN l_linenumber = 7 THEN -1 ELSE ((l_linenumber * 5 + l_quantity::BIGINT) % 16)::INT END) AS bits FROM lineitem),
good AS (SELECT *, bits & 1 AS p1, (bits >> 2) & 1 AS p2 FROM edges
  WHERE bits <> -1 AND (bits >> 1) & 1 = 0 AND (bits >> 3) & 1 = 0 AND NOT (bits & 1 = 1 AND (bits >> 2) & 1 = 1))"""


def _edges(spark, d):
    line = T.table(spark, d, "lineitem")
    bits = F.when(F.col("l_linenumber") == 7, -1).otherwise((F.col("l_linenumber") * 5 + F.col("l_quantity").cast("long")) % 16).cast("int")
    return line.select(
        F.col("l_partkey").alias("id1"), F.col("l_suppkey").alias("id2"), F.col("l_extendedprice").alias("area"), F.col("l_discount").alias("nx"), F.col("l_tax").alias("ny"), F.col("l_quantity").alias("nz"), bits.alias("connection_type")
    )


@query(f"WITH {_EDGES} SELECT p1 = 1 AS periodic1, p2 = 1 AS periodic2, count(*) AS n, round(sum(area), 3) AS area FROM good GROUP BY 1, 2")
def connection_type_decode(spark, d):
    kept = scan.decode_connections(_edges(spark, d))
    return kept.groupBy("periodic1", "periodic2").agg(F.count("*").alias("n"), r(F.sum("area"), 3).alias("area"))


@query(f"""WITH {_EDGES}, known AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 3 = 0)
SELECT count(*) AS n, round(sum(area), 3) AS area FROM good WHERE id1 IN (SELECT id FROM known) OR id2 IN (SELECT id FROM known)""")
def known_endpoint_semijoin(spark, d):
    edges = scan.decode_connections(_edges(spark, d))
    known = T.table(spark, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("external_id"), F.col("p_partkey").alias("cell_id"))
    return grid.with_known_end(edges, known).agg(F.count("*").alias("n"), r(F.sum("area"), 3).alias("area"))


@query(f"""WITH {_EDGES}, ids AS (SELECT p_partkey AS id, p_partkey + 1000000 AS cell FROM part WHERE p_partkey % 3 = 0),
j AS (SELECT g.*, a.cell AS c1, b.cell AS c2 FROM good g LEFT JOIN ids a ON g.id1 = a.id LEFT JOIN ids b ON g.id2 = b.id),
s AS (SELECT c1 AS cell_id, c2 AS neighbour_id, area, -nx AS nx, p1 + p2 AS p FROM j WHERE c1 IS NOT NULL
      UNION ALL SELECT c2, c1, area, nx, p1 + p2 FROM j WHERE c2 IS NOT NULL)
SELECT cell_id, CASE WHEN p > 0 THEN 'periodic' ELSE 'interior' END AS kind, count(*) AS n, count(neighbour_id) AS known, round(sum(area), 3) AS area, round(sum(nx), 6) AS nx
FROM s GROUP BY 1, 2""")
def symmetrize_edges(spark, d):
    ids = T.table(spark, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("external_id"), (F.col("p_partkey") + 1000000).alias("cell_id"))
    faces = grid.adjacency_of_edges(scan.decode_connections(_edges(spark, d)), ids)
    return faces.groupBy("cell_id", "kind").agg(F.count("*").alias("n"), F.count("neighbour_id").alias("known"), r(F.sum("area"), 3).alias("area"), r(F.sum("nx"), 6).alias("nx"))


@query("""WITH pairs AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem),
lone AS (SELECT a, b FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.a = p.b AND q.b = p.a))
SELECT a, b, 'reverse' AS missing FROM lone UNION ALL SELECT b, a, 'forward' FROM lone""")
def dependency_symmetric_diff(spark, d):
    faces = T.table(spark, d, "lineitem").select(F.col("l_partkey").alias("cell_id"), F.col("l_suppkey").alias("neighbour_id"), F.lit("interior").alias("kind"))
    return grid.asymmetric_pairs(faces)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def halo_antijoin(spark, d):
    sent = T.table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return T.table(spark, d, "customer").select("c_custkey").join(sent, "c_custkey", "left_anti")


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN a.doc_id IS NULL THEN 'inserted' WHEN b.doc_id IS NULL THEN 'deleted'
  WHEN a.n_chars % 2 = b.quality THEN 'unchanged' ELSE 'updated' END AS status FROM documents a FULL JOIN labels b USING (doc_id)) GROUP BY 1""")
def sync_full_outer(spark, d):
    old = T.table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("v"))
    new = T.table(spark, d, "labels").select("doc_id", F.col("quality").alias("v"))
    return metrics.synchronise(old, new, "doc_id", "v").groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey AS id, s_acctbal AS val FROM supplier
UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def map_extend(spark, d):
    old = T.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("val"))
    new = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("val"))
    return metrics.extend(old, new, "id")


# ---- spatial


_NEAR = """near AS (SELECT q.{q} AS q, arg_min(s.{s}, (sqrt((q.x - s.x) ** 2 + (q.y - s.y) ** 2 + (q.z - s.z) ** 2), s.{s})) AS s,
  min(sqrt((q.x - s.x) ** 2 + (q.y - s.y) ** 2 + (q.z - s.z) ** 2)) AS dist FROM {a} q, {b} s GROUP BY 1)"""
_CELL_POINTS = "points AS (SELECT cell_id, (ix + 0.5::DOUBLE) / 10 AS x, (iy + 0.5::DOUBLE) / 10 AS y, (iz + 0.5::DOUBLE) / (SELECT max(iz) + 1 FROM cells) AS z FROM cells)"


def _cell_points(spark, d):
    cells = T.cells(spark, d)
    height = cells.agg((F.max("iz") + 1).alias("height"))
    half = F.lit(0.5)
    return cells.crossJoin(F.broadcast(height)).select(
        "cell_id", ((F.col("ix") + half) / 10).alias("x"), ((F.col("iy") + half) / 10).alias("y"), ((F.col("iz") + half) / F.col("height")).alias("z")
    )


@query(f"WITH {S_SQL}, {C_SQL}, {_CELL_POINTS}, {_NEAR.format(q='source_id', s='cell_id', a='stars', b='points')} SELECT near.s AS cell_id, round(sum(rate), 6) AS source, count(*) AS n_sources FROM near JOIN stars ON q = source_id GROUP BY 1")
def nearest_source_sum(spark, d):
    out = spatial.sum_at_nearest(T.stars(spark, d), _cell_points(spark, d), "source_id", "cell_id")
    return out.select("cell_id", r(F.col("source"), 6).alias("source"), "n_sources")


@query(f"WITH {S_SQL} SELECT round(sum(rate), 6) AS total, count(*) AS n_sources FROM stars")
def source_luminosity(spark, d):
    return metrics.luminosity(T.stars(spark, d)).select(r(F.col("total"), 6).alias("total"), "n_sources")


@query(f"""WITH {V_SQL}, a AS (SELECT * FROM vectors WHERE vec_id % 2 = 0), b AS (SELECT * FROM vectors WHERE vec_id % 2 = 1),
{_NEAR.format(q='vec_id', s='vec_id', a='a', b='b')}
SELECT q AS vec_id, greatest(a.label, b.label) AS label FROM near JOIN a ON near.q = a.vec_id JOIN b ON near.s = b.vec_id""")
def remap_nearest_max(spark, d):
    v = T.vectors(spark, d)
    old = v.where("vec_id % 2 = 1").withColumnRenamed("vec_id", "old_id")
    return spatial.remap(v.where("vec_id % 2 = 0"), old, "vec_id", "old_id", ["label"]).select("vec_id", "label")


@query(f"WITH {V_SQL}, a AS (SELECT * FROM vectors WHERE vec_id % 5 = 0), b AS (SELECT * FROM vectors WHERE vec_id % 5 <> 0), {_NEAR.format(q='vec_id', s='vec_id', a='a', b='b')} SELECT q AS vec_id, s AS generator_id, round(dist, 9) AS dist FROM near")
def voronoi_containment(spark, d):
    v = T.vectors(spark, d)
    out = V.containing_cell(v.where("vec_id % 5 = 0"), v.where("vec_id % 5 <> 0").withColumnRenamed("vec_id", "generator_id"), "vec_id", "generator_id")
    return out.withColumn("dist", r(F.col("dist")))


@query(f"""WITH {V_SQL} SELECT a.vec_id, count(*) AS n, round(sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)), 6) AS total
FROM vectors a JOIN vectors b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) < 0.3 GROUP BY 1""")
def radius_neighbour_count(spark, d):
    v = T.vectors(spark, d).drop("label")
    return neighbours.counted_within(v, v, "vec_id", F.lit(0.3), total=True).select("vec_id", "n", r(F.col("total"), 6).alias("total"))


@query(f"""WITH {S_SQL}, d AS (SELECT a.source_id AS i, b.source_id AS j, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz FROM stars a, stars b),
m AS (SELECT i, j, sqrt((dx - round(dx)) ** 2 + (dy - round(dy)) ** 2 + (dz - round(dz)) ** 2) AS dist FROM d)
SELECT i, count(*) AS n FROM m WHERE dist < 0.2 GROUP BY i""")
def periodic_radius_count(spark, d):
    s = T.stars(spark, d).drop("rate")
    return neighbours.counted_within(s, s, "source_id", F.lit(0.2), (1.0, 1.0, 1.0)).select(F.col("source_id").alias("i"), "n")


@query(f"""WITH {P_SQL}, c AS (SELECT quantile_disc(x, [0.25, 0.5, 0.75]) AS cuts FROM particles),
o AS (SELECT len(list_filter(cuts, lambda q: q <= x)) AS part, x, y FROM particles, c)
SELECT part, count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM o GROUP BY 1""")
def range_partition_boxes(spark, d):
    p = T.particles(spark, d)
    owned = p.withColumn("part", spatial.owner_of(F.col("x"), spatial.range_cuts(p, "x", 4)).cast("long"))
    return spatial.partition_boxes(owned, "part", ("x", "y"), n=F.count("*"))


@query(f"""WITH {P_SQL}, c AS (SELECT quantile_disc(x, [0.25, 0.5, 0.75]) AS cuts FROM particles),
o AS (SELECT len(list_filter(cuts, lambda q: q <= x)) AS part, count(*) AS n FROM particles, c GROUP BY 1)
SELECT max(n) AS max_load, min(n) AS min_load, round((max(n) - min(n)) / max(n), 9) AS imbalance FROM o""")
def load_imbalance(spark, d):
    p = T.particles(spark, d)
    owned = p.withColumn("part", spatial.owner_of(F.col("x"), spatial.range_cuts(p, "x", 4)))
    return spatial.imbalance(owned, "part").withColumn("imbalance", r(F.col("imbalance")))


@query()
def peano_order(spark, d):
    return K.with_key(T.particles(spark, d).select("particle_id", "x", "y", "z"), (0.0, 0.0, 0.0), 1.0)


@query()
def voronoi_cells(spark, d):
    points = T.vectors(spark, d).select(F.col("vec_id").alias("particle_id"), "x", "y", "z")
    return V.voronoi_cells(points, (-6.0,) * 3, (6.0,) * 3).select("cell_id", "volume", "size", "infinite", F.size("faces").alias("n_faces"))


# ---- directions and faces

_DIRS = [(1.0, 0.0, 0.0), (1.0, 1.0, 0.0), (1.0, 1.0, 1.0), (-1.0, 2.0, 0.5), (0.0, 0.0, -1.0)]
_DIR_SQL = "dirs AS (SELECT dir, a / sqrt(a * a + b * b + c * c) AS dx, b / sqrt(a * a + b * b + c * c) AS dy, c / sqrt(a * a + b * b + c * c) AS dz FROM (VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for i, (a, b, c) in enumerate(_DIRS)) + ") t(dir, a, b, c))"
_FACE_SQL = """n AS (SELECT max(iz) + 1 AS nz FROM cells),
s AS (SELECT * FROM (VALUES (0, -1), (0, 1), (1, -1), (1, 1), (2, -1), (2, 1)) t(axis, sgn)),
faces AS (SELECT cell_id, axis, sgn, CASE WHEN c + sgn < 0 OR c + sgn >= m THEN NULL ELSE cell_id + sgn * stride END AS neighbour_id,
  1.0::DOUBLE AS area, CASE WHEN axis = 0 THEN sgn ELSE 0 END AS nx, CASE WHEN axis = 1 THEN sgn ELSE 0 END AS ny, CASE WHEN axis = 2 THEN sgn ELSE 0 END AS nz
  FROM (SELECT cell_id, axis, sgn, CASE axis WHEN 0 THEN ix WHEN 1 THEN iy ELSE iz END AS c, CASE axis WHEN 2 THEN nz ELSE 10 END AS m,
        CASE axis WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 100 END AS stride FROM cells, n, s))"""


def _grid(spark, d):
    cells = T.cells(spark, d)
    height = cells.agg(F.max("iz")).first()[0] + 1
    return cells, grid.cartesian_faces(cells, (10, 10, height)), grid.directions(spark, _DIRS)


@query(f"WITH {C_SQL}, {_FACE_SQL} SELECT CASE WHEN neighbour_id IS NULL THEN 'boundary' ELSE 'interior' END AS kind, axis, sgn, count(*) AS n, sum(neighbour_id - cell_id)::BIGINT AS offsets FROM faces GROUP BY ALL")
def cartesian_faces(spark, d):
    _, faces, _ = _grid(spark, d)
    axis = F.when(F.col("nx") != 0, 0).when(F.col("ny") != 0, 1).otherwise(2)
    sgn = (F.col("nx") + F.col("ny") + F.col("nz")).cast("int")
    return faces.groupBy("kind", axis.alias("axis"), sgn.alias("sgn")).agg(F.count("*").alias("n"), F.sum(F.col("neighbour_id") - F.col("cell_id")).alias("offsets"))


@query(f"""WITH {C_SQL}, {_FACE_SQL}, {_DIR_SQL}, w AS (SELECT cell_id, neighbour_id, dir, area * (nx * dx + ny * dy + nz * dz) AS e FROM faces, dirs WHERE nx * dx + ny * dy + nz * dz > 0)
SELECT cell_id, dir, neighbour_id, round(e, 9) AS effective, round(e / sum(e) OVER (PARTITION BY cell_id, dir), 9) AS share FROM w""")
def effective_area_share(spark, d):
    _, faces, dirs = _grid(spark, d)
    out = grid.downwind(faces, dirs)
    return out.select("cell_id", "dir", "neighbour_id", r(F.col("effective")).alias("effective"), r(F.col("share")).alias("share"))


@query(f"WITH {C_SQL}, {_FACE_SQL}, {_DIR_SQL} SELECT cell_id, dir, count(*) AS n FROM faces, dirs WHERE neighbour_id IS NOT NULL AND nx * dx + ny * dy + nz * dz < 0 GROUP BY 1, 2")
def upwind_indegree(spark, d):
    _, faces, dirs = _grid(spark, d)
    return grid.upwind_count(faces, dirs)


@query(f"""WITH {V_SQL}, {_DIR_SQL}, c AS (SELECT vec_id, dir, (x * dx + y * dy + z * dz) / sqrt(x * x + y * y + z * z) AS cos FROM vectors, dirs)
SELECT vec_id, max(struct_pack(c := round(cos, 9), d := dir)).d AS dir FROM c GROUP BY 1""")
def aligned_direction(spark, d):
    v = T.vectors(spark, d)
    unit = dict(zip(("dx", "dy", "dz"), G.normalised([F.col(a) for a in "xyz"]), strict=True))
    old = v.select(F.col("vec_id").alias("dir"), *(c.alias(n) for n, c in unit.items()))
    return sweep.aligned(old, grid.directions(spark, _DIRS), 9).select(F.col("dir").alias("vec_id"), F.col("to").alias("dir"))


# ---- aggregates


@query(f"""WITH {P_SQL} SELECT round(sum(m * xhii) / sum(m), 9) AS xhii_mass_average, round(sum(volume * xhii) / sum(volume), 9) AS xhii_volume_average,
round(sum(m * temperature) / sum(m), 6) AS temperature_mass_average, round(sum(volume * temperature) / sum(volume), 6) AS temperature_volume_average,
round(sum(1e-3 * y * volume) / sum(volume), 9) AS rate_volume_average, round(sum(1e-3 * y * xhii * volume) / sum(volume), 9) AS rate_ionized_average
FROM (SELECT *, density * volume AS m FROM particles)""")
def weighted_averages(spark, d):
    cells = T.particles(spark, d).withColumns({"mass": F.col("density") * F.col("volume"), "photoionization_rate": F.col("y") * 1e-3})
    out = metrics.averages(cells)
    return out.select(*(r(F.col(c), 6 if c.startswith("temperature") else 9).alias(c) for c in out.columns))


_LEVEL = f"greatest(least(coalesce(ceil(log2({T.MAX_STEP} / nullif(o_totalprice, 0))), {T.N_LEVELS - 1}), {T.N_LEVELS - 1}), 0)::INT"


@query(f"SELECT o_orderkey, {_LEVEL} AS level, {T.MAX_STEP} * 0.5 ** ({_LEVEL}) AS step FROM orders")
def level_assignment(spark, d):
    o = T.table(spark, d, "orders").withColumn("level", levels.level_of(F.col("o_totalprice"), T.MAX_STEP, T.N_LEVELS))
    return o.select("o_orderkey", "level", levels.step_of(F.col("level"), T.MAX_STEP).alias("step"))


@query(f"""WITH c AS (SELECT {_LEVEL} AS level, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT i::INT AS level, coalesce(n, 0) AS n FROM range({T.N_LEVELS}) t(i) LEFT JOIN c ON i = level)
SELECT level, n, sum(n) OVER (ORDER BY level DESC)::BIGINT AS active FROM e""")
def active_per_level(spark, d):
    o = T.table(spark, d, "orders").select(levels.level_of(F.col("o_totalprice"), T.MAX_STEP, T.N_LEVELS).alias("level"))
    return levels.active_per_level(o, T.N_LEVELS)


@query("SELECT c_custkey % 16 AS i, (4 - CASE WHEN c_custkey % 16 = 0 THEN 4 ELSE bit_count((c_custkey % 16 & -(c_custkey % 16)) - 1) END)::INT AS level, count(*) AS n FROM customer GROUP BY ALL")
def level_schedule(spark, d):
    """The level at which each iteration runs, and how many customers are served in it."""
    i = (F.col("c_custkey") % 16).alias("i")
    return T.table(spark, d, "customer").groupBy(i).agg(F.count("*").alias("n")).select("i", levels.level_at(5, F.col("i")).alias("level"), "n")


@query(f"""WITH {C_SQL}, {_FACE_SQL}, l AS (SELECT cell_id, (cell_id * 7 % 5)::INT AS level FROM cells)
SELECT f.cell_id, max(l.level) AS highest, count(*) AS n FROM faces f JOIN l ON f.neighbour_id = l.cell_id GROUP BY 1""")
def neighbour_levels(spark, d):
    cells, faces, _ = _grid(spark, d)
    leveled = cells.withColumn("level", (F.col("cell_id") * 7 % 5).cast("int"))
    return levels.neighbour_levels(faces, leveled).groupBy("cell_id").agg(F.max("neighbour_level").alias("highest"), F.count("*").alias("n"))


@query(f"""WITH {P_SQL}, t AS (SELECT temperature / 100 AS a, volume * 4 AS b, xhii * 30 AS c FROM particles),
m AS (SELECT CASE WHEN (CASE WHEN a < b THEN a ELSE b END) < c THEN (CASE WHEN a < b THEN a ELSE b END) ELSE c END AS time,
  CASE WHEN (CASE WHEN a < b THEN a ELSE b END) < c THEN (CASE WHEN a < b THEN 'temperature' ELSE 'fraction' END) ELSE 'rate' END AS process FROM t),
g AS (SELECT process, count(*) AS n FROM m WHERE time < 15 GROUP BY 1)
SELECT process, n, round(n * 100.0 / sum(n) OVER (), 9) AS percent FROM g""")
def limiting_process_histogram(spark, d):
    best = metrics.arg_min([("temperature", F.col("temperature") / 100), ("fraction", F.col("volume") * 4), ("rate", F.col("xhii") * 30)])
    steps = T.particles(spark, d).select(best.alias("b")).select("b.*")
    return metrics.limiting_processes(steps, 15.0).withColumn("percent", r(F.col("percent")))


@query("SELECT event_type, round(avg(value), 9) AS average, round(sum(value), 4) AS total, count(value) AS num_calls FROM events GROUP BY 1")
def performance_stats(spark, d):
    out = metrics.runtime_statistics(T.table(spark, d, "events"), "event_type", "value")
    return out.select("event_type", r(F.col("average")).alias("average"), r(F.col("total"), 4).alias("total"), "num_calls")


@query(f"""WITH {C_SQL}, {_FACE_SQL}, v AS (SELECT cell_id, sum(area * 0.5 / 3) AS volume, count(*) AS n FROM faces GROUP BY 1)
SELECT iz, round(sum(volume), 9) AS volume, sum(n)::BIGINT AS pyramids, count(DISTINCT ix) AS columns FROM v JOIN cells USING (cell_id) GROUP BY 1""")
def distinct_and_volume(spark, d):
    cells, faces, _ = _grid(spark, d)
    volumes = grid.volume_of_faces(faces.withColumn("height", F.lit(0.5)))
    out = cells.join(volumes, "cell_id").groupBy("iz")
    return out.agg(r(F.sum("volume")).alias("volume"), F.sum("n_faces").alias("pyramids"), F.count_distinct("ix").alias("columns"))


# ---- windows


@query("SELECT user_id, min(epoch_us(ts)) FILTER (value > 50) AS first_time FROM events GROUP BY 1")
def first_crossing_time(spark, d):
    e = T.table(spark, d, "events").select("user_id", "value", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("t"))
    return metrics.first_crossing(e, "user_id", "t", "value", 50.0)


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value_floor FROM events")
def monotone_floor(spark, d):
    return metrics.monotone_floor(T.table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "value_floor")


@query("""WITH e AS (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
SELECT event_id, previous, round(least(coalesce(abs(abs(value - coalesce(previous, 0)) / nullif(value, 0)), 4503599627370496.0), 4503599627370496.0), 6) AS change FROM e""")
def change_vs_previous(spark, d):
    out = metrics.change_from_previous(T.table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")
    return out.select("event_id", "previous", r(F.col("change"), 6).alias("change"))


@query("SELECT p_partkey, coalesce(lead(p_partkey) OVER w, first_value(p_partkey) OVER w) AS next FROM part WINDOW w AS (PARTITION BY p_size ORDER BY p_partkey)")
def cyclic_pairs(spark, d):
    return metrics.cyclic_pairs(T.table(spark, d, "part").select("p_partkey", "p_size"), "p_size", "p_partkey", "p_partkey").select("p_partkey", "next")


@query("SELECT p_partkey, coalesce(sum(p_size) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prefix FROM part")
def exclusive_prefix(spark, d):
    return metrics.exclusive_prefix(T.table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey", "p_size", 256).select("p_partkey", "prefix")


@query(f"WITH {C_SQL} SELECT cell_id, round(src * exp(-coalesce(sum(tau) OVER (PARTITION BY ix, iy ORDER BY iz ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 6) AS reaching FROM cells")
def axis_sweep_attenuation(spark, d):
    out = metrics.attenuated_along(T.cells(spark, d), ["ix", "iy"], "iz", "tau")
    return out.select("cell_id", r(F.col("src") * F.col("transmission"), 6).alias("reaching"))


# ---- sweeps

_WAVES = """RECURSIVE {cells}, n AS (SELECT max(iz) + 1 AS nz FROM cells),
w(k, cell_id, ix, iy, iz, incoming, outgoing) AS (
  SELECT 0::BIGINT, cell_id, ix, iy, iz, 0.0::DOUBLE, src * exp(-tau) FROM cells WHERE ix + iy + iz = 0
  UNION ALL
  SELECT u.k + 1, c.cell_id, c.ix, c.iy, c.iz, u.got, (u.got + c.src) * exp(-c.tau)
  FROM (SELECT k, i, j, l, sum(part) AS got FROM (
          SELECT k, ix + a AS i, iy + b AS j, iz + c AS l, outgoing / 3 AS part FROM w, (VALUES (1, 0, 0), (0, 1, 0), (0, 0, 1)) s(a, b, c)) GROUP BY 1, 2, 3, 4) u
  JOIN cells c ON c.ix = u.i AND c.iy = u.j AND c.iz = u.l)"""


def _diagonal(spark, d):
    cells, faces, _ = _grid(spark, d)
    dirs = grid.directions(spark, [(1.0, 1.0, 1.0)])
    state = cells.select("cell_id", "tau", F.col("src").alias("source"))
    return state, faces, dirs


@query(f"WITH {_WAVES.format(cells=C_SQL)} SELECT cell_id, round(incoming, 6) AS incoming, round(outgoing, 6) AS outgoing FROM w")
def diagonal_sweep(spark, d):
    state, faces, dirs = _diagonal(spark, d)
    out = sweep.sweep(state, faces, dirs)
    return out.select("cell_id", r(F.col("incoming"), 6).alias("incoming"), r(F.col("outgoing"), 6).alias("outgoing"))


@query(f"""WITH {_WAVES.format(cells=C_SQL)}, f AS (SELECT outgoing * (CASE WHEN ix = 9 THEN 1 ELSE 0 END + CASE WHEN iy = 9 THEN 1 ELSE 0 END + CASE WHEN iz = nz - 1 THEN 1 ELSE 0 END) / 3 AS out FROM w, n)
SELECT round((SELECT sum(src) FROM cells), 3) AS emitted, round((SELECT sum(incoming + src - outgoing) FROM w JOIN cells USING (cell_id)), 3) AS absorbed, round((SELECT sum(out) FROM f), 3) AS escaped""")
def sweep_conservation(spark, d):
    state, faces, dirs = _diagonal(spark, d)
    out = sweep.conservation(sweep.sweep(state, faces, dirs), state, faces, dirs)
    return out.select(*(r(F.col(c), 3).alias(c) for c in ("emitted", "absorbed", "escaped")))


@query()
def directional_photon_rate(spark, d):
    cells, faces, _ = _grid(spark, d)
    state = cells.select("cell_id", "tau", F.col("src").alias("source"))
    out = sweep.photon_rate(sweep.sweep(state, faces, grid.directions(spark, 16)))
    return out.select("cell_id", r(F.col("rate"), 6).alias("rate"))


# ---- physics


def _digits(c, digits: int = 9):
    """Rounded to significant digits, as rates are tiny numbers."""
    return F.round(F.log10(F.abs(c)), digits)


def _sig(sql: str) -> str:
    return f"round(log10(abs({sql})), 9)"


_FIT = "(sqrt(temperature) / (1 + sqrt(temperature / 1e5)) * exp(-157809.1 / temperature))"
_REC = "(1e-6 * 2.753e-14 * (315614 / temperature) ** 1.5 / (1 + (315614 / temperature / 2.74) ** 0.407) ** 2.242)"
_RECC = "(1e-13 * 3.435e-30 * temperature * (315614 / temperature) ** 1.97 / (1 + (315614 / temperature / 2.25) ** 0.376) ** 3.72)"
_EXC = "(1e-13 * 7.5e-19 / (1 + sqrt(temperature / 1e5)) * exp(-118348 / temperature))"
_BREMS = "(1e-13 * 1.42e-27 * sqrt(temperature))"
_NH = f"(density * 1e-20 / {U.PROTON_MASS!r})"
_COMPTON = "(1e-7 * 1.017e-37 * 2.727 ** 4 * (temperature - 2.727))"


@query(f"""WITH {P_SQL} SELECT particle_id, {_sig(_REC)} AS alpha, {_sig(f'1e-6 * 5.85e-11 * {_FIT}')} AS beta, {_sig(_RECC)} AS recombination, {_sig(_EXC)} AS excitation, {_sig(_BREMS)} AS bremsstrahlung
FROM (SELECT particle_id, temperature * 10 AS temperature FROM particles)""")
def recombination_rates(spark, d):
    t = F.col("temperature") * 10
    return T.particles(spark, d).select(
        "particle_id",
        _digits(P.recombination(t)).alias("alpha"),
        _digits(P.collisional_ionization(t)).alias("beta"),
        _digits(P.recombination_cooling(t)).alias("recombination"),
        _digits(P.collisional_excitation_cooling(t)).alias("excitation"),
        _digits(P.bremsstrahlung_cooling(t)).alias("bremsstrahlung"),
    )


@query(f"""WITH {P_SQL}, q AS (SELECT particle_id, temperature * 10 AS temperature, density, 0.005 + 0.99 * xhii AS x FROM particles)
SELECT particle_id, {_sig(f'(({_EXC} + 1e-13 * 1.27e-21 * {_FIT}) * {_NH} * x * {_NH} * (1 - x) + ({_RECC} + {_BREMS}) * {_NH} * x * {_NH} * x + {_COMPTON} * {_NH} * x)')} AS cooling FROM q""")
def cooling_rates(spark, d):
    x = 0.005 + 0.99 * F.col("xhii")
    return T.particles(spark, d).select("particle_id", _digits(P.cooling(F.col("temperature") * 10, F.col("density") * 1e-20, x, F.lit(1.0))).alias("cooling"))


_SIZE, _STEP, _RATE = 1e18, 1e9, 1e48


@query(f"""WITH {P_SQL}, q AS (SELECT particle_id, {_NH} * (1 - (0.005 + 0.99 * xhii)) AS n FROM particles)
SELECT particle_id, round(exp(-n * {U.SIGMA_NUMBER!r} * {_SIZE}), 9) AS transmitted, {_sig(f'{_RATE} * (1 - exp(-n * {U.SIGMA_NUMBER!r} * {_SIZE})) / (n * {_SIZE} ** 3)')} AS rate,
{_sig(f'{_RATE} * (1 - exp(-n * {U.SIGMA_NUMBER!r} * {_SIZE})) / {_SIZE} ** 3 * {U.PHOTON_ENERGY - U.RYDBERG!r}')} AS heating FROM q""")
def photoheating(spark, d):
    rho, x = F.col("density") * 1e-20, 0.005 + 0.99 * F.col("xhii")
    args = (F.lit(_RATE), rho, x, F.lit(_SIZE), F.lit(_SIZE**3), F.lit(_STEP))
    return T.particles(spark, d).select(
        "particle_id", r(P.transmitted(rho, x, F.lit(_SIZE))).alias("transmitted"), _digits(P.photoionization(*args)).alias("rate"), _digits(P.photoheating(*args)).alias("heating")
    )


@query(f"""WITH {P_SQL}, q AS (SELECT particle_id, temperature * 10 AS temperature, density, 0.005 + 0.99 * xhii AS x FROM particles),
a AS (SELECT *, {_NH} AS nh, {_NH} * x AS ne, {_NH} * (1 - x) AS n, 1 / (1 + x) AS mu, sqrt(temperature / 1e5) AS s, {_FIT} AS fit, {_REC} AS rec, {_RECC} AS recc, {_EXC} AS exc, {_BREMS} AS brems,
  (315614 / temperature / 2.74) ** 0.407 AS y1, (315614 / temperature / 2.25) ** 0.376 AS y2 FROM q),
b AS (SELECT *, fit * (0.5 / temperature - 0.5 * s / (temperature * (1 + s)) + 157809.1 / temperature ** 2) AS dfit, rec / temperature * (2.242 * 0.407 * y1 / (1 + y1) - 1.5) AS drec,
  recc / temperature * (3.72 * 0.376 * y2 / (1 + y2) - 0.97) AS drecc, exc * (118348 / temperature ** 2 - 0.5 * s / (temperature * (1 + s))) AS dexc, brems / (2 * temperature) AS dbrems,
  1e40 * (1 - exp(-n * {U.SIGMA_NUMBER!r} * {_SIZE})) / {_SIZE} ** 3 AS absorbed, {(U.GAMMA - 1) * U.PROTON_MASS / U.BOLTZMANN!r} / (density * 1e-20) * mu AS k FROM a),
c AS (SELECT *, absorbed * {U.PHOTON_ENERGY - U.RYDBERG!r} - ((exc + 1e-13 * 1.27e-21 * fit) * ne * n + (recc + brems) * ne * nh * x + {_COMPTON} * ne) AS heat,
  (dexc + 1e-13 * 1.27e-21 * dfit) * ne * n + (drecc + dbrems) * ne * nh * x + 1e-7 * 1.017e-37 * 2.727 ** 4 * ne AS dcool,
  1e-6 * 5.85e-11 * fit AS beta, 1e-6 * 5.85e-11 * dfit AS dbeta FROM b),
d AS (SELECT *, beta * ne + absorbed / n AS c, rec * ne AS e, nh * beta - ne * temperature * mu * 0.76 * dbeta AS dc, nh * rec - ne * temperature * mu * 0.76 * drec AS de FROM c)
SELECT particle_id, round(log10(abs(k * heat * 1e6 / (1 + k * dcool * 1e6))), 7) AS dt, round(log10(abs(1e6 * (c - x * (c + e)) / (1 - (dc - (c + e) - x * (dc + de)) * 1e6))), 7) AS dx FROM d""")
def semi_implicit_step(spark, d):
    t, rho, x = F.col("temperature") * 10, F.col("density") * 1e-20, 0.005 + 0.99 * F.col("xhii")
    size, volume, rate, dt = F.lit(_SIZE), F.lit(_SIZE**3), F.lit(1e40), F.lit(1e6)
    return T.particles(spark, d).select(
        "particle_id",
        _digits(P.temperature_change(t, x, rho, rate, size, volume, F.lit(1.0), dt), 7).alias("dt"),
        _digits(P.fraction_change(t, x, rho, rate, size, volume, dt), 7).alias("dx"),
    )


@query()
def chemistry_adaptive(spark, d):
    cells = T.particles(spark, d).select(
        "particle_id",
        (F.col("temperature") * 10).alias("temperature"),
        P.clamp_fraction(F.col("xhii")).alias("xhii"),
        (F.col("density") * 1e-20).alias("density"),
        (F.col("y") * 1e44).alias("rate"),
        F.lit(1e18).alias("size"),
        F.lit(1e54).alias("volume"),
    )
    return solver.evolve(cells, 1e10)


_AGE = f"2 / (3 * sqrt(0.6911::DOUBLE)) * ln(sqrt(0.6911::DOUBLE / 0.308983 * a ** 3) + sqrt(1 + 0.6911::DOUBLE / 0.308983 * a ** 3)) / ({U.HUBBLE!r} * 0.6774) / 3.15576e16"


@query(f"SELECT o_orderkey, round(1 / a - 1, 9) AS redshift, round({_AGE}, 9) AS age FROM (SELECT o_orderkey, 0.05 + o_totalprice / 600000 AS a FROM orders)")
def cosmic_age(spark, d):
    a = 0.05 + F.col("o_totalprice") / 600000
    age = metrics.age(a, U.Cosmology()) / 3.15576e16
    return T.table(spark, d, "orders").select("o_orderkey", r(1 / a - 1).alias("redshift"), r(age).alias("age"))


_XS, _YS = [0.0, 0.1, 0.3, 0.6, 1.0], [0.0, 0.5, 0.8, 1.0]


@query(f"""WITH {P_SQL}, q AS (SELECT particle_id, least(x, 1 / 1.00001) AS x, least(y, 1 / 1.00001) AS y FROM particles),
b AS (SELECT *, {_XS}::DOUBLE[] AS xs, {_YS}::DOUBLE[] AS ys FROM q),
i AS (SELECT *, least(len(list_filter(xs, lambda e: e <= x)), 4) AS i, least(len(list_filter(ys, lambda e: e <= y)), 3) AS j FROM b),
f AS (SELECT *, (x - xs[i]) / (xs[i + 1] - xs[i]) AS fx, (y - ys[j]) / (ys[j + 1] - ys[j]) AS fy FROM i)
SELECT particle_id, round((1 - fy) * ((1 - fx) * (10.0 * (i - 1) ** 2 + (j - 1)) + fx * (10.0 * i ** 2 + (j - 1))) + fy * ((1 - fx) * (10.0 * (i - 1) ** 2 + j) + fx * (10.0 * i ** 2 + j)), 9) AS value FROM f""")
def bilinear_table_lookup(spark, d):
    table = spark.createDataFrame([(i, j, 10.0 * i * i + j) for i in range(5) for j in range(4)], "i int, j int, value double")
    out = metrics.interpolated(table, T.particles(spark, d).select("particle_id", "x", "y"), "x", "y", _XS, _YS)
    return out.select("particle_id", r(F.col("value")).alias("value"))


_AGES, _ZS = [0.0, 1.0, 3.0, 6.0, 14.0], [0.0, 0.3, 0.6, 1.0]
_AGE_OF = "2 / (3 * sqrt(0.6911::DOUBLE)) * asinh(sqrt(0.6911::DOUBLE / 0.308983 * {0} * {0} * {0})) / (3.2407789e-18 * 0.6774) / 3.15576e16"


@query(f"""WITH s AS (SELECT c_custkey, (c_custkey % 90 - 5) / 100.0::DOUBLE AS fa, (c_nationkey % 10) / 10.0::DOUBLE AS z, c_acctbal + 1000 AS mass FROM customer),
q AS (SELECT c_custkey, mass, {_AGE_OF.format('1.0::DOUBLE')} - {_AGE_OF.format('fa')} AS x, z AS y FROM s WHERE fa > 0),
b AS (SELECT c_custkey, mass, least(x, 14 / 1.00001) AS x, least(y, 1 / 1.00001) AS y, {_AGES}::DOUBLE[] AS xs, {_ZS}::DOUBLE[] AS ys FROM q),
i AS (SELECT *, least(len(list_filter(xs, lambda e: e <= x)), 4) AS i, least(len(list_filter(ys, lambda e: e <= y)), 3) AS j FROM b),
f AS (SELECT *, (x - xs[i]) / (xs[i + 1] - xs[i]) AS fx, (y - ys[j]) / (ys[j + 1] - ys[j]) AS fy FROM i)
SELECT c_custkey, round(0.2 * mass * ((1 - fy) * ((1 - fx) * (10.0 * (i - 1) ** 2 + (j - 1)) + fx * (10.0 * i ** 2 + (j - 1))) + fy * ((1 - fx) * (10.0 * (i - 1) ** 2 + j) + fx * (10.0 * i ** 2 + j))), 4) AS rate FROM f""")
def stellar_source_rates(spark, d):
    stars = T.table(spark, d, "customer").select(
        "c_custkey", ((F.col("c_custkey") % 90 - 5) / 100.0).alias("formation_a"), (F.col("c_nationkey") % 10 / 10.0).alias("metallicity"), (F.col("c_acctbal") + 1000).alias("mass")
    )
    table = spark.createDataFrame([(i, j, 10.0 * i * i + j) for i in range(5) for j in range(4)], "i int, j int, value double")
    gyr = 3.15576e16
    out = metrics.stellar_rates(stars, table, [a * gyr for a in _AGES], _ZS, U.Cosmology(), 0.2)
    return out.select("c_custkey", r(F.col("rate"), 4).alias("rate"))


@query(f"""WITH {P_SQL}, c AS (SELECT quantile_disc(x, [0.25, 0.5, 0.75]) AS cuts FROM particles),
o AS (SELECT len(list_filter(cuts, lambda q: q <= x)) AS part, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM particles, c GROUP BY 1), {S_SQL}
SELECT source_id, part FROM stars, o WHERE greatest(0, lx - x, x - hx) ** 2 + greatest(0, ly - y, y - hy) ** 2 <= 0.01""")
def search_sphere_owners(spark, d):
    p = T.particles(spark, d)
    owned = p.withColumn("part", spatial.owner_of(F.col("x"), spatial.range_cuts(p, "x", 4)).cast("long"))
    boxes = spatial.partition_boxes(owned, "part", ("x", "y"))
    return spatial.sphere_owners(T.stars(spark, d), boxes, 0.1, ("x", "y")).select("source_id", "part")


# ---- snapshots and streams


@query("SELECT (epoch_us(ts) - 1704067200000000) // 86400000000 AS snapshot, min(epoch_us(ts) - 1704067200000000) AS time FROM events WHERE epoch_us(ts) >= 1704067200000000 GROUP BY 1")
def snapshot_schedule(spark, d):
    e = T.table(spark, d, "events").select(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)").alias("time"))
    return S.schedule(e, 86400000000.0)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS begin, round(sum(value * (1 + user_id % 3)) / sum(1 + user_id % 3), 9) AS average, count(*) AS n FROM events GROUP BY 1")
def tumbling_metrics(spark, d):
    from ..streaming.metrics import windowed_averages

    e = T.table(spark, d, "events").withColumn("weight", 1 + F.col("user_id") % 3)
    return windowed_averages(e, "ts", "1 day", "value", "weight").withColumn("average", r(F.col("average")))


@query(f"WITH {P_SQL} SELECT particle_id, x, y, z, density, volume, temperature, xhii FROM particles")
def snapshot_static_dynamic_split(spark, d):
    p = T.particles(spark, d)
    static, dynamic = S.split_columns(p, "particle_id", ("x", "y", "z", "density", "volume"))
    return dynamic.join(static, "particle_id")


@query(f"WITH {P_SQL} SELECT round(avg(CASE WHEN x > 0.9 THEN 1 ELSE 0 END), 9) AS halo_fraction, avg(CASE WHEN x > 0.9 THEN 1 ELSE 0 END) > 0.05 AS warn FROM particles")
def halo_fraction(spark, d):
    out = metrics.halo_fraction(T.particles(spark, d).withColumn("halo", F.col("x") > 0.9), "halo")
    return out.withColumn("halo_fraction", r(F.col("halo_fraction")))


@query(f"WITH {S_SQL} SELECT source_id, row_number() OVER (PARTITION BY floor(x * 4) ORDER BY x, source_id) - 1 AS position FROM stars")
def ids_within_part(spark, d):
    w = Window.partitionBy(F.floor(F.col("x") * 4)).orderBy("x", "source_id")
    return T.stars(spark, d).select("source_id", (F.row_number().over(w) - 1).cast("long").alias("position"))


from . import domain_queries, row_queries  # noqa: E402, F401  register more queries
