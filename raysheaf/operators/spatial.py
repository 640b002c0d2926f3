"""Spatial joins as bucketed equality joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .decomposition import load_cuts
from .neighbours import dealt, nearest_join

AXES = ("x", "y", "z")


def bounding_box(df: DataFrame, axes: Sequence[str] = AXES) -> DataFrame:
    """One row min_<axis>, max_<axis> (null for no rows)."""
    return df.agg(*(f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))))


def fill_fraction(box: DataFrame, low: Sequence[float], high: Sequence[float], axes: Sequence[str] = AXES) -> DataFrame:
    """Share of the domain's volume that the bounding box fills; below 0.8 the domain is badly chosen."""
    share = F.lit(1.0)
    for a, lo, hi in zip(axes, low, high, strict=True):
        share = share * (F.col(f"max_{a}") - F.col(f"min_{a}")) / (hi - lo)
    return box.select("*", share.alias("fill_fraction"), (share < 0.8).alias("poorly_filled"))


def _around(df: DataFrame, buckets: Sequence[str]) -> DataFrame:
    """Each row once for each of the 3^d buckets around its own."""
    out = df
    for b in buckets:
        out = out.withColumn(b, F.explode(F.array(F.col(b) - 1, F.col(b), F.col(b) + 1)))
    return out


def radius_join(left: DataFrame, right: DataFrame, radius: float, sides: Sequence[float] | None = None, axes: Sequence[str] = AXES) -> DataFrame:
    """Pairs closer than ``radius`` (strictly): columns l_*, r_*, dist. Positions are in a box from 0; with ``sides`` it is periodic.

    Buckets are ``radius`` wide, so a point meets its own and its neighbours' bucket only. With a periodic box the buckets
    wrap; a side has to hold three of them. Crowded buckets are dealt out in blocks, see ``neighbours.dealt``.
    """
    names = [f"b{a}" for a in axes]
    if sides is None:
        width, counts = [radius] * len(axes), None
    else:
        counts = [int(s // radius) for s in sides]
        if min(counts) < 3:
            raise ValueError("a periodic side must be at least three radii long")
        width = [s / n for s, n in zip(sides, counts, strict=True)]
    put = {b: F.floor(F.col(a) / w).cast("long") for a, b, w in zip(axes, names, width, strict=True)}
    if counts:
        put = {b: F.pmod(c, F.lit(n)) for (b, c), n in zip(put.items(), counts, strict=True)}
    lhs = left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns), *(c.alias(b) for b, c in put.items()))
    rhs = _around(right.withColumns(put), names)
    if counts:
        rhs = rhs.withColumns({b: F.pmod(F.col(b), F.lit(n)) for b, n in zip(names, counts, strict=True)})
    rhs = rhs.select(*(F.col(c).alias(f"r_{c}") for c in right.columns), *names)
    a, b = [F.col(f"l_{x}") for x in axes], [F.col(f"r_{x}") for x in axes]
    dist = G.periodic_distance(a, b, sides) if sides else G.length([p - q for p, q in zip(a, b, strict=True)])
    lhs, rhs = dealt(lhs, rhs, names)
    keys = [*names, "__l", "__r"]
    return lhs.hint("merge").join(rhs, keys).withColumn("dist", dist).where(F.col("dist") < radius).drop(*keys)


def sum_at_nearest(sources: DataFrame, cells: DataFrame, source_id: str, cell_id: str, rate: str = "rate") -> DataFrame:
    """(cell_id, source, n_sources): the rates of the sources whose nearest cell it is."""
    near = nearest_join(sources, cells, source_id, cell_id)
    return near.join(sources.select(source_id, rate), source_id).groupBy(cell_id).agg(F.sum(rate).alias("source"), F.count("*").alias("n_sources"))


def remap(current: DataFrame, previous: DataFrame, query_id: str, site_id: str, values: Sequence[str], rescale: float = 1.0) -> DataFrame:
    """``current`` with each value raised to that of the nearest previous particle, whose positions are scaled first."""
    moved = previous.withColumns({a: F.col(a) * rescale for a in AXES})
    near = nearest_join(current, moved, query_id, site_id).select(query_id, site_id)
    old = near.join(previous.select(site_id, *(F.col(v).alias(f"old_{v}") for v in values)), site_id).drop(site_id)
    joined = current.join(old, query_id, "left")
    return joined.withColumns({v: F.greatest(F.col(v), F.col(f"old_{v}")) for v in values}).drop(*(f"old_{v}" for v in values))


def range_cuts(df: DataFrame, column: str, parts: int) -> list[float]:
    """Cuts of a key column into parts of about equal counts, its exact discrete quantiles; ``parts - 1`` numbers, none without rows."""
    return [hi for hi, _ in load_cuts(df, F.col(column), F.lit(0), F.lit(1), parts, bins=4096, strict=False).keys]


def owner_of(key, cuts: Sequence[float]):
    """Part of a key by sorted cuts; a key equal to a cut belongs to the next part."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c <= key))


def owner_of_pair(hi, lo, cuts: Sequence[tuple[int, int]]):
    """The same for keys of two columns, compared one after the other."""
    if not cuts:
        return F.lit(0)
    pairs = F.array(*(F.struct(F.lit(a).cast("long").alias("hi"), F.lit(b).cast("long").alias("lo")) for a, b in cuts))
    return F.size(F.filter(pairs, lambda c: (c["hi"] < hi) | ((c["hi"] == hi) & (c["lo"] <= lo))))


def imbalance(df: DataFrame, owner: str) -> DataFrame:
    """max_load, min_load and (max - min) / max over the parts."""
    counts = df.groupBy(owner).agg(F.count("*").alias("n"))
    return counts.agg(F.max("n").alias("max_load"), F.min("n").alias("min_load")).withColumn("imbalance", (F.col("max_load") - F.col("min_load")) / F.col("max_load"))


def partition_boxes(df: DataFrame, owner: str, axes: Sequence[str] = AXES, **more: Column) -> DataFrame:
    """A bounding box per part, and ``more`` aggregates of its rows."""
    return df.groupBy(owner).agg(*(c.alias(n) for n, c in more.items()), *(f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))))


def periodic_haloes(points: DataFrame, radius: float, sides: Sequence[float], id_col: str, axes: Sequence[str] = AXES, provider: Callable = radius_join) -> DataFrame:
    """Pairs of a point and a periodic image, not the point itself, of another or the same one closer than ``radius``: l_*, r_*
    (with its wraps r_w<axis>) and dist. ``provider`` finds pairs, as ``radius_join`` does."""
    here = points.select(id_col, *axes)
    box = bounding_box(here, axes).first()  # one row
    wrapped, moved = G.images(here, sides, axes), F.lit(False)
    for a in axes:
        moved = moved | (F.col(f"w{a}") != 0)
        if box[f"min_{a}"] is not None:  # images farther from all points than the radius have no pair
            wrapped = wrapped.where(F.col(a).between(box[f"min_{a}"] - radius, box[f"max_{a}"] + radius))
    return provider(here, wrapped.where(moved), radius, None, axes)


def wrapped_image(points: DataFrame, radius: float, sides: Sequence[float], id_col: str, axes: Sequence[str] = AXES) -> DataFrame:
    """(l_id, r_id, wraps, dist): the one periodic image of each other point within the radius; two of one point are an error."""
    found = periodic_haloes(points, radius, sides, id_col, axes)
    one = found.groupBy(f"l_{id_col}", f"r_{id_col}").agg(F.count("*").alias("n"), *(F.min(f"r_w{a}").alias(f"w{a}") for a in axes), F.min("dist").alias("dist"))
    single = F.when(F.col("n") == 1, F.col("dist")).otherwise(F.raise_error(F.lit("two images of a point are within the radius")).cast("double"))
    return one.withColumn("dist", single).drop("n")


def relevant_haloes(haloes: DataFrame, faces: DataFrame, halo_id: str = "cell_id") -> DataFrame:
    """The haloes that some local cell has a face with."""
    return haloes.join(faces.select(F.col("neighbour_id").alias(halo_id)), halo_id, "left_semi")


def sphere_owners(queries: DataFrame, boxes: DataFrame, radius, axes: Sequence[str] = AXES) -> DataFrame:
    """``queries`` once for each part whose box (as of ``partition_boxes``, a row a part) their search sphere touches."""
    gap = F.lit(0.0)
    for a in axes:
        d = F.greatest(F.lit(0.0), F.col(f"min_{a}") - F.col(a), F.col(a) - F.col(f"max_{a}"))
        gap = gap + d * d
    return queries.join(F.broadcast(boxes), gap <= F.lit(radius) * F.lit(radius))


def boxes_may_meet(one: Sequence, two: Sequence, sizes_one: Sequence, sizes_two: Sequence, sides: Sequence[float]):
    """Whether two boxes (centres and sizes) can overlap in a periodic box; full sizes, so never too strict."""
    test = F.lit(True)
    for a, b, s, t, side in zip(one, two, sizes_one, sizes_two, sides, strict=True):
        test = test & (F.abs(G.minimum_image(a - b, side)) <= s + t)
    return test


def load_in_range(df: DataFrame, key: str, low, high) -> DataFrame:
    """Rows with a key from ``low`` to ``high``, ends included."""
    return df.where(F.col(key).between(low, high)).agg(F.count("*").alias("load"))
