"""Box, periodicity and octant expressions on Columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def col(c) -> Column:
    return c if isinstance(c, Column) else F.lit(c) if isinstance(c, (int, float)) else F.col(c)


def wrap(v: Column, low: float, high: float) -> Column:
    """Into [low, high) of a periodic axis."""
    return F.pmod(v - low, F.lit(high - low)) + low


def minimum_image(d: Column, side: float) -> Column:
    """The displacement to the nearest periodic image; half a side either way is left as it is."""
    return F.when(d > side / 2, d - side).when(d < -side / 2, d + side).otherwise(d)


def length(components: Sequence[Column]) -> Column:
    total = components[0] * components[0]
    for c in components[1:]:
        total = total + c * c
    return F.sqrt(total)


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        total = total + x * y
    return total


def cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def normalised(a: Sequence[Column]) -> list[Column]:
    n = length(a)
    return [c / n for c in a]


def periodic_distance(a: Sequence[Column], b: Sequence[Column], sides: Sequence[float]) -> Column:
    return length([minimum_image(x - y, s) for x, y, s in zip(a, b, sides, strict=True)])


def images(df: DataFrame, sides: Sequence[float], axes: Sequence[str] = AXES) -> DataFrame:
    """Every row once for each of its 3^d periodic images: columns w<axis> in -1, 0, 1, positions moved."""
    steps = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    out = df
    for axis in axes:
        out = out.withColumn(f"w{axis}", F.explode(steps))
    return out.withColumns({a: F.col(a) + F.col(f"w{a}") * s for a, s in zip(axes, sides, strict=True)})


def inside(point: Sequence[Column], low: Sequence[float], high: Sequence[float]) -> Column:
    """Closed box."""
    test = F.lit(True)
    for c, a, b in zip(point, low, high, strict=True):
        test = test & c.between(a, b)
    return test


def octant(point: Sequence[Column], centre: Sequence) -> Column:
    """x is the lowest bit; below the centre is 0."""
    total = F.lit(0)
    for i, (c, m) in enumerate(zip(point, centre, strict=True)):
        total = total + F.when(c < m, 0).otherwise(1 << i)
    return total.cast("int")


def distance_to_box_squared(point: Sequence[Column], low: Sequence[float], high: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for c, a, b in zip(point, low, high, strict=True):
        d = F.greatest(F.lit(0.0), F.lit(a) - c, c - F.lit(b))
        total = total + d * d
    return total


def corners(low: Sequence[float], high: Sequence[float]) -> list[tuple[float, ...]]:
    """The 2^d corners of a box, x varying fastest."""
    return [tuple(high[i] if (n >> i) & 1 else low[i] for i in range(len(low))) for n in range(1 << len(low))]


def box_of(size=None, low=None, high=None) -> tuple[list[float], list[float]]:
    """A box from min and max, from a size per axis, or from one side length."""
    if size is None:
        return list(map(float, low)), list(map(float, high))
    sides = [float(size)] * 3 if isinstance(size, (int, float)) else list(map(float, size))
    return [0.0] * len(sides), sides


def box_inside(low: Sequence, high: Sequence, outer_low: Sequence, outer_high: Sequence) -> Column:
    """Whether a box lies in another one, sides included; bounds are Columns or numbers."""
    test = F.lit(True)
    for a, b, c, d in zip(low, high, outer_low, outer_high, strict=True):
        test = test & (col(a) >= col(c)) & (col(b) <= col(d))
    return test


def tripled_box(low: Sequence[float], high: Sequence[float]) -> tuple[list[float], list[float]]:
    """The box of a periodic box and its images."""
    sides = [b - a for a, b in zip(low, high, strict=True)]
    return [a - s for a, s in zip(low, sides, strict=True)], [b + s for b, s in zip(high, sides, strict=True)]


def sub_boxes(low: Sequence[float], high: Sequence[float]) -> list[tuple[list[float], list[float]]]:
    """The 2^d parts that the centre divides a box into, by ``octant``."""
    middle = [(a + b) / 2 for a, b in zip(low, high, strict=True)]
    pick = lambda n: [(n >> i) & 1 for i in range(len(low))]
    return [([m if bit else a for a, m, bit in zip(low, middle, pick(n), strict=True)], [b if bit else m for b, m, bit in zip(high, middle, pick(n), strict=True)]) for n in range(1 << len(low))]


def cube(side: float, ndim: int = 3, centred: bool = False) -> tuple[list[float], list[float]]:
    """A cube from the origin, or around it."""
    low = -side / 2 if centred else 0.0
    return [low] * ndim, [low + side] * ndim


def box_around(centre: Sequence, radius) -> tuple[list[Column], list[Column]]:
    """The box around a sphere."""
    return [col(c) - col(radius) for c in centre], [col(c) + col(radius) for c in centre]


def box_measures(low: Sequence, high: Sequence) -> dict[str, Column]:
    """volume, longest (side), and side_<i> and centre_<i> of each axis; bounds are Columns or numbers."""
    sides = [col(b) - col(a) for a, b in zip(low, high, strict=True)]
    volume = sides[0]
    for s in sides[1:]:
        volume = volume * s
    longest = F.greatest(*sides) if len(sides) > 1 else sides[0]
    centres = [(col(a) + col(b)) / 2 for a, b in zip(low, high, strict=True)]
    return {"volume": volume, "longest": longest} | {f"side_{i}": s for i, s in enumerate(sides)} | {f"centre_{i}": c for i, c in enumerate(centres)}


def encompassing_simplex(low: Sequence[float], high: Sequence[float], margin: float = 0.5) -> np.ndarray:
    """d + 1 points of a simplex that has the box inside: a corner below it and d far along the axes."""
    a, b = np.asarray(low, dtype=float), np.asarray(high, dtype=float)
    side = float((b - a).max()) or 1.0
    corner = a - margin * side
    reach = (len(a) + margin) * 2 * side
    return np.concatenate([corner[None], corner + reach * np.eye(len(a))])


def unit_coordinates(point: Sequence[Column], low: Sequence[float], side: float) -> list[Column]:
    """Into [1, 2]."""
    return [1.0 + (c - a) / side for c, a in zip(point, low, strict=True)]


def bucket(point: Sequence[Column], low: Sequence[float], width: float) -> list[Column]:
    """Integer grid cell of a point."""
    return [F.floor((c - a) / width).cast("long") for c, a in zip(point, low, strict=True)]


def cell_size_of_volume(volume: Column, ndim: int = 3) -> Column:
    """Radius of the sphere (circle) of that volume (area)."""
    return F.cbrt(volume * (3.0 / (4.0 * 3.141592653589793))) if ndim == 3 else F.sqrt(volume / 3.141592653589793)


# ---- matrices, on the driver


def rotation(axis: Sequence[float], angle: float) -> np.ndarray:
    """The matrix of a turn about an axis: cos I + sin K + (1 - cos) a a^T."""
    a = np.asarray(axis, dtype=float)
    a = a / np.linalg.norm(a)
    turn = np.array([[0, -a[2], a[1]], [a[2], 0, -a[0]], [-a[1], a[0], 0]])
    return math.cos(angle) * np.eye(3) + math.sin(angle) * turn + (1 - math.cos(angle)) * np.outer(a, a)


def random_rotation(seed: int) -> np.ndarray:
    """A uniformly random rotation: an orthonormal basis of normal vectors, made right-handed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(3, 3)))
    q = q * np.sign(np.diag(r))
    if np.linalg.det(q) < 0:
        q[:, 0] = -q[:, 0]
    return q


def rotated(directions: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Directions (dir, dx, dy, dz) turned by a matrix."""
    d = [F.col(f"d{a}") for a in AXES]
    turned = [sum((float(matrix[i][j]) * d[j] for j in range(3)), F.lit(0.0)).alias(f"d{a}") for i, a in enumerate(AXES)]
    return directions.select("dir", *turned)
