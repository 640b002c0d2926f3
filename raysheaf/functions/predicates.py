"""Geometric predicates on numpy points, in two or three dimensions; signs are exact.

A sign is taken from the floating determinant where that is beyond its rounding error, and from rational arithmetic otherwise.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np


def exact_determinant(rows) -> Fraction:
    """By elimination over the rationals, which floats are."""
    m = [[Fraction(float(x)) if not isinstance(x, Fraction) else x for x in row] for row in rows]
    n, value = len(m), Fraction(1)
    for k in range(n):
        pivot = next((i for i in range(k, n) if m[i][k] != 0), None)
        if pivot is None:
            return Fraction(0)
        if pivot != k:
            m[k], m[pivot], value = m[pivot], m[k], -value
        value *= m[k][k]
        for i in range(k + 1, n):
            f = m[i][k] / m[k][k]
            if f:
                m[i] = [x - f * y for x, y in zip(m[i], m[k], strict=True)]
    return value


def _sign(exact_rows, float_rows: np.ndarray) -> int:
    """Sign of a determinant: ``float_rows`` approximates ``exact_rows()``, whose entries are rational."""
    value = float(np.linalg.det(float_rows))
    bound = 1e-13 * len(float_rows) * float(np.prod(np.linalg.norm(float_rows, axis=1)))
    if abs(value) > bound:
        return 1 if value > 0 else -1
    exact = exact_determinant(exact_rows())
    return (exact > 0) - (exact < 0)


def _differences(points, origin):
    return [[Fraction(float(a)) - Fraction(float(b)) for a, b in zip(p, origin, strict=True)] for p in points]


def orientation(simplex) -> int:
    """Sign of a simplex's signed volume (area): 0 if it is flat."""
    s = np.asarray(simplex, dtype=float)
    return _sign(lambda: _differences(s[1:], s[0]), s[1:] - s[0])


def in_sphere(simplex, q) -> int:
    """1 inside the sphere (circle) through the corners, 0 on it, -1 outside; a flat simplex raises."""
    s, q = np.asarray(simplex, dtype=float), np.asarray(q, dtype=float)
    turn = orientation(s)
    if turn == 0:
        raise ValueError("the simplex is flat")
    rel = s - q
    lifted = np.concatenate([rel, (rel**2).sum(1, keepdims=True)], axis=1)

    def exact():
        return [[*row, sum(x * x for x in row)] for row in _differences(s, q)]

    side = _sign(exact, lifted) * turn
    return side if s.shape[1] == 2 else -side


def contains(simplex, q) -> bool:
    """Whether a point is inside a triangle or tetrahedron or on its boundary."""
    s = np.asarray(simplex, dtype=float)
    turn = orientation(s)
    if turn == 0:
        return False
    signs = []
    for i in range(len(s)):
        other = s.copy()
        other[i] = q
        signs.append(orientation(other) * turn)
    return min(signs) >= 0


def solve(a, b, epsilon: float = 1e-12) -> np.ndarray:
    """Gaussian elimination with the largest pivot; a pivot below ``epsilon`` of its column's scale raises."""
    m = np.concatenate([np.asarray(a, dtype=float), np.asarray(b, dtype=float)[:, None]], axis=1)
    n = len(m)
    scale = np.abs(m[:, :n]).max() or 1.0
    for k in range(n):
        pivot = k + int(np.abs(m[k:, k]).argmax())
        if abs(m[pivot, k]) <= epsilon * scale:
            raise ValueError("the system is singular")
        m[[k, pivot]] = m[[pivot, k]]
        below = m[k + 1 :, k] / m[k, k]
        m[k + 1 :] -= below[:, None] * m[k]
    x = np.zeros(n)
    for k in range(n - 1, -1, -1):
        x[k] = (m[k, n] - m[k, k + 1 : n] @ x[k + 1 :]) / m[k, k]
    return x


def circumcentre(simplex) -> np.ndarray:
    """The point as far from all corners."""
    s = np.asarray(simplex, dtype=float)
    edges = s[1:] - s[0]
    return s[0] + solve(2 * edges, (edges**2).sum(1))


def closest_on_triangle(triangle, q) -> np.ndarray:
    """The point of a triangle nearest to ``q``: its projection, or the nearest point of an edge."""
    t, q = np.asarray(triangle, dtype=float), np.asarray(q, dtype=float)
    u, v, w = t[1] - t[0], t[2] - t[0], q - t[0]
    gram = np.array([[u @ u, u @ v], [u @ v, v @ v]])
    if abs(np.linalg.det(gram)) > 1e-14 * max(1e-300, float(gram[0, 0] * gram[1, 1])):
        a, b = np.linalg.solve(gram, [w @ u, w @ v])
        if a >= 0 and b >= 0 and a + b <= 1:
            return t[0] + a * u + b * v
    best = []
    for p, r in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
        d = r - p
        share = np.clip((q - p) @ d / max(float(d @ d), 1e-300), 0.0, 1.0)
        best.append(p + share * d)
    return min(best, key=lambda c: float(((c - q) ** 2).sum()))


def distance_to_tetrahedron(tetra, q) -> float:
    """0 inside."""
    t = np.asarray(tetra, dtype=float)
    if contains(t, q):
        return 0.0
    faces = (np.delete(t, i, axis=0) for i in range(4))
    return min(float(np.linalg.norm(closest_on_triangle(f, q) - q)) for f in faces)


def segment_meets_triangle(a, b, triangle) -> np.ndarray | None:
    """Where a segment crosses a triangle; None if it doesn't or runs along its plane."""
    a, b, t = (np.asarray(x, dtype=float) for x in (a, b, triangle))
    normal = np.cross(t[1] - t[0], t[2] - t[0])
    slope = normal @ (b - a)
    if slope == 0:
        return None
    share = normal @ (t[0] - a) / slope
    if not 0 <= share <= 1:
        return None
    point = a + share * (b - a)
    return point if np.linalg.norm(closest_on_triangle(t, point) - point) <= 1e-9 * np.abs(t).max() else None
