"""Many Voronoi cells at once: convex bodies as triangles of their dual (a corner is where three planes meet), cut by a plane each at a time.

Positions are relative to the generators. Corners of a body know their three neighbours, so what a plane cuts off is bounded by the
edges between corners beyond and before it. Where rounding leaves no single ring of such edges the body is ``broken``, and is
built by ``voronoi.Polyhedron`` instead.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

EPS = 1e-12
NEAREST = 96  # sites that are met in order of their distance, before the others are tested together
AT_ONCE = 8  # of those that were tested, as many of a cell are met before the others are tested again
TOGETHER = 1024  # cells of one batch
GAPS = 1 << 20  # distances that are computed at once
_AFTER = np.array([1, 2, 0])


def _cube() -> tuple[np.ndarray, np.ndarray]:
    """(planes, neighbours) of a box's corners; corner i is on the high side of axis a if bit a is set."""
    planes = []
    for i in range(8):
        side = [i >> a & 1 for a in range(3)]
        a, b, c = side[0], 2 + side[1], 4 + side[2]
        planes.append((a, b, c) if sum(side) % 2 else (a, c, b))
    at = {(t[e], t[(e + 1) % 3]): i for i, t in enumerate(planes) for e in range(3)}
    return np.array(planes), np.array([[at[t[(e + 1) % 3], t[e]] for e in range(3)] for t in planes])


_PLANES, _NEIGHBOURS = _cube()


class Cells:
    """Cells of ``at`` in the box, of which each is cut by planes of its own."""

    def __init__(self, at: np.ndarray, low: Sequence[float], high: Sequence[float]):
        n, self.at = len(at), at
        self.n_planes = np.full(n, 6)
        self.names = np.zeros((n, 24), dtype=np.int64)
        self.names[:, :6] = -1 - np.arange(6)
        self.normals, self.offsets = np.zeros((n, 24, 3)), np.zeros((n, 24))
        for a in range(3):
            self.normals[:, 2 * a, a], self.normals[:, 2 * a + 1, a] = -1.0, 1.0
            self.offsets[:, 2 * a], self.offsets[:, 2 * a + 1] = at[:, a] - low[a], high[a] - at[:, a]
        self.planes, self.mates = (np.zeros((n, 32, 3), dtype=np.int32) for _ in range(2))
        self.planes[:, :8], self.mates[:, :8] = _PLANES, _NEIGHBOURS
        self.corners, self.alive = np.zeros((n, 32, 3)), np.zeros((n, 32), dtype=bool)
        self.alive[:, :8] = True
        for i in range(8):
            for a in range(3):
                self.corners[:, i, a] = (high[a] if i >> a & 1 else low[a]) - at[:, a]
        self.broken = np.zeros(n, dtype=bool)

    def farthest(self) -> np.ndarray:
        return np.sqrt(np.where(self.alive, np.einsum("nti,nti->nt", self.corners, self.corners), 0.0).max(1))

    def corners_of(self, i: int) -> np.ndarray:
        return self.corners[i, self.alive[i]]

    def _widen(self, names: Sequence[str]) -> None:
        for name in names:
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, np.zeros_like(old)], axis=1))

    def cut(self, who: np.ndarray, sites: np.ndarray, names: np.ndarray) -> None:
        """Cut the cells ``who`` (each once) by the bisectors to sites (relative, not at the generator), a site a cell."""
        d = np.sqrt(np.einsum("ni,ni->n", sites, sites))
        normal, offset = sites / d[:, None], d / 2.0
        every = np.einsum("nti,ni->nt", self.corners[who], normal) - offset[:, None]
        scale = EPS * np.maximum(1.0, offset)
        over = (every > scale[:, None]) & self.alive[who]
        hit = np.flatnonzero(over.any(1))
        if not len(hit):
            return
        sub, over, every, scale = who[hit], over[hit], every[hit], scale[hit]
        if (self.n_planes[sub] >= self.names.shape[1]).any():
            self._widen(("names", "normals", "offsets"))
        new = self.n_planes[sub].copy()
        self.names[sub, new], self.normals[sub, new], self.offsets[sub, new] = names[hit], normal[hit], offset[hit]
        self.n_planes[sub] += 1
        c, t = np.nonzero(over)
        mates = self.mates[sub[c], t]
        r, e = np.nonzero(~over[c[:, None], mates])
        cc, tt, mate = c[r], t[r], mates[r, e]
        cell = sub[cc]
        a, b = self.planes[cell, tt, e], self.planes[cell, tt, _AFTER[e]]
        ends, there = self.corners[cell, mate], every[cc, mate]
        share = np.where(there >= -scale[cc], 1.0, every[cc, tt] / (every[cc, tt] - np.minimum(there, -scale[cc])))
        place = self.corners[cell, tt] + (ends - self.corners[cell, tt]) * share[:, None]
        place[share == 1.0] = ends[share == 1.0]
        # the ring: each plane begins one of its edges
        first = np.full((len(sub), self.names.shape[1]), -1, dtype=np.int64)
        last = first.copy()
        count = np.bincount(cc, minlength=len(sub))
        first[cc, a], last[cc, b] = np.arange(len(cc)), np.arange(len(cc))
        odd = (count != (first >= 0).sum(1)) | ((first >= 0) != (last >= 0)).any(1) | ((count < 3) & (over != self.alive[sub]).any(1))
        if odd.any():
            self.broken[sub[odd]] = True
            self.alive[sub[odd]] = False
            fine = ~odd[cc]
            if not fine.any():
                self.alive[sub[c], t] = False
                return
            keep = np.flatnonzero(fine)
            number = np.cumsum(fine) - 1
            cc, cell, a, b, mate, place, count = cc[keep], cell[keep], a[keep], b[keep], mate[keep], place[keep], np.where(odd, 0, count)
            first, last = (np.where((x >= 0) & ~odd[:, None], number[np.maximum(x, 0)], -1) for x in (first, last))
        self.alive[sub[c], t] = False
        while ((~self.alive[sub]).sum(1) < count).any():
            self._widen(("planes", "mates", "corners", "alive"))
        free, slots = np.nonzero(~self.alive[sub])
        starts, begins = np.searchsorted(free, np.arange(len(sub))), np.cumsum(count) - count
        slot = slots[starts[cc] + np.arange(len(cc)) - begins[cc]]
        self.planes[cell, slot] = np.stack([a, b, new[cc]], axis=1)
        self.mates[cell, slot] = np.stack([mate, slot[first[cc, b]], slot[last[cc, a]]], axis=1)
        self.corners[cell, slot], self.alive[cell, slot] = place, True
        others = self.planes[cell, mate]
        back = ((others == b[:, None]) & (others[:, _AFTER] == a[:, None])).argmax(1)
        self.mates[cell, mate, back] = slot

    def cut_in_order(self, who: np.ndarray, sites: np.ndarray, names: np.ndarray, known: np.ndarray) -> None:
        """Cut cells by rows of sites (relative, in order of distance; ``known``: which there are), as far as they may reach a corner."""
        far = np.sqrt(np.einsum("nki,nki->nk", sites, sites))
        for k in range(sites.shape[1]):
            if k % 8 == 0:
                reach = 2.0 * self.farthest()[who]
            some = np.flatnonzero(known[:, k] & (far[:, k] > 0.0) & (far[:, k] <= reach) & ~self.broken[who])
            if not len(some):
                if not (known[:, k] & (far[:, k] == 0.0)).any():
                    break
                continue
            self.cut(who[some], sites[some, k], names[some, k])

    def cut_by_all(self, sites: np.ndarray, names: np.ndarray, nearest: int = NEAREST) -> None:
        """Cut every cell by all sites (absolute positions); those at a generator don't cut."""
        n, k = len(self.at), min(nearest, len(sites))
        if not k:
            return
        order, gaps = np.zeros((n, k), dtype=np.int64), np.zeros((n, k))
        step = max(1, GAPS // len(sites))
        for i in range(0, n, step):
            d = np.zeros((min(step, n - i), len(sites)))
            for a in range(3):
                x = self.at[i : i + step, a, None] - sites[None, :, a]
                d += x * x
            near = np.argpartition(d, k - 1)[:, :k] if k < len(sites) else np.broadcast_to(np.arange(k), (len(d), k))
            own = np.take_along_axis(d, near, 1)
            by = np.argsort(own, axis=1, kind="stable")
            order[i : i + step], gaps[i : i + step] = np.take_along_axis(near, by, 1), np.take_along_axis(own, by, 1)
        self.cut_in_order(np.arange(n), sites[order] - self.at[:, None], names[order], np.ones((n, k), dtype=bool))
        if k < len(sites):
            self.cut_by_rest(np.flatnonzero(np.sqrt(gaps[:, -1]) <= 2.0 * self.farthest()), sites, names)

    def cut_by_rest(self, who: np.ndarray, sites: np.ndarray, names: np.ndarray) -> None:
        """Cut cells by those sites whose bisector cuts some corner off, the nearest first, until there is none."""
        rest: dict[int, np.ndarray | None] = dict.fromkeys(who[~self.broken[who]].tolist())
        while rest:
            some, far = {}, self.farthest()
            for i, left in rest.items():
                if self.broken[i]:
                    continue
                own = (sites if left is None else sites[left]) - self.at[i]
                d = np.einsum("ni,ni->n", own, own)
                near = np.flatnonzero((d > 0.0) & (d <= 4.0 * far[i] ** 2))
                own, d = own[near], np.sqrt(d[near])
                cutting = np.flatnonzero((self.corners_of(i) @ own.T).max(0, initial=-np.inf) > (d / 2.0 + EPS * np.maximum(1.0, d / 2.0)) * d)
                if len(cutting):
                    cutting = cutting[np.argsort(d[cutting], kind="stable")]
                    some[i] = near[cutting] if left is None else left[near[cutting]]
            if some:
                now = np.fromiter(some, dtype=np.int64)
                width = min(AT_ONCE, max(len(x) for x in some.values()))
                picked, known = np.zeros((len(now), width), dtype=np.int64), np.zeros((len(now), width), dtype=bool)
                for j, left in enumerate(some.values()):
                    picked[j, : len(left[:width])], known[j, : len(left[:width])] = left[:width], True
                self.cut_in_order_ragged(now, sites[picked] - self.at[now][:, None], names[picked], known)
            rest = {i: left[AT_ONCE:] for i, left in some.items() if len(left) > AT_ONCE}

    def cut_in_order_ragged(self, who: np.ndarray, sites: np.ndarray, names: np.ndarray, known: np.ndarray) -> None:
        for k in range(sites.shape[1]):
            some = np.flatnonzero(known[:, k] & ~self.broken[who])
            self.cut(who[some], sites[some, k], names[some, k])

    def bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, plane, name): the planes that corners lie in."""
        used = np.zeros(self.names.shape, dtype=bool)
        c, t = np.nonzero(self.alive)
        for e in range(3):
            used[c, self.planes[c, t, e]] = True
        cell, plane = np.nonzero(used)
        return cell, plane, self.names[cell, plane]

    def measured(self) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(volumes, faces): faces have cell, name, area and normal, in order of cells; ones without extent are left out."""
        n, width = self.names.shape
        c, t = np.nonzero(self.alive)
        ref, size, sides, sums = np.zeros((n, width, 3)), np.zeros((n, width)), np.zeros(n * width), np.zeros((3, n * width))
        for e in range(3):
            ref[c, self.planes[c, t, e]] = self.corners[c, t]
        for e in range(3):
            p = self.planes[c, t, e]
            np.maximum.at(size, (c, p), np.abs(self.corners[c, t] - ref[c, p]).max(1))
        for e in range(3):
            p = self.planes[c, t, e]
            one, two = self.corners[c, t] - ref[c, p], self.corners[c, self.mates[c, t, e]] - ref[c, p]
            key = c * width + p
            sides += np.bincount(key, np.abs(two - one).max(1) > 1e-9 * size[c, p], n * width)
            cross = np.cross(one, two)
            for a in range(3):
                sums[a] += np.bincount(key, cross[:, a], n * width)
        areas = 0.5 * np.sqrt((sums**2).sum(0)).reshape(n, width)
        volumes = (areas * self.offsets).sum(1) / 3.0
        off = np.linalg.norm((areas[..., None] * self.normals).sum(1), axis=1)
        self.broken |= off > 1e-7 * areas.sum(1)  # its faces don't close
        cell, plane = np.nonzero(sides.reshape(n, width) >= 3)
        return volumes, {"cell": cell, "name": self.names[cell, plane], "area": areas[cell, plane], "normal": self.normals[cell, plane]}
