"""Geometry kernels on arrays, and their use on Arrow batches.

Triangles are arrays (n, 3 corners, 3 axes), points are (n, 3). Run as projections, the kernels' hundred or so columns
exceed what the JVM compiles, and a filter behind them is pushed through and copies them; as array kernels they run
on whole batches and give back only the rows that count.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Squared normal of a degenerate triangle, snap distance in metres, smallest denominator.
DEGENERATE, SNAP, TINY = 1e-20, 1e-6, 1e-30


def cross(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.stack([u[:, p] * v[:, q] - u[:, q] * v[:, p] for p, q in ((1, 2), (2, 0), (0, 1))], axis=1)


def dot(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return u[:, 0] * v[:, 0] + u[:, 1] * v[:, 1] + u[:, 2] * v[:, 2]


def _plane(tri: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normal, its square, and the distances (times the normal's length) of the corners `of`, snapped to 0."""
    n = cross(tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0])
    square, at = dot(n, n), dot(n, tri[:, 0])
    d = np.stack([dot(n, of[:, k]) - at for k in range(3)], axis=1)
    return n, square, np.where(np.abs(d) < (SNAP * np.sqrt(square))[:, None], 0.0, d)


def _aside(d: np.ndarray) -> np.ndarray:
    return (d > 0).all(axis=1) | (d < 0).all(axis=1)


_OTHERS = np.array([(1, 2), (0, 2), (0, 1)])


def _crossing(p: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both ends of a triangle's cut with a plane on the line's axis, and whether there is one.

    p: corners on the axis, d: distances from the plane. The odd corner is alone on its side, or else the first on the plane.
    """
    rows = np.arange(len(p))
    together = [d[:, 0] * d[:, 1] > 0, d[:, 0] * d[:, 2] > 0, d[:, 1] * d[:, 2] > 0, d[:, 0] == 0, d[:, 1] == 0, d[:, 2] == 0]
    odd = np.select(together, [2, 1, 0, 0, 1, 2], -1)
    a, b = _OTHERS[odd].T
    (po, do), (pa_, da), (pb, db) = ((p[rows, k], d[rows, k]) for k in (odd, a, b))
    touch = (do == 0) & (da * db <= 0)
    reach = lambda x, dx, y, dy: x + (y - x) * dx / np.where(np.abs(dx - dy) < TINY, 1.0, dx - dy)
    first = np.where(touch, po, reach(pa_, da, po, do))
    second = np.where(touch, np.where(da == 0, pa_, reach(pa_, da, pb, db)), reach(pb, db, po, do))
    sound = np.where(touch, np.abs(da - db) >= TINY, (np.abs(da - do) >= TINY) & (np.abs(db - do) >= TINY))
    return first, second, sound & (odd >= 0)


def may_meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The numbers of the pairs in which neither triangle lies on one side of the other's plane; only these can intersect."""
    left = np.arange(len(a))
    for on, of in ((b, a), (a, b)):
        _, square, d = _plane(on[left], of[left])
        left = left[(square >= DEGENERATE) & ~_aside(d)]
    return left


def tri_tri(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triangle-triangle intersection (Moeller 1997): hit, point and the overlap's length on the line's axis (nan without a hit).

    Touching counts; coplanar and degenerate pairs don't. The point has the middle of the overlap on that axis.
    """
    if not len(a):
        return np.zeros(0, bool), np.zeros((0, 3)), np.zeros(0)
    with np.errstate(all="ignore"):
        m, m_square, da = _plane(b, a)
        n, n_square, db = _plane(a, b)
        line = cross(n, m)
        axis = np.abs(line).argmax(axis=1)  # the first of equal ones
        rows = np.arange(len(a))
        a1, a2, a_ok = _crossing(a[rows, :, axis], da)
        b1, b2, b_ok = _crossing(b[rows, :, axis], db)
        lo, hi = np.maximum(np.minimum(a1, a2), np.minimum(b1, b2)), np.minimum(np.maximum(a1, a2), np.maximum(b1, b2))
        along = line[rows, axis]
        hit = (m_square >= DEGENERATE) & (n_square >= DEGENERATE) & ~_aside(da) & ~(da == 0).all(axis=1) & ~_aside(db) & a_ok & b_ok & (lo <= hi) & (np.abs(along) >= TINY)
        corners = np.concatenate((a, b), axis=1)
        centre = (corners[:, 0] + corners[:, 1] + corners[:, 2] + corners[:, 3] + corners[:, 4] + corners[:, 5]) / 6.0
        shift = ((lo + hi) * 0.5 - centre[rows, axis]) / np.where(hit, along, 1.0)
        point = centre + line * shift[:, None]
    return hit, np.where(hit[:, None], point, np.nan), np.where(hit, hi - lo, np.nan)


def closest_on_triangle(p: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points of the triangles closest to the points, and the distances.

    Ericson (Real-Time Collision Detection, 5.1.5): regions A, B, AB, C, AC, BC, inside; the first that fits counts.
    """
    a, b, c = t[:, 0], t[:, 1], t[:, 2]
    s, w = b - a, c - a
    d1, d2, d3, d4, d5, d6 = (dot(u, p - v) for v in (a, b, c) for u in (s, w))
    fc, fb, fa = d1 * d4 - d3 * d2, d5 * d2 - d1 * d6, d3 * d6 - d5 * d4
    share = lambda x, y: (x / np.where(np.abs(y) < TINY, TINY, y))[:, None]
    with np.errstate(all="ignore"):
        kin = share(np.ones(len(p)), fa + fb + fc)
        spots = [
            a, b, a + share(d1, d1 - d3) * s, c, a + share(d2, d2 - d6) * w, b + share(d4 - d3, (d4 - d3) + (d5 - d6)) * (c - b),
            a + s * (fb[:, None] * kin) + w * (fc[:, None] * kin),
        ]
        regions = [
            (d1 <= 0) & (d2 <= 0), (d3 >= 0) & (d4 <= d3), (fc <= 0) & (d1 >= 0) & (d3 <= 0), (d6 >= 0) & (d5 <= d6),
            (fb <= 0) & (d2 >= 0) & (d6 <= 0), (fa <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0),
        ]
        region = np.select(regions, range(6), 6)
        q = np.select([(region == k)[:, None] for k in range(7)], spots)
        return q, np.sqrt(dot(q - p, q - p))


def closest_between_segments(s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places on segments s and t (n, 2 ends, 3) that are closest to each other, and their distances.

    The best of the four ends, each with the other segment, and of the crossing of both lines where it lies inside both.
    """
    u, v, w = s[:, 1] - s[:, 0], t[:, 1] - t[:, 0], s[:, 0] - t[:, 0]
    uu, uv, vv, uw, vw = dot(u, u), dot(u, v), dot(v, v), dot(u, w), dot(v, w)
    on = lambda x, size: np.clip(x / np.where(size > 0, size, 1.0), 0.0, 1.0)
    zero, one = np.zeros(len(s)), np.ones(len(s))
    with np.errstate(all="ignore"):
        steep = uu * vv - uv * uv
        inner = [(uv * vw - vv * uw) / np.where(steep > 0, steep, 1.0), (uu * vw - uv * uw) / np.where(steep > 0, steep, 1.0)]
        inside = (steep > 0) & (inner[0] >= 0) & (inner[0] <= 1) & (inner[1] >= 0) & (inner[1] <= 1)
        ways = [(zero, on(vw, vv)), (one, on(vw + uv, vv)), (on(-uw, uu), zero), (on(uv - uw, uu), one), (np.where(inside, inner[0], 0.0), np.where(inside, inner[1], on(vw, vv)))]
        best = None
        for a, b in ways:
            p, q = s[:, 0] + a[:, None] * u, t[:, 0] + b[:, None] * v
            dist = np.sqrt(dot(p - q, p - q))
            if best is None:
                best = [p, q, dist]
            else:
                nearer = dist < best[2]
                best = [np.where(nearer[:, None], p, best[0]), np.where(nearer[:, None], q, best[1]), np.where(nearer, dist, best[2])]
    return best[0], best[1], best[2]


def columns(batch: pa.RecordBatch, names: list[str], shape: tuple[int, ...]) -> np.ndarray:
    """Double columns of a batch as one array (rows, *shape)."""
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1).reshape(-1, *shape)


def hits_kernel(keys: list[str], a: str = "a", b: str = "b", only_hits: bool = True) -> Callable:
    """For mapInArrow over keys and corners {a}0x .. {b}2z: the keys, hit (unless only hits are kept), px, py, pz."""
    corners = {s: [f"{s}{k}{x}" for k in range(3) for x in "xyz"] for s in (a, b)}

    def kernel(batches):
        for batch in batches:
            one, other = (columns(batch, corners[s], (3, 3)) for s in (a, b))
            if only_hits:
                left = may_meet(one, other)
                one, other, batch = one[left], other[left], batch.select(keys).take(pa.array(left))
            hit, point, _ = tri_tri(one, other)
            cols = [batch.column(k) for k in keys] + ([] if only_hits else [pa.array(hit)]) + [pa.array(point[:, k], mask=~hit) for k in range(3)]
            out = pa.RecordBatch.from_arrays(cols, names=keys + ([] if only_hits else ["hit"]) + ["px", "py", "pz"])
            yield out.filter(pa.array(hit)) if only_hits else out

    return kernel


def closest_kernel(keys: list[str], within: float | None = None) -> Callable:
    """For mapInArrow over keys, px, py, pz and corners t0x .. t2z: the keys, dist, qx, qy, qz; rows beyond `within` are left out."""
    corners = [f"t{k}{x}" for k in range(3) for x in "xyz"]

    def kernel(batches):
        for batch in batches:
            q, dist = closest_on_triangle(columns(batch, ["px", "py", "pz"], (3,)), columns(batch, corners, (3, 3)))
            out = pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + [pa.array(dist)] + [pa.array(q[:, k]) for k in range(3)], names=[*keys, "dist", "qx", "qy", "qz"])
            yield out if within is None else out.filter(pa.array(dist <= within))

    return kernel
