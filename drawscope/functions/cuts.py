"""Rings of a whole batch widened and cut at lines, as flat arrays: ``points`` tells where each ring of x and y begins.

Rings are open here: the first point isn't repeated.
"""

from __future__ import annotations

import numpy as np

from .flat import spans

#: Steps of a quarter circle.
ARC = 16


def before(points: np.ndarray) -> np.ndarray:
    """Each point's predecessor in its ring."""
    out = np.arange(points[-1]) - 1
    some = np.diff(points) > 0
    out[points[:-1][some]] = points[1:][some] - 1
    return out


def chosen(x: np.ndarray, y: np.ndarray, points: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The points that are kept; every ring stays, if only as an empty one."""
    return x[keep], y[keep], np.concatenate(([0], np.cumsum(keep)))[points]


def taken(x: np.ndarray, y: np.ndarray, points: np.ndarray, rings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rings of these numbers, in this order."""
    size = np.diff(points)[rings]
    at = spans(points[:-1][rings], size)
    return x[at], y[at], np.concatenate(([0], np.cumsum(size)))


def opened(x: np.ndarray, y: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rings without their last point where that is the first."""
    keep = np.ones(len(x), bool)
    some = np.flatnonzero(np.diff(points))
    first, last = points[:-1][some], points[1:][some] - 1
    keep[last[(x[first] == x[last]) & (y[first] == y[last])]] = False
    return chosen(x, y, points, keep)


def bounds(x: np.ndarray, y: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minx, miny, maxx, maxy) of stretches of points; nowhere, for an empty one."""
    out = tuple(np.full(len(starts) - 1, v) for v in (np.inf, np.inf, -np.inf, -np.inf))
    some = np.flatnonzero(np.diff(starts))
    if len(some):
        for k, (v, least) in enumerate(((x, np.minimum), (y, np.minimum), (x, np.maximum), (y, np.maximum))):
            out[k][some] = least.reduceat(v, starts[:-1][some])
    return out


def _sums(values: np.ndarray, points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points) - 1)
    some = np.flatnonzero(np.diff(points))
    if len(some):
        out[some] = np.add.reduceat(values, points[:-1][some])
    return out


def half(x: np.ndarray, y: np.ndarray, points: np.ndarray, axis: int, at: np.ndarray, upper: bool, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What of each ring lies on one side of its line (``at``, one a ring); the line's own stretches join it. Vertices within ``near`` of
    the line lie on it, for what is on both of its sides."""
    v, w = (x, y) if axis == 0 else (y, x)
    line = np.repeat(at, np.diff(points))
    v = np.where(np.abs(v - line) <= near, line, v)
    prior = before(points)
    inside = v >= line if upper else v <= line
    crosses = inside != inside[prior]
    count = crosses.astype(np.int64) + inside
    end = np.cumsum(count)
    total = int(end[-1]) if len(end) else 0
    out_v, out_w = np.empty(total), np.empty(total)
    c, q = np.flatnonzero(crosses), np.flatnonzero(inside)
    p = prior[c]
    out_v[end[c] - count[c]] = line[c]
    out_w[end[c] - count[c]] = w[p] + (line[c] - v[p]) / (v[c] - v[p]) * (w[c] - w[p])
    out_v[end[q] - 1], out_w[end[q] - 1] = v[q], w[q]
    starts = np.concatenate(([0], end))[points]
    return (out_v, out_w, starts) if axis == 0 else (out_w, out_v, starts)


def widened(x: np.ndarray, y: np.ndarray, points: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which rings are convex, x, y, points): the Minkowski sum of each convex ring and a circle of ``reach`` (one a ring): edges
    are moved out, and corners become arcs. All other rings are empty in the result."""
    prior = before(points)
    x, y, points = chosen(x, y, points, (x != x[prior]) | (y != y[prior]))
    size = np.diff(points)
    prior = before(points)
    following = np.empty(len(x), np.int64)
    following[prior] = np.arange(len(x))
    dx, dy = x[following] - x, y[following] - y
    n = np.hypot(dx, dy)
    ux, uy = dx / n, dy / n
    px, py = ux[prior], uy[prior]
    angle = np.arctan2(px * uy - py * ux, px * ux + py * uy)
    ring = np.repeat(np.arange(len(size)), size)
    whole = _sums(angle, points)
    turn = np.where(whole < 0, -1.0, 1.0)
    bent = angle * turn[ring]
    convex = (size >= 3) & (np.abs(np.abs(whole) - 2 * np.pi) < 1e-6) & (_sums(((bent < 0) | (bent > np.pi - 1e-9)).astype(float), points) == 0)
    keep = convex[ring]
    x, y, points = chosen(x, y, points, keep)
    angle, px, py, side, r = angle[keep], px[keep], py[keep], turn[ring[keep]], reach[ring[keep]]
    first = np.arctan2(-side * px, side * py)
    steps = np.maximum(1, np.ceil(np.abs(angle) / (np.pi / 2 / ARC) - 1e-9)).astype(np.int64)
    k = spans(np.zeros(len(steps), np.int64), steps + 1)
    of = np.repeat(np.arange(len(steps)), steps + 1)
    at = first[of] + angle[of] * k / steps[of]
    return convex, x[of] + r[of] * np.cos(at), y[of] + r[of] * np.sin(at), np.concatenate(([0], np.cumsum(steps + 1)))[points]
