"""Polygon overlay, repair, voids and hexagons, for which Spark has no built-in functions.

Overlay works by slabs: the plane is cut at every vertex and crossing into horizontal strips,
in which edges don't cross; in a strip, the stretches between neighbouring edges are inside or
outside each input by the even-odd rule, and the trapezoids that an operation keeps are sewn
together along shared sides. It is exact up to rounding for simple, self-crossing and holed
polygons, and its cost is bounded by the vertices of the shapes at hand: two units, or what lies in one
tile (``dissolve``); shapes travel in Arrow batches.

A shape is a list of polygons, a polygon a list of rings (shell, then holes), a ring a closed
list of (x, y). Defined cases: null and empty shapes are empty; rings of no area vanish.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import flat

Ring = list[tuple[float, float]]
Shape = list[list[Ring]]

#: Coordinates are matched on a grid of this size (metres).
SNAP = 1e-7


def from_rows(value) -> Shape:
    """Nested rows, dictionaries or arrays of x and y."""
    point = lambda p: (float(p["x"]), float(p["y"]))
    return [[[point(p) for p in ring] for ring in polygon] for polygon in value] if value is not None else []


def to_rows(shape: Shape) -> list:
    return [[[{"x": x, "y": y} for x, y in ring] for ring in polygon] for polygon in shape]


def ring_area(ring: Ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def area(shape: Shape) -> float:
    return sum(abs(ring_area(p[0])) - sum(abs(ring_area(h)) for h in p[1:]) for p in shape if p)


def _edges(shape: Shape, owner: int) -> list[tuple[float, float, float, float, int]]:
    """Edges that aren't level, lower end first."""
    out = []
    for polygon in shape:
        for ring in polygon:
            for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
                if ay < by:
                    out.append((ax, ay, bx, by, owner))
                elif by < ay:
                    out.append((bx, by, ax, ay, owner))
    return out


#: Edges from which crossings are looked for in arrays.
MANY = 32


def _crossings(edges: np.ndarray) -> list[float]:
    """Heights at which edges, sorted by their lower ends, meet earlier ones: the loop of ``_levels``, some hundred edges at a time."""
    out: list[float] = []
    left, right = np.minimum(edges[:, 0], edges[:, 2]), np.maximum(edges[:, 0], edges[:, 2])
    for first in range(0, len(edges), 64):
        e = slice(first, min(first + 64, len(edges)))
        f = np.flatnonzero(edges[: e.stop, 3] > edges[first, 1])
        met = (edges[f, 3] > edges[e, 1][:, None]) & (right[e][:, None] >= left[f]) & (right[f] >= left[e][:, None])
        met &= f < np.arange(e.start, e.stop)[:, None]
        i, j = np.nonzero(met)
        (ex, ey, eu, ev), (fx, fy, fu, fv) = edges[i + first].T, edges[f[j]].T
        dx1, dy1, dx2, dy2 = eu - ex, ev - ey, fu - fx, fv - fy
        det = dx1 * dy2 - dy1 * dx2
        some = np.flatnonzero(np.abs(det) > 1e-14 * (np.abs(dx1) + np.abs(dy1)) * (np.abs(dx2) + np.abs(dy2)))
        ex, ey, fx, fy, dx1, dy1, dx2, dy2, det = (v[some] for v in (ex, ey, fx, fy, dx1, dy1, dx2, dy2, det))
        t = ((fx - ex) * dy2 - (fy - ey) * dx2) / det
        u = ((fx - ex) * dy1 - (fy - ey) * dx1) / det
        hit = (t >= -1e-12) & (t <= 1 + 1e-12) & (u >= -1e-12) & (u <= 1 + 1e-12)
        out += (ey + t * dy1)[hit].tolist()
    return out


def _levels(edges: list) -> list[float]:
    """Heights of all ends and crossings, merged where they nearly agree."""
    ys = [e[1] for e in edges] + [e[3] for e in edges]
    starting = sorted(edges, key=lambda e: e[1])
    if len(edges) >= MANY:
        ys += _crossings(np.array([e[:4] for e in starting]))
        starting = []
    active: list = []
    for e in starting:
        active = [f for f in active if f[3] > e[1]]
        for f in active:
            if max(e[0], e[2]) < min(f[0], f[2]) or max(f[0], f[2]) < min(e[0], e[2]):
                continue
            dx1, dy1, dx2, dy2 = e[2] - e[0], e[3] - e[1], f[2] - f[0], f[3] - f[1]
            det = dx1 * dy2 - dy1 * dx2
            if abs(det) <= 1e-14 * (abs(dx1) + abs(dy1)) * (abs(dx2) + abs(dy2)):
                continue
            t = ((f[0] - e[0]) * dy2 - (f[1] - e[1]) * dx2) / det
            u = ((f[0] - e[0]) * dy1 - (f[1] - e[1]) * dx1) / det
            if -1e-12 <= t <= 1 + 1e-12 and -1e-12 <= u <= 1 + 1e-12:
                ys.append(e[1] + t * dy1)
        active.append(e)
    ys.sort()
    out: list[float] = []
    for y in ys:
        if not out or y - out[-1] > SNAP:
            out.append(y)
    return out


def _x(e: tuple, y: float) -> float:
    return e[0] + (e[2] - e[0]) * (y - e[1]) / (e[3] - e[1])


def trapezoids(shapes: list[Shape], keep: Callable[[int], bool]) -> Iterator[tuple[float, float, float, float, float, float]]:
    """(y low, y high, left and right x below, left and right x above) of what is kept.

    ``keep`` gets a bit set of the inputs that a stretch is inside of.
    """
    edges = [e for i, s in enumerate(shapes) for e in _edges(s, i)]
    levels = _levels(edges)
    starting = sorted(edges, key=lambda e: e[1])
    active: list = []
    n = 0
    for lo, hi in zip(levels, levels[1:], strict=False):
        mid = (lo + hi) / 2
        while n < len(starting) and starting[n][1] < mid:
            active.append(starting[n])
            n += 1
        active = [e for e in active if e[3] > mid]
        row = sorted(active, key=lambda e: (_x(e, mid), _x(e, hi)))
        inside, begin = 0, None
        for e in row:
            was = keep(inside)
            inside ^= 1 << e[4]
            now = keep(inside)
            if now and not was:
                begin = e
            elif was and not now:
                a, b, c, d = _x(begin, lo), _x(e, lo), _x(begin, hi), _x(e, hi)
                if b - a > SNAP or d - c > SNAP:
                    yield lo, hi, a, max(a, b), c, max(c, d)


def _ranks(groups: np.ndarray, values: np.ndarray, at: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """How many of the values, in the order of (group, value), are at or before each (group, value) that is sought."""
    n = len(values)
    order = np.lexsort((np.arange(n + len(sought)) >= n, np.concatenate([values, sought]), np.concatenate([groups, at])))
    before = np.cumsum(order < n)
    out = np.empty(len(sought), np.int64)
    mine = order >= n
    out[order[mine] - n] = before[mine]
    return out


#: Pairs of edges whose crossings are looked for at a time.
PAIRS = 1 << 20


def _met(edges: np.ndarray, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tile, height) wherever two edges of a tile, lower ends first, meet."""
    order = np.lexsort((edges[:, 1], tile))
    edges, tile = edges[order], tile[order]
    left, right = np.minimum(edges[:, 0], edges[:, 2]), np.maximum(edges[:, 0], edges[:, 2])
    following = np.arange(len(edges)) + 1
    # Of edges that begin as high as another ends none is compared with it; those would only repeat that height.
    n = np.maximum(0, _ranks(tile, edges[:, 1], tile, np.nextafter(edges[:, 3], -np.inf)) - following)
    total = np.concatenate(([0], np.cumsum(n)))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    lo = 0
    while lo < len(edges):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, "right")) - 1)
        f, e = np.repeat(np.arange(lo, hi), n[lo:hi]), flat.spans(following[lo:hi], n[lo:hi])
        some = (right[e] >= left[f]) & (right[f] >= left[e])
        e, f = e[some], f[some]
        (ex, ey, eu, ev), (fx, fy, fu, fv) = edges[e].T, edges[f].T
        dx1, dy1, dx2, dy2 = eu - ex, ev - ey, fu - fx, fv - fy
        det = dx1 * dy2 - dy1 * dx2
        some = np.abs(det) > 1e-14 * (np.abs(dx1) + np.abs(dy1)) * (np.abs(dx2) + np.abs(dy2))
        e, ex, ey, fx, fy, dx1, dy1, dx2, dy2, det = (v[some] for v in (e, ex, ey, fx, fy, dx1, dy1, dx2, dy2, det))
        t, u = ((fx - ex) * dy2 - (fy - ey) * dx2) / det, ((fx - ex) * dy1 - (fy - ey) * dx1) / det
        hit = (t >= -1e-12) & (t <= 1 + 1e-12) & (u >= -1e-12) & (u <= 1 + 1e-12)
        out.append((tile[e[hit]], (ey + t * dy1)[hit]))
        lo = hi
    return tuple(np.concatenate([o[i] for o in out]) if out else (tile, edges[:, 1])[i][:0] for i in range(2))


def _heights(tile: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tile, height) in order; heights within ``SNAP`` above one of their tile are merged into it."""
    order = np.lexsort((ys, tile))
    tile, ys = tile[order], ys[order]
    fresh = np.ones(len(ys), bool)
    fresh[1:] = (np.diff(tile) != 0) | (np.diff(ys) > SNAP)
    begins = np.flatnonzero(fresh)
    ends = np.append(begins[1:], len(ys))
    for k in np.flatnonzero(ys[ends - 1] - ys[begins] > SNAP).tolist() if len(ys) else []:  # long rows of near heights
        last = ys[begins[k]]
        for i in range(begins[k], ends[k]):
            if ys[i] - last > SNAP:
                fresh[i], last = True, ys[i]
    return tile[fresh], ys[fresh]


class Strips:
    """The slab overlay of several tiles as flat arrays: stretches between neighbouring edges, strip by strip from the left.

    edges: (ax, ay, bx, by); owner: the polygon that each is of (even-odd rule); kind: what that polygon counts as; tile: where it
    lies, since tiles don't see each other. ``inside[k]`` tells how many polygons of kind k hold each stretch; right of a
    strip's last edge that is 0 for all."""

    def __init__(self, edges: np.ndarray, owner: np.ndarray, kind: np.ndarray, tile: np.ndarray, kinds: int):
        some = edges[:, 1] != edges[:, 3]
        edges, owner, kind, tile = edges[some], owner[some], kind[some], tile[some]
        down = edges[:, 1] > edges[:, 3]
        edges = np.where(down[:, None], edges[:, [2, 3, 0, 1]], edges)
        where, met = _met(edges, tile)
        where, levels = _heights(np.concatenate([tile, tile, where]), np.concatenate([edges[:, 1], edges[:, 3], met]))
        low = np.flatnonzero(np.diff(where) == 0)
        self.low, self.high, self.tile = levels[low], levels[low + 1], where[low]
        mid = (self.low + self.high) / 2
        # A strip's middle is above an edge's lower end and not above its upper one, so each ring is met an even number of times.
        first = _ranks(self.tile, mid, tile, edges[:, 1])
        n = _ranks(self.tile, mid, tile, edges[:, 3]) - first
        strip, at = flat.spans(first, n), np.repeat(np.arange(len(edges)), n)
        self.edges = edges
        x = self._x(at, mid[strip])
        order = np.lexsort((self._x(at, self.high[strip]), x, strip))
        self.strip, self.edge, self.x = strip[order], at[order], x[order]
        own = owner[self.edge]
        same = np.lexsort((own, self.strip))  # stable: from the left
        fresh = np.ones(len(same), bool)
        fresh[1:] = (np.diff(self.strip[same]) != 0) | (np.diff(own[same]) != 0)
        begins = np.flatnonzero(fresh)
        rank = np.arange(len(same)) - np.repeat(begins, np.diff(np.append(begins, len(same))))
        step = np.empty(len(same), np.int64)
        step[same] = 1 - 2 * (rank % 2)
        self.inside = [np.cumsum(np.where(kind[self.edge] == k, step, 0)) for k in range(kinds)]

    def _x(self, at: np.ndarray, y: np.ndarray) -> np.ndarray:
        ax, ay, bx, by = self.edges[at].T
        return ax + (bx - ax) * (y - ay) / (by - ay)

    def area(self, keep: np.ndarray) -> float:
        """Of the stretches that are kept; those right of a strip's last edge must not be."""
        k = np.flatnonzero(keep)
        return float(((self.x[k + 1] - self.x[k]) * (self.high - self.low)[self.strip[k]]).sum())

    def cells(self, keep: np.ndarray) -> dict[int, list[tuple]]:
        """What ``trapezoids`` gives, by tile: neighbours that are kept are one."""
        was = np.concatenate(([False], keep[:-1]))
        b, e = np.flatnonzero(keep & ~was), np.flatnonzero(~keep & was)
        lo, hi = self.low[self.strip[b]], self.high[self.strip[b]]
        l0, r0, l1, r1 = self._x(self.edge[b], lo), self._x(self.edge[e], lo), self._x(self.edge[b], hi), self._x(self.edge[e], hi)
        some = (r0 - l0 > SNAP) | (r1 - l1 > SNAP)
        out: dict[int, list[tuple]] = defaultdict(list)
        for t, *cell in zip(*(v[some].tolist() for v in (self.tile[self.strip[b]], lo, hi, l0, np.maximum(l0, r0), l1, np.maximum(l1, r1))), strict=True):
            out[t].append(tuple(cell))
        return out


def overlay_area(a: Shape, b: Shape) -> float:
    """Area that two shapes share."""
    return sum((hi - lo) * ((r0 - l0) + (r1 - l1)) / 2 for lo, hi, l0, r0, l1, r1 in trapezoids([a, b], lambda s: s == 3))


def sewn(cells: list[tuple]) -> Shape:
    """Polygons whose area is that of the trapezoids: sides that two cells share vanish."""
    grid = lambda v: round(v / SNAP)
    level: dict[int, set[int]] = defaultdict(set)
    for lo, hi, l0, r0, l1, r1 in cells:
        level[grid(lo)] |= {grid(l0), grid(r0)}
        level[grid(hi)] |= {grid(l1), grid(r1)}
    stops = {y: sorted(xs) for y, xs in level.items()}
    count: dict[tuple, int] = defaultdict(int)

    def add(p: tuple[int, int], q: tuple[int, int]) -> None:
        if p != q:
            if count.get((q, p)):
                count[q, p] -= 1
            else:
                count[p, q] += 1

    def flat(y: int, a: int, b: int) -> None:
        step = [x for x in stops[y] if min(a, b) <= x <= max(a, b)]
        for p, q in zip(step, step[1:], strict=False) if a < b else zip(step[::-1], step[-2::-1], strict=False):
            add((p, y), (q, y))

    for lo, hi, l0, r0, l1, r1 in cells:
        y0, y1 = grid(lo), grid(hi)
        flat(y0, grid(l0), grid(r0))
        add((grid(r0), y0), (grid(r1), y1))
        flat(y1, grid(r1), grid(l1))
        add((grid(l1), y1), (grid(l0), y0))
    return looped(count)


def looped(count: dict[tuple, int]) -> Shape:
    """Polygons from directed edges between points of the snap grid, and how often each stands there."""
    out: dict[tuple, list[tuple]] = defaultdict(list)
    for (p, q), n in count.items():
        out[p] += [q] * n
    loops: list[list[tuple]] = []
    for start in list(out):
        while out[start]:
            loop, here, before = [start], start, None
            while True:
                choices = out[here]
                if not choices:
                    break
                # At a corner where loops touch, turn right as sharply as can be: rings stay simple.
                if before is None or len(choices) == 1:
                    k = len(choices) - 1
                else:
                    back = math.atan2(before[1] - here[1], before[0] - here[0])
                    k = max(range(len(choices)), key=lambda i: (math.atan2(choices[i][1] - here[1], choices[i][0] - here[0]) - back) % (2 * math.pi) or 2 * math.pi)
                before, here = here, choices.pop(k)
                if here == start:
                    break
                loop.append(here)
            loops.append(loop)
    shells, holes = [], []
    for loop in loops:
        ring = _straight([(x * SNAP, y * SNAP) for x, y in loop])
        if len(ring) >= 4:
            (shells if ring_area(ring) > 0 else holes).append(ring)
    shells.sort(key=lambda r: abs(ring_area(r)))
    shape = [[s] for s in shells]
    for hole in holes:
        x, y = (hole[0][0] + hole[1][0]) / 2, (hole[0][1] + hole[1][1]) / 2
        home = next((p for p in shape if contains(p[0], x, y)), None)
        if home is not None:
            home.append(hole)
    return shape


def _straight(loop: Ring) -> Ring:
    """A closed ring without vertices on a straight line. Vertices a few steps of the grid apart are one first, and each
    is held against the last one kept: of a corner that is two near vertices, one stays."""
    apart = lambda p, q: abs(p[0] - q[0]) + abs(p[1] - q[1]) > 4 * SNAP
    points: Ring = []
    for p in loop:
        if not points or apart(p, points[-1]):
            points.append(p)
    while len(points) > 1 and not apart(points[0], points[-1]):
        points.pop()
    kept: Ring = []
    for i, p in enumerate(points):
        a, b = kept[-1] if kept else points[-1], points[(i + 1) % len(points)]
        cross = (p[0] - a[0]) * (b[1] - p[1]) - (p[1] - a[1]) * (b[0] - p[0])
        if abs(cross) > 4 * SNAP * (abs(b[0] - a[0]) + abs(b[1] - a[1])):
            kept.append(p)
    return kept + kept[:1]


def contains(ring: Ring, x: float, y: float) -> bool:
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        if (ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay):
            inside = not inside
    return inside


def intersection(a: Shape, b: Shape) -> Shape:
    return sewn(list(trapezoids([a, b], lambda s: s == 3)))


def difference(a: Shape, b: list[Shape]) -> Shape:
    return sewn(list(trapezoids([a, *b], lambda s: s == 1)))


def union(shapes: list[Shape]) -> Shape:
    return sewn(list(trapezoids(shapes, lambda s: s != 0)))


def repaired(shape: Shape) -> tuple[Shape, bool]:
    """(a valid shape, whether the input was valid) (GEO2): crossings are resolved by the
    even-odd rule, what has no area goes. A shape with nothing left is empty."""
    clean = [[_closed(_distinct(ring)) for ring in polygon] for polygon in shape]
    clean = [[r for r in p if len(r) >= 4] for p in clean]
    clean = [p for p in clean if p]
    out = union([clean]) if clean else []
    plain = sum(abs(ring_area(p[0])) - sum(abs(ring_area(h)) for h in p[1:]) for p in clean)
    total = area(out)
    valid = bool(clean) and abs(plain - total) <= 1e-6 * max(1.0, total) and sum(map(len, out)) == sum(map(len, clean))
    return (clean if valid else out), valid


def _distinct(ring: Ring) -> Ring:
    return [p for i, p in enumerate(ring) if i == 0 or p != ring[i - 1]]


def _closed(ring: Ring) -> Ring:
    return ring if not ring or ring[0] == ring[-1] else ring + ring[:1]


def _to_segment(px: float, py: float, a: tuple, b: tuple) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = 0.0 if n == 0 else max(0.0, min(1.0, ((px - a[0]) * dx + (py - a[1]) * dy) / n))
    return math.hypot(px - a[0] - t * dx, py - a[1] - t * dy)


def depth(polygon: list[Ring], x: float, y: float) -> float:
    """Distance to the polygon's boundary, negative outside."""
    d = min(_to_segment(x, y, a, b) for ring in polygon for a, b in zip(ring, ring[1:], strict=False))
    inside = contains(polygon[0], x, y) and not any(contains(h, x, y) for h in polygon[1:])
    return d if inside else -d


def holds_circle(polygon: list[Ring], radius: float) -> bool:
    """Whether a circle fits in: what erosion by ``radius`` leaves something of. Cells of a
    quadtree are searched from the most promising one; a cell that can't hold it is dropped."""
    xs, ys = [p[0] for p in polygon[0]], [p[1] for p in polygon[0]]
    half = max(max(xs) - min(xs), max(ys) - min(ys)) / 2
    if half <= 0:
        return False
    start = ((min(xs) + max(xs)) / 2, (min(ys) + max(ys)) / 2)
    heap = [(-(depth(polygon, *start) + half * math.sqrt(2)), *start, half)]
    while heap:
        most, x, y, h = heapq.heappop(heap)
        if -most <= radius:
            return False
        d = depth(polygon, x, y)
        if d > radius:
            return True
        h /= 2
        if h < radius * 1e-4:
            continue
        for sx in (-h, h):
            for sy in (-h, h):
                top = depth(polygon, x + sx, y + sy) + h * math.sqrt(2)
                if top > radius:
                    heapq.heappush(heap, (-top, x + sx, y + sy, h))
    return False


#: Segments of one box of a shape's packed tree.
LEAF = 16


class Outline:
    """A shape's segments as an array (ax, ay, bx, by), with boxes around every ``LEAF`` in a row of them."""

    def __init__(self, arrays: flat.Flat, i: int):
        rings_ = slice(arrays.rings[arrays.polygons[i]], arrays.rings[arrays.polygons[i + 1]])
        first, last = arrays.points[:-1][rings_], arrays.points[1:][rings_]
        lo, hi = (int(first[0]), int(last[-1])) if len(first) else (0, 0)
        xy = np.stack([arrays.x[lo:hi], arrays.y[lo:hi]], axis=1)
        inner = np.ones(max(0, hi - lo), bool)
        inner[last - 1 - lo] = False  # no segment begins at a ring's last point
        at = np.flatnonzero(inner)
        self.segments = np.concatenate([xy[at], xy[at + 1]], axis=1)
        polygon = np.repeat(np.arange(arrays.polygons[i], arrays.polygons[i + 1]), np.diff(arrays.rings)[arrays.polygons[i] : arrays.polygons[i + 1]])
        self.polygon = np.repeat(polygon, last - first)[at]
        self.points = xy[first - lo] if len(first) else xy[:0]  # one of each ring
        cuts = np.arange(0, len(at), LEAF)
        ends = np.concatenate([self.segments[:, :2], self.segments[:, 2:]], axis=1).reshape(-1, 2, 2) if len(at) else np.zeros((0, 2, 2))
        low, high = ends.min(axis=1) if len(at) else ends[:, 0], ends.max(axis=1) if len(at) else ends[:, 0]
        self.low = np.minimum.reduceat(low, cuts) if len(at) else low
        self.high = np.maximum.reduceat(high, cuts) if len(at) else high

    def block(self, k: int) -> np.ndarray:
        return self.segments[k * LEAF : (k + 1) * LEAF]

    def holds(self, points: np.ndarray) -> bool:
        """Whether one of the points lies in one of the polygons (outside its holes)."""
        ax, ay, bx, by = self.segments.T
        for x, y in points:
            crosses = (ay > y) != (by > y)
            s = np.flatnonzero(crosses)
            right = s[x < ax[s] + (bx[s] - ax[s]) * (y - ay[s]) / (by[s] - ay[s])]
            if (np.unique(self.polygon[right], return_counts=True)[1] % 2).any():
                return True
        return False


def _apart(p: np.ndarray, q: np.ndarray) -> float:
    """Least squared distance of two sets of segments."""
    ax, ay, bx, by = (p[:, None, i] for i in range(4))
    cx, cy, dx, dy = (q[None, :, i] for i in range(4))
    side = lambda ox, oy, ux, uy, vx, vy: (ux - ox) * (vy - oy) - (uy - oy) * (vx - ox)
    if ((side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) < 0) & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) < 0)).any():
        return 0.0

    def to(px, py, ax, ay, bx, by):
        ux, uy = bx - ax, by - ay
        n = ux * ux + uy * uy
        t = np.clip(((px - ax) * ux + (py - ay) * uy) / np.where(n == 0, 1.0, n), 0.0, 1.0)
        return ((px - ax - t * ux) ** 2 + (py - ay - t * uy) ** 2).min()

    return float(min(to(ax, ay, cx, cy, dx, dy), to(bx, by, cx, cy, dx, dy), to(cx, cy, ax, ay, bx, by), to(dx, dy, ax, ay, bx, by)))


def apart(a: Outline, b: Outline) -> float:
    """Least distance of two shapes, 0 where they meet: pairs of boxes from the nearest on, until no box is nearer
    than what was found (a branch and bound over the packed trees)."""
    if not len(a.segments) or not len(b.segments):
        return math.inf
    gap = np.maximum(0.0, np.maximum(a.low[:, None] - b.high[None], b.low[None] - a.high[:, None]))
    least = (gap * gap).sum(axis=2)
    best = math.inf
    for k in np.argsort(least, axis=None, kind="stable").tolist():
        i, j = divmod(k, least.shape[1])
        if least[i, j] >= best:
            break
        best = min(best, _apart(a.block(i), b.block(j)))
        if best == 0:
            return 0.0
    return 0.0 if a.holds(b.points) or b.holds(a.points) else math.sqrt(best)


def distance(a: Shape, b: Shape) -> float:
    """``apart`` of shapes as lists."""
    both = flat.of(pa.array([to_rows(a), to_rows(b)], flat.SHAPE))
    return apart(Outline(both, 0), Outline(both, 1))


# ---- operators on DataFrames ----------------------------------------------------------------


def _pairwise(of: Callable[[Shape, Shape], float]):
    @F.pandas_udf("double")
    def measured(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([of(from_rows(x), from_rows(y)) for x, y in zip(a, b, strict=True)], dtype="float64")

    return measured


def intersection_area(a, b):
    """Common area of two shape columns (GEO6)."""
    return _pairwise(overlay_area)(a, b)


def shape_distance(a, b):
    """Least distance of two shape columns, 0 where they meet, infinite for an empty one."""

    @F.arrow_udf("double")
    def measured(one: pa.Array, other: pa.Array) -> pa.Array:
        p, q = flat.of(one), flat.of(other)
        return pa.array([apart(Outline(p, i), Outline(q, i)) for i in range(len(one))], pa.float64())

    return measured(a, b)


def repair(units: DataFrame, shape: str = "shape") -> DataFrame:
    """``shape`` made valid, with was_valid, area_before and area_after; an empty one is null (GEO2, GEO3).

    A batch is judged as flat arrays (``flat.sound``); only shapes in doubt become Python objects and are overlaid."""

    def fixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(shape)
            column = batch.column(at)
            arrays = flat.of(column)
            valid, before = flat.sound(arrays), flat.areas(arrays)
            after, odd, made = before.copy(), np.flatnonzero(~valid), []
            for i in odd.tolist():
                out, valid[i] = repaired(from_rows(column[i].as_py()))
                before[i], after[i] = area(from_rows(column[i].as_py())), area(out)
                made.append(to_rows(out) or None)
            if len(odd):
                place = np.arange(len(column))
                place[odd] = len(column) + np.arange(len(odd))
                column = pa.concat_arrays([column.cast(flat.SHAPE), pa.array(made, flat.SHAPE)]).take(pa.array(place))
            names = [c for c in batch.schema.names if c != shape]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), column.cast(flat.SHAPE), pa.array(valid), pa.array(before), pa.array(after)], [*names, shape, "was_valid", "area_before", "area_after"])

    facts = ("was_valid", "area_before", "area_after", "is_empty")
    rows = units.drop(*facts)
    kept = [f for f in rows.schema.fields if f.name != shape]
    kind = T.StructType([*kept, rows.schema[shape], T.StructField("was_valid", T.BooleanType()), T.StructField("area_before", T.DoubleType()), T.StructField("area_after", T.DoubleType())])
    return rows.select(*(f.name for f in kept), shape).mapInArrow(fixed, kind).withColumn("is_empty", F.col(shape).isNull())


def fuzzy_contiguity(pairs: DataFrame, buffer: float, scope: list[str]) -> DataFrame:
    """Edges between units that meet once both are widened by ``buffer`` metres (GR3).
    ``pairs``: what quality.box_pairs makes with grow=buffer."""
    return pairs.where(shape_distance(F.col("s_a"), F.col("s_b")) <= 2 * buffer + 1e-9).select(*scope, F.col("id_a").alias("src"), F.col("id_b").alias("dst"))


def hexagon_pieces(gap: Shape, cell_area: float, min_fragment: float, most: int | None, width: float | None, fraction: float | None) -> tuple[list[Shape], int]:
    """(pieces of a hexagon grid over a void, grid cells left out by a limit of ``most`` pieces, if there is one) (GEO11)."""
    radius = math.sqrt(2 * cell_area / (3 * math.sqrt(3)))
    xs, ys = [p[0] for r in gap[0][:1] for p in r], [p[1] for r in gap[0][:1] for p in r]
    wide, high, pad = math.sqrt(3) * radius, 1.5 * radius, 2 * radius
    centres = []
    for row in range(int((max(ys) - min(ys) + 2 * pad) / high + 1e-9) + 1):
        shift = wide / 2 if row % 2 else 0.0
        for column in range(int((max(xs) - min(xs) + 2 * pad - shift) / wide + 1e-9) + 1):
            centres.append((min(xs) - pad + shift + column * wide, min(ys) - pad + row * high))
    out: list[Shape] = []
    for i, (cx, cy) in enumerate(centres):
        if most is not None and len(out) >= most:
            return out, len(centres) - i
        if cx + radius < min(xs) or cx - radius > max(xs) or cy + radius < min(ys) or cy - radius > max(ys):
            continue
        corners = [(cx + radius * math.cos(math.pi / 6 + k * math.pi / 3), cy + radius * math.sin(math.pi / 6 + k * math.pi / 3)) for k in range(6)]
        for polygon in intersection(gap, [[corners + corners[:1]]]):
            if area([polygon]) >= min_fragment and good_piece(polygon, cell_area, width, fraction):
                out.append([polygon])
                if most is not None and len(out) >= most:
                    return out, len(centres) - i - 1
    return out, 0


def good_piece(polygon: list[Ring], cell_area: float, width: float | None, fraction: float | None) -> bool:
    """Not thinner than ``width``, not smaller than ``fraction`` of a cell."""
    if width and width > 0 and not holds_circle(polygon, width / 2):
        return False
    return not (fraction and fraction > 0) or area([polygon]) >= fraction * cell_area


def parted_voids(gaps: list[Shape], cell_area: float | None, part_from: float, min_fragment: float, most: int | None = None, width: float | None = 30.0, fraction: float | None = None) -> tuple[list[Shape], int, int]:
    """(pieces, cells left out, pieces dropped for their quality): large voids as hexagons, small ones whole (GEO12)."""
    gaps = [[p] for g in gaps for p in g if p]
    if cell_area is None:
        return gaps, 0, 0
    final: list[Shape] = []
    left_out = 0
    for gap in gaps:
        a = area(gap)
        cells: list[Shape] = []
        if a >= part_from:
            cells, n = hexagon_pieces(gap, cell_area, min_fragment, most, width, fraction)
            left_out += n
        if cells:
            final += cells
        elif a >= min_fragment:
            final.append(gap)
    kept = final
    if (width and width > 0) or (fraction and fraction > 0):
        kept = [g for g in final if area(g) >= min_fragment and good_piece(g[0], cell_area, width, fraction)]
    return kept, left_out, len(final) - len(kept)


def ring_centroid(ring: Ring) -> tuple[float, float]:
    a = ring_area(ring)
    if a == 0:
        return sum(p[0] for p in ring) / len(ring), sum(p[1] for p in ring) / len(ring)
    cross = [(p, q, p[0] * q[1] - q[0] * p[1]) for p, q in zip(ring, ring[1:], strict=False)]
    return sum((p[0] + q[0]) * c for p, q, c in cross) / (6 * a), sum((p[1] + q[1]) * c for p, q, c in cross) / (6 * a)
