"""Shapes of a whole Arrow batch as flat arrays: offsets and coordinates, WKB, and validity by a sorted sweep.

A batch's shapes are five arrays: where each shape's polygons, each polygon's rings and each ring's points begin, and x
and y. No Python object is made for a point, or for a shape that is sound.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
SHAPE = pa.list_(pa.list_(pa.list_(POINT)))

#: Pairs of segments compared at a time.
PAIRS = 1 << 20


@dataclass
class Flat:
    known: np.ndarray  # which shapes aren't null
    polygons: np.ndarray  # where each shape's polygons begin, and the last's end
    rings: np.ndarray
    points: np.ndarray
    x: np.ndarray
    y: np.ndarray


def _level(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets from 0, values) of a list array; null lists are empty."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate(([0], np.cumsum(size))), column.flatten()


def of(column: pa.Array) -> Flat:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    known = column.is_valid().to_numpy(zero_copy_only=False)
    polygons, inner = _level(column)
    rings, inner = _level(inner)
    points, inner = _level(inner)
    x, y = (pc.fill_null(c, float("nan")).to_numpy(zero_copy_only=False) for c in inner.flatten())
    return Flat(known, polygons, rings, points, x, y)


def to_arrow(flat: Flat) -> pa.Array:
    at = lambda offsets: pa.array(offsets.astype(np.int32))
    points = pa.StructArray.from_arrays([pa.array(flat.x), pa.array(flat.y)], fields=list(POINT))
    rings = pa.ListArray.from_arrays(at(flat.points), points)
    polygons = pa.ListArray.from_arrays(at(flat.rings), rings)
    return pa.ListArray.from_arrays(at(flat.polygons), polygons, mask=pa.array(~flat.known) if len(flat.known) and not flat.known.all() else None)


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, … for each of the spans."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def to_wkb(flat: Flat) -> pa.Array:
    """Little-endian WKB multipolygons."""
    n_points, n_rings, n_polygons = np.diff(flat.points), np.diff(flat.rings), np.diff(flat.polygons)
    ring_size = 4 + 16 * n_points
    before = np.concatenate(([0], np.cumsum(ring_size)))
    polygon_size = 9 + before[flat.rings[1:]] - before[flat.rings[:-1]]
    before_polygon = np.concatenate(([0], np.cumsum(polygon_size)))
    shape_size = np.where(flat.known, 9 + before_polygon[flat.polygons[1:]] - before_polygon[flat.polygons[:-1]], 0)
    shape_at = np.concatenate(([0], np.cumsum(shape_size)))
    owner = np.repeat(np.arange(len(n_polygons)), n_polygons)
    polygon_at = before_polygon[:-1] + 9 * np.cumsum(flat.known)[owner]
    ring_owner = np.repeat(np.arange(len(n_rings)), n_rings)
    ring_at = polygon_at[ring_owner] + 9 + before[:-1] - before[flat.rings[:-1]][ring_owner]
    out = np.zeros(int(shape_at[-1]), np.uint8)

    def put(at: np.ndarray, values: np.ndarray) -> None:
        if len(at):
            raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(at), -1)
            out[at[:, None] + np.arange(raw.shape[1])] = raw

    heads = shape_at[:-1][flat.known]
    for at, kind, count in ((heads, 6, n_polygons[flat.known]), (polygon_at, 3, n_rings)):
        out[at] = 1
        put(at + 1, np.full(len(at), kind, "<u4"))
        put(at + 5, count.astype("<u4"))
    put(ring_at, n_points.astype("<u4"))
    put(spans(np.zeros(len(ring_at), np.int64), n_points) * 16 + np.repeat(ring_at + 4, n_points), np.stack([flat.x, flat.y], axis=1).astype("<f8"))
    binary = pa.Array.from_buffers(pa.large_binary(), len(shape_size), [None, pa.py_buffer(shape_at.astype(np.int64)), pa.py_buffer(out)])
    return pc.if_else(pa.array(flat.known), binary, pa.scalar(None, pa.large_binary())).cast(pa.binary())


def from_wkb(column: pa.Array) -> Flat:
    """Polygons and multipolygons of either byte order; points are read a ring at a time."""
    polygons, rings, points, parts = [0], [0], [0], []

    def read(data: memoryview, at: int) -> int:
        order = "<" if data[at] else ">"
        kind, n = struct.unpack_from(f"{order}II", data, at + 1)
        at += 9
        if kind % 1000 == 6:
            for _ in range(n):
                at = read(data, at)
            return at
        if kind != 3:
            raise ValueError(f"geometry kind {kind} is no polygon in two dimensions")
        for _ in range(n):
            (m,) = struct.unpack_from(f"{order}I", data, at)
            parts.append(np.frombuffer(data, f"{order}f8", 2 * m, at + 4).astype(np.float64).reshape(m, 2))
            points.append(points[-1] + m)
            at += 4 + 16 * m
        rings.append(len(points) - 1)
        return at

    for value in column:
        if value.is_valid:
            read(memoryview(value.as_buffer()), 0)
        polygons.append(len(rings) - 1)
    xy = np.concatenate(parts) if parts else np.zeros((0, 2))
    return Flat(column.is_valid().to_numpy(zero_copy_only=False), *(np.array(v, np.int64) for v in (polygons, rings, points)), np.ascontiguousarray(xy[:, 0]), np.ascontiguousarray(xy[:, 1]))


def bounds(flat: Flat) -> np.ndarray | None:
    """(minx, miny, maxx, maxy) of all shapes."""
    return np.array([flat.x.min(), flat.y.min(), flat.x.max(), flat.y.max()]) if len(flat.x) else None


def ring_areas(flat: Flat) -> np.ndarray:
    """Signed, of closed rings."""
    if not len(flat.x):
        return np.zeros(len(flat.points) - 1)
    cross = np.zeros(len(flat.x))
    cross[:-1] = flat.x[:-1] * flat.y[1:] - flat.x[1:] * flat.y[:-1]
    last = flat.points[1:] - 1
    cross[last[np.diff(flat.points) > 0]] = 0.0
    # Each ring is summed by itself: a running sum over a batch would round differently.
    out = np.zeros(len(flat.points) - 1)
    full = np.flatnonzero(np.diff(flat.points))
    out[full] = np.add.reduceat(cross, flat.points[:-1][full]) / 2
    return out


def areas(flat: Flat) -> np.ndarray:
    """Of each shape: shells less holes."""
    size = np.abs(ring_areas(flat))
    hole = np.ones(len(size), bool)
    hole[flat.rings[:-1][np.diff(flat.rings) > 0]] = False
    ends = flat.rings[flat.polygons]
    out = np.zeros(len(ends) - 1)
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        out[full] = np.add.reduceat(np.where(hole, -size, size), ends[:-1][full])
    return out


def sound(flat: Flat) -> np.ndarray:
    """Which shapes are surely valid: closed rings of four points or more without repeats, no two of whose segments meet but
    at the ends of neighbours, holes within their shell and outside each other, shells outside other polygons.

    The segments of each shape are sorted by their least x; each is compared with those that begin before it ends. A shape
    in doubt (rings that touch, say) is not called sound.
    """
    n_shapes = len(flat.polygons) - 1
    n_points = np.diff(flat.points)
    ring_shape = np.repeat(np.arange(n_shapes), flat.rings[flat.polygons[1:]] - flat.rings[flat.polygons[:-1]])
    good = flat.known & (np.diff(flat.polygons) > 0)
    bad_ring = n_points < 4
    full = np.flatnonzero(~bad_ring)
    first, last = flat.points[:-1][full], flat.points[1:][full] - 1
    bad_ring[full] = (flat.x[first] != flat.x[last]) | (flat.y[first] != flat.y[last])
    empty_polygon = np.diff(flat.rings) == 0
    polygon_shape = np.repeat(np.arange(n_shapes), np.diff(flat.polygons))
    good[ring_shape[bad_ring]] = False
    good[polygon_shape[empty_polygon]] = False
    wrong = ~(np.isfinite(flat.x) & np.isfinite(flat.y))
    point_ring = np.repeat(np.arange(len(n_points)), n_points)
    good[ring_shape[point_ring[wrong]]] = False
    # Segments of the shapes still good.
    use = np.flatnonzero(good[ring_shape[point_ring]]) if len(point_ring) else np.zeros(0, np.int64)
    use = use[use + 1 < flat.points[point_ring[use] + 1]]
    if not len(use):
        return good
    ax, ay, bx, by = flat.x[use], flat.y[use], flat.x[use + 1], flat.y[use + 1]
    ring = point_ring[use]
    shape = ring_shape[ring]
    good[shape[(ax == bx) & (ay == by)]] = False
    low, high = np.minimum(ax, bx), np.maximum(ax, bx)
    order = np.lexsort((low, shape))
    ax, ay, bx, by, ring, shape, low, high, use = (v[order] for v in (ax, ay, bx, by, ring, shape, low, high, use))
    # Rank of (shape, high) among the sorted (shape, low): how far each segment's partners reach.
    both = np.lexsort((np.concatenate([np.zeros(len(low)), np.ones(len(high))]), np.concatenate([low, high]), np.concatenate([shape, shape])))
    is_low = both < len(low)
    reach = np.empty(len(low), np.int64)
    reach[both[~is_low] - len(low)] = np.cumsum(is_low)[~is_low]
    partners = reach - np.arange(len(low)) - 1
    cuts = np.concatenate(([0], np.cumsum(partners)))
    lo = 0
    while lo < len(low):
        hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + PAIRS, "right")) - 1)
        i = np.repeat(np.arange(lo, hi), partners[lo:hi])
        j = spans(np.arange(lo, hi) + 1, partners[lo:hi])
        near = (np.maximum(np.minimum(ay[i], by[i]), np.minimum(ay[j], by[j])) <= np.minimum(np.maximum(ay[i], by[i]), np.maximum(ay[j], by[j]))) & good[shape[i]]
        i, j = i[near], j[near]
        side = lambda px, py, qx, qy, rx, ry: np.sign((qx - px) * (ry - py) - (qy - py) * (rx - px))
        s1, s2 = side(ax[i], ay[i], bx[i], by[i], ax[j], ay[j]), side(ax[i], ay[i], bx[i], by[i], bx[j], by[j])
        s3, s4 = side(ax[j], ay[j], bx[j], by[j], ax[i], ay[i]), side(ax[j], ay[j], bx[j], by[j], bx[i], by[i])
        meet = (s1 * s2 <= 0) & (s3 * s4 <= 0)
        # Neighbours share one end; they may not run back over each other.
        size = n_points[ring[i]] - 1
        step = (use[j] - use[i]) % size
        neighbours = (ring[i] == ring[j]) & ((step == 1) | (step == size - 1))
        dot = (bx[i] - ax[i]) * (bx[j] - ax[j]) + (by[i] - ay[i]) * (by[j] - ay[j])
        straight = (s1 == 0) & (s2 == 0)
        fine = neighbours & (~straight | (dot > 0)) & (size > 2)
        good[shape[i[meet & ~fine]]] = False
        lo = hi
    return good & ~_misplaced(flat, good, ring_shape, n_shapes)


def _misplaced(flat: Flat, good: np.ndarray, ring_shape: np.ndarray, n_shapes: int) -> np.ndarray:
    """Shapes of several rings, none of which cross, that don't lie as shells and holes must."""
    out = np.zeros(n_shapes, bool)
    per = np.bincount(ring_shape, minlength=n_shapes)
    polygon_of = np.repeat(np.arange(len(flat.rings) - 1), np.diff(flat.rings))
    is_shell = np.zeros(len(ring_shape), bool)
    is_shell[flat.rings[:-1][np.diff(flat.rings) > 0]] = True
    for s in np.flatnonzero(good & (per > 1)).tolist():  # few: most shapes are one ring
        rings_ = np.arange(flat.rings[flat.polygons[s]], flat.rings[flat.polygons[s + 1]])
        inside = np.zeros((len(rings_), len(rings_)), bool)  # whether a ring's first point lies in another
        px, py = flat.x[flat.points[rings_]], flat.y[flat.points[rings_]]
        for b, r in enumerate(rings_):
            x, y = flat.x[flat.points[r] : flat.points[r + 1]], flat.y[flat.points[r] : flat.points[r + 1]]
            crosses = (y[:-1] > py[:, None]) != (y[1:] > py[:, None])
            with np.errstate(divide="ignore", invalid="ignore"):
                at = x[:-1] + (x[1:] - x[:-1]) * (py[:, None] - y[:-1]) / (y[1:] - y[:-1])
            inside[:, b] = ((crosses & (px[:, None] < at)).sum(axis=1) % 2) == 1
        np.fill_diagonal(inside, False)
        own = polygon_of[rings_][:, None] == polygon_of[rings_]
        shell = is_shell[rings_]
        holes = ~shell
        lies = (inside & own & shell).any(axis=1)  # in its own shell
        elsewhere = np.zeros(len(rings_), bool)
        for p in np.unique(polygon_of[rings_]):
            of_p = polygon_of[rings_] == p
            other = ~of_p & shell
            elsewhere |= other & (inside[:, of_p].sum(axis=1) % 2 == 1)
        out[s] = (holes & ~lies).any() or (inside[:, holes] & own[:, holes] & holes[:, None]).any() or elsewhere.any()
    return out
