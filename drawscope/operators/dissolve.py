"""What units cover of their county's shell and what they leave, tile by tile.

Shapes are dealt to the tiles of ``tiles.dealt`` and cut at their borders, so a shell or a large unit goes
piecewise to many tasks, and a task has one tile's shapes (some tens) whatever a county's size.
In a tile the slab overlay of ``shapes`` finds areas, or the pieces that no unit covers. Pieces of neighbouring tiles that share
a stretch of border are one void: their links give components (``components``), and where the pieces of a void are put together
border edges that run both ways vanish. Only that last step holds one void, which is one row of the result.

A buffer is a Minkowski sum, so a union needs no outline to be widened: every unit brings a rectangle for each edge
and a sector for each corner that opens, and whatever lies in any of them is covered. A shell that shrinks
loses the same band inside its outline. Arcs have ``ARC`` steps a quarter circle, so a widened area falls short of the exact one
by under 0.1 % of its circular parts.

Defined cases: null and empty shapes cover nothing; shells of one county are united; overlapping units count once; crossing rings
are read by the even-odd rule; units without a shell, and empty tables, give no rows; a county without units is one void (but its
coverage is 0).
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cuts, flat, rings
from ..functions.cuts import ARC
from ..scratch import materialise
from . import shapes, tiles
from .components import components
from .shapes import SNAP, Ring, Shape

MOST = 24
#: Tiles of a shape from which it is halved with them, and shapes that are cut at a time.
MANY, AT_A_TIME = 64, 512
#: Tiles of one level that are overlaid at a time: a square of so many a side.
SIDE = 4
#: Pieces of voids that are put together at a time, on average.
PIECES = 256
UNIT, SHELL, CUT = 0, 1, 2

_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_SHAPE = pa.list_(pa.list_(pa.list_(_POINT)))
_TOUCH = pa.list_(pa.struct([("axis", pa.int32()), ("line", pa.int64()), ("upper", pa.bool_()), ("lo", pa.float64()), ("hi", pa.float64())]))


def band(shape: Shape, reach: float, inward: bool = False) -> list[Shape]:
    """Rectangles and sectors that cover all points within ``reach`` of the outline, on its outer or inner side."""
    out: list[Shape] = []
    for polygon in shape:
        for hole, ring in enumerate(polygon):
            turn = -1 if (shapes.ring_area(ring) > 0) == bool(hole) else 1  # shells go left round, holes right
            around = ring[::turn][:-1]
            points = [p for i, p in enumerate(around) if p != around[i - 1]]
            if len(points) < 2:
                continue
            side = -1.0 if inward else 1.0
            steps = []
            for i, (ax, ay) in enumerate(points):
                bx, by = points[(i + 1) % len(points)]
                n = math.hypot(bx - ax, by - ay)
                steps.append(((bx - ax) / n, (by - ay) / n))
                nx, ny = side * reach * steps[-1][1], -side * reach * steps[-1][0]
                out.append([[[(ax, ay), (bx, by), (bx + nx, by + ny), (ax + nx, ay + ny), (ax, ay)]]])
            for i, (x, y) in enumerate(points):
                (ux, uy), (vx, vy) = steps[i - 1], steps[i]
                angle = math.atan2(ux * vy - uy * vx, ux * vx + uy * vy)
                if angle * side <= 0:
                    continue
                first = math.atan2(-side * ux, side * uy)
                n = max(1, math.ceil(abs(angle) / (math.pi / 2 / ARC) - 1e-9))
                arc = [(x + reach * math.cos(first + angle * k / n), y + reach * math.sin(first + angle * k / n)) for k in range(n + 1)]
                out.append([[[(x, y), *arc, (x, y)]]])
    return out


def _half(ring: Ring, axis: int, at: float, upper: bool) -> Ring:
    """What of an open ring lies on one side of a line; the line's own stretches join it. Vertices that match the line on
    the snap grid lie on it, for the tiles on both of its sides."""
    near = lambda v: at if abs(v - at) <= 8 * SNAP else v
    ring = [(near(p[0]), p[1]) if axis == 0 else (p[0], near(p[1])) for p in ring]
    out: Ring = []
    for i, q in enumerate(ring):
        p = ring[i - 1]
        p_in, q_in = (p[axis] >= at, q[axis] >= at) if upper else (p[axis] <= at, q[axis] <= at)
        if p_in != q_in:
            t = (at - p[axis]) / (q[axis] - p[axis])
            other = p[1 - axis] + t * (q[1 - axis] - p[1 - axis])
            out.append((at, other) if axis == 0 else (other, at))
        if q_in:
            out.append(q)
    return out


def clipped(polygon: list[Ring], box: tuple[float, float, float, float]) -> list[Ring]:
    """Open rings of a polygon within a box. By the even-odd rule they are the part of it that lies there."""
    out = []
    for ring in polygon:
        for axis, at, upper in ((0, box[0], True), (1, box[1], True), (0, box[2], False), (1, box[3], False)):
            ring = _half(ring, axis, at, upper)
        if len(ring) >= 3:
            out.append(ring)
    return out


def _deal(polygon: list[Ring], boxes: list[tuple]) -> Iterator[tuple[tuple, list[Ring]]]:
    """(tile, part) of open rings; boxes: (minx, miny, maxx, maxy, tile). Halves of the tiles first, so a long
    outline is not cut once a tile."""
    around = (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes))
    part = clipped(polygon, around)
    if not part:
        return
    if len(boxes) == 1:
        yield boxes[0][4], part
        return
    axis = 0 if around[2] - around[0] >= around[3] - around[1] else 1
    boxes = sorted(boxes, key=lambda b: (b[axis], b[1 - axis]))
    for half in (boxes[: len(boxes) // 2], boxes[len(boxes) // 2 :]):
        yield from _deal(part, half)


def _box(x0: float, y0: float, side: float, level: int, ix: int, iy: int) -> tuple[float, float, float, float]:
    size = side / 2.0**level
    return x0 + ix * size, y0 + iy * size, x0 + (ix + 1) * size, y0 + (iy + 1) * size


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


class _Outlines:
    """Polygons of open rings, gathered as flat arrays: each has its shape's row and a kind."""

    def __init__(self):
        self.x, self.y, self.size, self.rings, self.row, self.kind = ([] for _ in range(6))

    def add(self, x: np.ndarray, y: np.ndarray, size: np.ndarray, rings_: np.ndarray, row: np.ndarray, kind: np.ndarray) -> None:
        """size: points of each ring; rings_: rings of each polygon."""
        for held, new in zip((self.x, self.y, self.size, self.rings, self.row, self.kind), (x, y, size, rings_, row, kind), strict=True):
            held.append(np.asarray(new))

    def polygon(self, rings_: list[Ring], *names: int) -> None:
        points = np.array([p for ring in rings_ for p in ring]).reshape(-1, 2)
        self.add(points[:, 0], points[:, 1], [len(ring) for ring in rings_], [len(rings_)], *([n] for n in names))

    def arrays(self) -> tuple:
        """(x, y, where rings begin, where polygons begin, row, kind)"""
        x, y = (np.concatenate([np.zeros(0), *v]) for v in (self.x, self.y))
        size, rings_, row, kind = (np.concatenate([np.zeros(0, np.int64), *v]).astype(np.int64) for v in (self.size, self.rings, self.row, self.kind))
        return x, y, np.append(0, np.cumsum(size)), np.append(0, np.cumsum(rings_)), row, kind


def _outlines(batch: pa.RecordBatch, reach: np.ndarray) -> tuple:
    """What the shapes of a batch bring, as ``_Outlines.arrays``: their polygons, and what their buffers add. A convex polygon
    brings its widened outline alone; any other one its band."""
    shape = flat.of(batch.column("shape"))
    x, y, points = cuts.opened(shape.x, shape.y, shape.points)
    n_polygons, n_rings = np.diff(shape.polygons), np.diff(shape.rings)
    row = np.repeat(np.arange(len(n_polygons)), n_polygons)
    kind = _numbers(batch, "kind")[row].astype(np.int64)
    out = _Outlines()
    single = np.flatnonzero((n_rings == 1) & (reach[row] > 0))
    convex, *wide = cuts.widened(*cuts.taken(x, y, points, shape.rings[:-1][single]), reach[row[single]])
    grown = single[convex]
    out.add(*wide[:2], np.diff(wide[2])[convex], np.ones(len(grown), np.int64), row[grown], kind[grown])
    plain = np.ones(len(row), bool)
    plain[grown] = False
    at = flat.spans(shape.rings[:-1][plain], n_rings[plain])
    px, py, pp = cuts.taken(x, y, points, at)
    out.add(px, py, np.diff(pp), n_rings[plain], row[plain], kind[plain])
    for i in np.flatnonzero(plain & (reach[row] != 0)).tolist():
        polygon = [list(zip(shape.x[a:b].tolist(), shape.y[a:b].tolist(), strict=True)) for a, b in zip(shape.points[shape.rings[i] : shape.rings[i + 1]], shape.points[1:][shape.rings[i] : shape.rings[i + 1]], strict=True)]
        near = float(reach[row[i]])
        for piece in band([polygon], abs(near), near < 0):
            out.polygon([piece[0][0][:-1]], row[i], kind[i] if near > 0 else CUT)
    return out.arrays()


def _cut(batch: pa.RecordBatch, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, flat.Flat]:
    """(row, tile of the batch, kind, parts): what the shapes of a batch bring to each of their tiles."""
    x, y, points, polygons, row, kind = _outlines(batch, reach)
    tiles_ = batch.column("tiles").flatten()
    n_tiles = pc.list_value_length(batch.column("tiles")).to_numpy(zero_copy_only=False).astype(np.int64)
    level, ix, iy = (tiles_.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    first = np.cumsum(n_tiles) - n_tiles
    x0, y0, side = (np.repeat(_numbers(batch, c), n_tiles) for c in ("x0", "y0", "side"))
    box = _box(x0, y0, side, level, ix, iy)
    # A polygon and a tile of its shape, if their bounds share more than a border.
    few = np.flatnonzero(n_tiles[row] < MANY)
    count = n_tiles[row[few]]
    polygon, tile = np.repeat(few, count), flat.spans(first[row[few]], count)
    low_x, low_y, high_x, high_y = cuts.bounds(x, y, points[polygons])
    near = 8 * SNAP
    meets = (low_x[polygon] < box[2][tile] - near) & (high_x[polygon] > box[0][tile] + near) & (low_y[polygon] < box[3][tile] - near) & (high_y[polygon] > box[1][tile] + near)
    polygon, tile = polygon[meets], tile[meets]
    within = (low_x[polygon] > box[0][tile] + near) & (high_x[polygon] < box[2][tile] - near) & (low_y[polygon] > box[1][tile] + near) & (high_y[polygon] < box[3][tile] - near)
    found: list[tuple] = []  # (x, y, ring sizes, place in the result of each ring)
    places: list[tuple] = [(polygon, tile)]
    for inner in (True, False):
        pair = np.flatnonzero(within == inner)
        n = np.diff(polygons)[polygon[pair]]
        pair = np.repeat(pair, n)
        rx, ry, rp = cuts.taken(x, y, points, flat.spans(polygons[:-1][polygon[within == inner]], n))
        if not inner:
            for side_, (axis, upper) in enumerate(((0, True), (1, True), (0, False), (1, False))):
                rx, ry, rp = cuts.half(rx, ry, rp, axis, box[side_][tile[pair]], upper, near)
        found.append((rx, ry, np.diff(rp), pair))
    done = len(polygon)
    for i in np.flatnonzero(n_tiles[row] >= MANY).tolist():
        rings_ = [list(zip(x[a:b].tolist(), y[a:b].tolist(), strict=True)) for a, b in zip(points[polygons[i] : polygons[i + 1]], points[1:][polygons[i] : polygons[i + 1]], strict=True)]
        mine = range(first[row[i]], first[row[i]] + n_tiles[row[i]])
        dealt = list(_deal(rings_, [(*(float(b[t]) for b in box), t) for t in mine]))
        xy = np.array([p for _, part in dealt for ring in part for p in ring]).reshape(-1, 2)
        found.append((xy[:, 0], xy[:, 1], np.array([len(ring) for _, part in dealt for ring in part], np.int64), np.repeat(done + np.arange(len(dealt)), [len(part) for _, part in dealt])))
        places.append((np.full(len(dealt), i), np.array([t for t, _ in dealt], np.int64)))
        done += len(dealt)
    polygon, tile = (np.concatenate(v).astype(np.int64) for v in zip(*places, strict=True))
    rx, ry, size, pair = (np.concatenate(v) for v in zip(*found, strict=True))
    rp = np.append(0, np.cumsum(size))
    order = np.lexsort((pair, kind[polygon[pair]], tile[pair]))
    order = order[size[order] >= 3]
    pair = pair[order]
    rx, ry, rp = cuts.taken(rx, ry, rp, order)
    # Rings are closed: each ends with its first point.
    size = np.diff(rp)
    at = flat.spans(rp[:-1], size + 1)
    at[np.cumsum(size + 1) - 1] = rp[:-1]
    pieces = np.flatnonzero(np.diff(pair, prepend=-1))
    mine = pair[pieces]
    rows = np.flatnonzero((np.diff(tile[mine], prepend=-1) != 0) | (np.diff(kind[polygon[mine]], prepend=-1) != 0))
    ends = lambda starts, n: np.append(starts, n).astype(np.int64)
    parts = flat.Flat(np.ones(len(rows), bool), ends(rows, len(pieces)), ends(pieces, len(pair)), np.append(0, np.cumsum(size + 1)), rx[at], ry[at])
    mine = mine[rows]
    return row[polygon[mine]], tile[mine], kind[polygon[mine]], parts


def _parted(units: DataFrame, shells: DataFrame, scope: list[str], shell_buffer: float, unit_buffer: float, most: int) -> DataFrame:
    """(scope, x0, y0, side, level, ix, iy, kind, parts): each shape's parts in each tile it meets, as WKB: that travels as one value."""
    one = lambda df, kind: df.where(F.size("shape") > 0).select(*scope, F.lit(kind).alias("kind"), "shape")
    rows = materialise(one(units, UNIT).unionByName(one(shells, SHELL)).withColumn("row", F.monotonically_increasing_id()), "shapes")
    b = rings.bounds(F.col("shape"))
    grow = F.when(F.col("kind") == UNIT, F.lit(max(unit_buffer, 0.0))).otherwise(F.lit(max(shell_buffer, 0.0)))
    boxes = rows.select(*scope, "row", *((b[n] + (-grow if n.startswith("min") else grow)).alias(n) for n in tiles.BOUNDS))
    dealt = tiles.dealt(boxes, scope, most)
    where = dealt.groupBy("row").agg(F.first("x0").alias("x0"), F.first("y0").alias("y0"), F.first("side").alias("side"), F.collect_list(F.struct(*tiles.TILE)).alias("tiles"))
    kinds = {f.name: f.dataType for f in rows.schema}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, AT_A_TIME):
                part = batch.slice(lo, AT_A_TIME)
                reach = np.where(_numbers(part, "kind") == UNIT, unit_buffer, shell_buffer)
                row, tile, kind, parts = _cut(part, reach)
                tiles_ = part.column("tiles").flatten()
                columns = [*((s, part.column(s).take(pa.array(row))) for s in (*scope, "x0", "y0", "side")), *((t, tiles_.field(i).take(pa.array(tile)).cast(k)) for i, (t, k) in enumerate(zip(tiles.TILE, (pa.int32(), pa.int64(), pa.int64()), strict=True))), ("kind", pa.array(kind, pa.int32())), ("parts", flat.to_wkb(parts))]
                yield pa.RecordBatch.from_arrays([c for _, c in columns], [n for n, _ in columns])

    kept = rows.join(where.hint("merge"), "row").select(*scope, "kind", "shape", "x0", "y0", "side", "tiles")
    named = ", ".join(f"{s} {kinds[s].simpleString()}" for s in scope)
    return kept.mapInArrow(cut, f"{named}, x0 double, y0 double, side double, level int, ix bigint, iy bigint, kind int, parts binary")


def _squares(parted: DataFrame, scope: list[str]):
    """Parts grouped by squares of ``SIDE`` x ``SIDE`` tiles, so that a call of Python has more than a few shapes."""
    return parted.groupBy(*scope, "level", *(F.floor(F.col(i) / SIDE).alias(f"{i}_square") for i in ("ix", "iy")))


def _strips(table: pa.Table) -> tuple[shapes.Strips, list[tuple]]:
    """(overlay of the parts in a square of tiles, the tiles' (ix, iy)); kinds: UNIT, SHELL, and CUT, what shells lose."""
    parts = flat.from_wkb(table["parts"].combine_chunks())
    size = np.diff(parts.points)
    begins = np.ones(len(parts.x), bool)
    begins[parts.points[1:][size > 0] - 1] = False  # no edge begins at a ring's last point
    at = np.flatnonzero(begins)
    polygon = np.repeat(np.repeat(np.arange(len(parts.rings) - 1), np.diff(parts.rings)), size)[at]
    row = np.repeat(np.arange(len(parts.known)), np.diff(parts.polygons))[polygon]
    places, tile = np.unique(np.stack([table[i].to_numpy() for i in ("ix", "iy")], axis=1), axis=0, return_inverse=True)
    edges = np.stack([parts.x[at], parts.y[at], parts.x[at + 1], parts.y[at + 1]], axis=1)
    return shapes.Strips(edges, polygon, table["kind"].to_numpy()[row], tile.reshape(-1)[row], 3), [tuple(p) for p in places.tolist()]


def _one(table: pa.Table, columns: list[str]) -> dict:
    return {c: table[c][0].as_py() for c in columns}


def shell_coverage(units: DataFrame, shells: DataFrame, scope: list[str] | None = None, shell_buffer: float = 0.0, unit_buffer: float = 0.0, most: int = MOST) -> DataFrame:
    """Per county: area of the shell, of the units' union, of its part in the shell, and of the void (AGG25):
    sums over tiles, nothing is put together."""
    scope = scope or ["county"]

    def measured(table: pa.Table) -> pa.Table:
        strips, _ = _strips(table)
        unit, shell, cut = strips.inside
        inside = (shell > 0) & (cut == 0)
        row = {**_one(table, scope), "shell_area": strips.area(inside), "union_area": strips.area(unit > 0), "covered_area": strips.area(inside & (unit > 0))}
        return pa.Table.from_pylist([row], pa.schema([*((s, table.schema.field(s).type) for s in scope), *((c, pa.float64()) for c in ("shell_area", "union_area", "covered_area"))]))

    parted = _parted(units, shells, scope, shell_buffer, unit_buffer, most)
    named = ", ".join(f"{s} {parted.schema[s].dataType.simpleString()}" for s in scope)
    sums = _squares(parted, scope).applyInArrow(measured, f"{named}, shell_area double, union_area double, covered_area double")
    whole = sums.groupBy(*scope).agg(*(F.sum(c).alias(c) for c in ("shell_area", "union_area", "covered_area")))
    void = F.col("shell_area") - F.col("covered_area")
    return whole.withColumns({"void_area": void, "void_ratio": F.when(F.col("shell_area") > 0, void / F.col("shell_area"))})


def _touches(polygon: list[Ring], box: tuple[float, float, float, float]) -> list[dict]:
    """Stretches of a piece's outline on its tile's border. line: the border on the snap grid; upper: whether the tile is above."""
    out = []
    for ring in polygon:
        for p, q in zip(ring, ring[1:], strict=False):
            for axis in (0, 1):
                for at, upper in ((box[axis], True), (box[axis + 2], False)):
                    if abs(p[axis] - at) < SNAP and abs(q[axis] - at) < SNAP and abs(p[1 - axis] - q[1 - axis]) > SNAP:
                        lo, hi = sorted((p[1 - axis], q[1 - axis]))
                        out.append({"axis": axis, "line": round(at / SNAP), "upper": upper, "lo": lo, "hi": hi})
    return out


def merged(polygons: Shape) -> Shape:
    """The union of pieces that share at most stretches of their outlines along tile borders."""
    grid = lambda p: (round(p[0] / SNAP), round(p[1] / SNAP))
    edges = [(a, b) for polygon in polygons for ring in polygon for a, b in zip(map(grid, ring), map(grid, ring[1:]), strict=False) if a != b]
    stops: dict[tuple[int, int], set[int]] = defaultdict(set)
    for a, b in edges:
        for axis in (0, 1):
            if a[axis] == b[axis]:
                stops[axis, a[axis]] |= {a[1 - axis], b[1 - axis]}
    for a, _ in edges:
        for axis in (0, 1):
            if (axis, a[axis]) in stops:
                stops[axis, a[axis]].add(a[1 - axis])
    steps = {k: sorted(v) for k, v in stops.items()}
    count: dict[tuple, int] = defaultdict(int)

    def add(p: tuple[int, int], q: tuple[int, int]) -> None:
        if count.get((q, p)):
            count[q, p] -= 1
        else:
            count[p, q] += 1

    for a, b in edges:
        axis = next((x for x in (0, 1) if a[x] == b[x]), None)
        if axis is None:
            add(a, b)
            continue
        lo, hi = sorted((a[1 - axis], b[1 - axis]))
        on = [s for s in steps[axis, a[axis]] if lo <= s <= hi]
        if a[1 - axis] > b[1 - axis]:
            on.reverse()
        at = lambda s: (a[0], s) if axis == 0 else (s, a[1])  # noqa: B023, E731
        for p, q in zip(on, on[1:], strict=False):
            add(at(p), at(q))
    return shapes.looped(count)


def _pieces(units: DataFrame, shells: DataFrame, scope: list[str], shell_buffer: float, unit_buffer: float, most: int) -> DataFrame:
    """(scope, id, shape, touches, size): what units leave of the shells in each tile, written."""

    def left(table: pa.Table) -> pa.Table:
        rows = []
        if pc.any(pc.equal(table["kind"], SHELL)).as_py():
            strips, places = _strips(table)
            unit, shell, cut = strips.inside
            names, at = _one(table, scope), _one(table, ["x0", "y0", "side", "level"])
            for tile, cells in strips.cells((shell > 0) & (unit == 0) & (cut == 0)).items():
                box = _box(*at.values(), *places[tile])
                for i, polygon in enumerate(shapes.sewn(cells)):
                    rows.append({**names, "id": ":".join(str(v) for v in (*names.values(), at["level"], *places[tile], i)), "shape": shapes.to_rows([polygon]), "touches": _touches(polygon, box)})
        return pa.Table.from_pylist(rows, pa.schema([*((s, table.schema.field(s).type) for s in scope), ("id", pa.string()), ("shape", _SHAPE), ("touches", _TOUCH)]))

    parted = _parted(units, shells, scope, shell_buffer, unit_buffer, most)
    named = ", ".join(f"{s} {parted.schema[s].dataType.simpleString()}" for s in scope)
    made = _squares(parted, scope).applyInArrow(left, f"{named}, id string, shape {rings.SHAPE}, touches array<struct<axis:int,line:bigint,upper:boolean,lo:double,hi:double>>")
    return materialise(made, "pieces")


def gaps(units: DataFrame, shells: DataFrame, scope: list[str], shell_buffer: float = 0.0, unit_buffer: float = 0.0, most: int = MOST) -> DataFrame:
    """(scope, void, shape): each connected part of a shell that no unit covers (GEO7, GEO8). void: a text of its own."""
    pieces = _pieces(units, shells, scope, shell_buffer, unit_buffer, most)
    ends = pieces.select(*scope, "id", F.explode("touches").alias("t")).select(*scope, "id", "t.*")
    # Tiles nest, so a stretch that faces another lies in the same square of the longest stretch's size or one beside it.
    reach = ends.groupBy(*scope).agg((F.max(F.col("hi") - F.col("lo")) + SNAP).alias("reach"))
    placed = ends.join(reach, scope).withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / F.col("reach")).cast("bigint"), F.floor(F.col("hi") / F.col("reach")).cast("bigint"))))
    key = [*scope, "axis", "line", "block"]
    side = lambda up, x: placed.where("upper" if up else "not upper").select(*key, *(F.col(c).alias(f"{c}_{x}") for c in ("id", "lo", "hi")))
    links = side(True, "a").join(side(False, "b").hint("merge"), key).where(F.least("hi_a", "hi_b") - F.greatest("lo_a", "lo_b") > SNAP).select(F.col("id_a").alias("src"), F.col("id_b").alias("dst")).distinct()
    parts = components(links, nodes=pieces.select("id"))
    named = ", ".join(f"{s} {pieces.schema[s].dataType.simpleString()}" for s in scope)

    def joined(table: pa.Table) -> pa.Table:
        by: dict[str, Shape] = defaultdict(list)
        for void, shape in zip(table["component"].to_pylist(), table["shape"].to_pylist(), strict=True):
            by[void] += shapes.from_rows(shape)
        names = _one(table, scope)
        rows = [{**names, "void": f"{void}/{i}", "shape": shapes.to_rows([p])} for void, found in by.items() for i, p in enumerate(merged(found) if len(found) > 1 else found)]
        return pa.Table.from_pylist(rows, pa.schema([*((s, table.schema.field(s).type) for s in scope), ("void", pa.string()), ("shape", _SHAPE)]))

    # Most voids are a few pieces, so a call of Python gets some hundreds of pieces; a void stays in one.
    calls = max(1, -(-pieces.count() // PIECES))
    grouped = pieces.select(*scope, F.col("id").alias("node"), "shape").join(parts.hint("merge"), "node").select(*scope, "component", "shape")
    return grouped.groupBy(*scope, F.pmod(F.xxhash64("component"), F.lit(calls)).alias("call")).applyInArrow(joined, f"{named}, void string, shape {rings.SHAPE}")


def voids(
    units: DataFrame,
    shells: DataFrame,
    min_area: float = 100.0,
    hexagons: bool = False,
    mean_factor: float = 1.5,
    least: float = 10_000.0,
    most: float = 5_000_000.0,
    part_factor: float = 4.0,
    width: float | None = 30.0,
    fraction: float | None = None,
    most_cells: int | None = None,
    shell_buffer: float = 0.0,
    unit_buffer: float = 0.0,
    cell_area: float | None = None,
    part_from: float | None = None,
    auto_size: bool = True,
    tile_units: int = MOST,
) -> DataFrame:
    """What units leave uncovered of their county's shell, in pieces of ``min_area`` or more (GEO7-9, GEO12).
    units: (county, precinct_id, shape); shells: (county, shape).

    shell_buffer (negative: the shell shrinks) and unit_buffer: in metres, before the difference. hexagons: voids of ``part_from``
    or more (else ``part_factor`` mean units) become hexagons of ``cell_area`` (else ``mean_factor`` mean units, unless not
    ``auto_size``), within ``least`` and ``most``. most_cells: hexagons that a void is cut into at most; there is no
    limit unless one is given. Every row tells, for its county, how many grid cells were left out for that
    (``cells_left_out``), and how many pieces for their quality (``pieces_dropped``).
    """
    found = gaps(units, shells, ["county"], shell_buffer, unit_buffer, tile_units)
    mean = units.where(F.size("shape") > 0).groupBy("county").agg(F.avg(rings.area(F.col("shape"))).alias("mean"))
    limit = F.col("mean")
    sized = found.join(mean, "county", "left").select(
        "county",
        "void",
        "shape",
        rings.hexagon_cell_area(limit, mean_factor, least, most, cell_area, auto_size).alias("cell") if hexagons else F.lit(None).cast("double").alias("cell"),
        rings.least_void_to_part(limit, part_factor, least, part_from).alias("from"),
    )
    kinds = [("county", pa.string()), ("void", pa.string()), ("n", pa.int64()), ("cx", pa.float64()), ("cy", pa.float64()), ("area_m2", pa.float64()), ("shape", _SHAPE), ("left_out", pa.int64()), ("dropped", pa.int64())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                gap, rows = shapes.from_rows(row["shape"]), []
                if shapes.area(gap) < min_area:
                    continue
                pieces, left_out, dropped = shapes.parted_voids([gap], row["cell"], row["from"], min_area, most_cells, width, fraction)
                for i, g in enumerate(pieces):
                    x, y = shapes.ring_centroid(g[0][0])
                    rows.append({"county": row["county"], "void": row["void"], "n": i, "cx": x, "cy": y, "area_m2": shapes.area(g), "shape": shapes.to_rows(g)})
                # A void tells what it lost, also where nothing of it is left.
                rows.append({"county": row["county"], "void": row["void"], "left_out": left_out, "dropped": dropped})
                for lo in range(0, len(rows), 1024):
                    yield pa.RecordBatch.from_pylist(rows[lo : lo + 1024], pa.schema(kinds))

    made = materialise(sized.mapInArrow(cut, f"county string, void string, n bigint, cx double, cy double, area_m2 double, shape {rings.SHAPE}, left_out bigint, dropped bigint"), "voids")
    lost = made.where("n is null").groupBy("county").agg(F.sum("left_out").alias("cells_left_out"), F.sum("dropped").alias("pieces_dropped"))
    return made.where("n is not null").join(lost, "county").select("county", F.xxhash64("void", "n").alias("void_key"), "cx", "cy", "area_m2", "shape", "cells_left_out", "pieces_dropped")
