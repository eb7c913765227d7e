"""Shapes of many tiles at a time: what a batch is cut to, widened outlines and the overlay in strips, against plain ones."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from drawscope.functions import cuts, flat, rings
from drawscope.operators import dissolve, shapes

UNIT, SHELL, CUT = dissolve.UNIT, dissolve.SHELL, dissolve.CUT


def star(rng, n, x, y, r):
    ring = [(x + (r + rng.random() * r) * math.cos(a), y + (r + rng.random() * r) * math.sin(a)) for a in (2 * math.pi * k / n for k in range(n))]
    return [[ring + ring[:1]]]


def square(x, y, w):
    return [[[(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]]]


def area_of(cells):
    return sum((hi - lo) * ((r0 - l0) + (r1 - l1)) / 2 for lo, hi, l0, r0, l1, r1 in cells)


def test_strips_equal_trapezoids_tile_by_tile(monkeypatch):
    rng = random.Random(1)
    for pairs in (1 << 20, 7):
        monkeypatch.setattr(shapes, "PAIRS", pairs)
        for _ in range(30):
            made = [square(rng.randrange(8), rng.randrange(8), rng.choice([0.5, 1.0, 2.0])) if rng.random() < 0.4 else star(rng, rng.choice([3, 5, 9]), rng.random() * 8, rng.random() * 8, 0.8) for _ in range(rng.choice([1, 5, 30]))]
            kinds, tiles = ([rng.randrange(3) for _ in made] for _ in range(2))
            owner = np.array([i for i, s in enumerate(made) for r in s[0] for _ in r[1:]])
            edges = np.array([(*a, *b) for s in made for r in s[0] for a, b in zip(r, r[1:], strict=False)])
            strips = shapes.Strips(edges, owner, np.array(kinds)[owner], np.array(tiles)[owner], 3)
            keep = (strips.inside[UNIT] > 0) & (strips.inside[CUT] == 0)
            got, whole = strips.cells(keep), 0.0
            for t in range(3):
                mine = [i for i in range(len(made)) if tiles[i] == t]
                kept, cut = (sum(1 << k for k, i in enumerate(mine) if kinds[i] == kind) for kind in (UNIT, CUT))
                want = list(shapes.trapezoids([made[i] for i in mine], lambda s: bool(s & kept) and not s & cut))  # noqa: B023
                whole += area_of(want)
                assert area_of(got.get(t, [])) == pytest.approx(area_of(want), abs=1e-6)
                assert shapes.area(shapes.sewn(got.get(t, []))) == pytest.approx(shapes.area(shapes.sewn(want)), abs=1e-6)
            assert strips.area(keep) == pytest.approx(whole, abs=1e-6)


def test_near_heights_are_merged_into_the_lowest():
    step = shapes.SNAP
    ys = [0.0, 0.6 * step, 1.2 * step, 1.8 * step, 5.0, 5.0 + 0.5 * step]
    tile, found = shapes._heights(np.array([0] * 6 + [1, 1]), np.array([*ys, 0.3 * step, 0.0]))
    assert list(zip(tile.tolist(), found.tolist(), strict=True)) == [(0, 0.0), (0, 1.2 * step), (0, 5.0), (1, 0.0)]


@pytest.mark.parametrize("many", [2, 64])
def test_a_batch_is_cut_as_its_shapes_are_one_by_one(monkeypatch, many):
    monkeypatch.setattr(dissolve, "MANY", many)
    rng = random.Random(2)
    made = [star(rng, rng.choice([3, 8, 30]), rng.random() * 16, rng.random() * 16, rng.choice([0.3, 2.0, 5.0])) for _ in range(40)] + [square(2.0, 2.0, 2.0), square(3.9, 4.0 - 1e-8, 0.05), [], None, [[[(1.0, 1.0), (1.0, 1.0)]]]]
    made[0][0].append([(p[0] / 2 + made[0][0][0][0][0] / 2, p[1] / 2 + made[0][0][0][0][1] / 2) for p in made[0][0][0]])
    made[1] += made[2]
    grid = [(2, i, j) for i in range(4) for j in range(4)]
    rows = [{"kind": i % 2, "shape": shapes.to_rows(s) if s is not None else None, "x0": 0.0, "y0": 0.0, "side": 16.0, "tiles": [dict(zip(("level", "ix", "iy"), t, strict=True)) for t in grid]} for i, s in enumerate(made)]
    kind = pa.struct([("level", pa.int32()), ("ix", pa.int64()), ("iy", pa.int64())])
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("kind", pa.int32()), ("shape", flat.SHAPE), ("x0", pa.float64()), ("y0", pa.float64()), ("side", pa.float64()), ("tiles", pa.list_(kind))]))
    row, tile, kinds, parts = dissolve._cut(batch, np.zeros(len(rows)))
    got = {(r, t % 16): shapes.from_rows(p) for r, t, p in zip(row.tolist(), tile.tolist(), flat.to_arrow(parts).to_pylist(), strict=True)}
    assert len(got) == len(row) and kinds.tolist() == [r % 2 for r in row.tolist()]
    even_odd = lambda polygons: sum(shapes.overlay_area([p], square(-50.0, -50.0, 120.0)) for p in polygons)
    for r, shape in enumerate(made):
        for t, (_, i, j) in enumerate(grid):
            box = (4.0 * i, 4.0 * j, 4.0 * i + 4, 4.0 * j + 4)
            plain = [[ring + ring[:1] for ring in dissolve.clipped([ring[:-1] for ring in polygon], box)] for polygon in shape or []]
            assert even_odd(got.get((r, t), [])) == pytest.approx(even_odd(plain), abs=1e-6)


def test_convex_rings_are_widened_as_one_outline():
    rng = random.Random(3)
    made, exact = [], []
    for turn in (1, -1):
        for n in (3, 4, 12):
            angles = sorted(rng.random() * 2 * math.pi for _ in range(n))
            ring = [(3 * math.cos(a), 3 * math.sin(a)) for a in angles][::turn]
            middle = ((ring[0][0] + ring[1][0]) / 2, (ring[0][1] + ring[1][1]) / 2)
            made.append([ring[0], middle, middle, *ring[1:]])  # on a straight line, and repeated
            around = sum(math.dist(a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
            exact.append(abs(shapes.ring_area(ring + ring[:1])) + around * 0.5 + math.pi * 0.25)
    bent, twice = [(0.0, 0.0), (4.0, 0.0), (1.0, 1.0), (0.0, 4.0)], [(math.cos(4 * math.pi * k / 5), math.sin(4 * math.pi * k / 5)) for k in range(5)]
    made += [bent, twice, [(0.0, 0.0), (1.0, 1.0)], []]
    x, y = (np.array([p[i] for ring in made for p in ring]) for i in range(2))
    convex, wx, wy, points = cuts.widened(x, y, np.append(0, np.cumsum([len(r) for r in made])), np.full(len(made), 0.5))
    assert convex.tolist() == [True] * 6 + [False] * 4 and (np.diff(points)[6:] == 0).all()
    for i, want in enumerate(exact):
        ring = list(zip(wx[points[i] : points[i + 1]].tolist(), wy[points[i] : points[i + 1]].tolist(), strict=True))
        assert abs(shapes.ring_area(ring + ring[:1])) == pytest.approx(want, rel=1e-3)
    corner, cx, _, at = cuts.widened(np.array([0.05, 0.95, 0.95, 0.05]), np.array([7.05, 7.05, 7.95, 7.95]), np.array([0, 4]), np.array([0.04]))
    assert corner.all() and len(cx) == 4 * (cuts.ARC + 1)  # no step more for a right angle's rounding


def test_a_widened_unit_brings_each_tile_one_polygon_and_tiles_are_overlaid_together(spark):
    side = 24
    units = spark.createDataFrame([("01", f"u{i:05}", square(i % side * 1.0 + 0.05, i // side * 1.0 + 0.05, 0.9)) for i in range(side * side)], f"county string, precinct_id string, shape {rings.SHAPE}")
    shell = spark.createDataFrame([("01", square(0.0, 0.0, float(side)))], f"county string, shape {rings.SHAPE}")
    parted = dissolve._parted(units, shell, ["county"], -0.25, 0.04, dissolve.MOST)
    rows = parted.where(F.col("kind") == UNIT).select("parts").collect()
    assert {len(flat.from_wkb(pa.array([bytes(r.parts)])).rings) - 1 for r in rows} == {1}
    n_tiles = parted.select("level", "ix", "iy").distinct().count()
    assert dissolve._squares(parted, ["county"]).count().count() * 8 <= n_tiles
    c = dissolve.shell_coverage(units, shell, shell_buffer=-0.25, unit_buffer=0.04).first()
    assert c.shell_area == pytest.approx((side - 0.5) ** 2) and c.union_area == pytest.approx(side * side * (0.81 + 4 * 0.9 * 0.04 + 32 * 0.0016 * math.sin(math.pi / 32)))


def test_voids_put_together_at_a_time_are_those_put_together_alone(spark, monkeypatch):
    units = spark.createDataFrame([(c, f"u{i:05}", square(i % 9 * 1.0, i // 9 * 1.0, 1.0)) for c in ("01", "02") for i in range(81) if i % (3 + int(c))], f"county string, precinct_id string, shape {rings.SHAPE}")
    shells = spark.createDataFrame([(c, square(0.0, 0.0, 9.0)) for c in ("01", "02")], f"county string, shape {rings.SHAPE}")
    made = []
    for pieces in (1, 5, 1 << 20):
        monkeypatch.setattr(dissolve, "PIECES", pieces)
        made.append(sorted((r.county, r.void, round(shapes.area(shapes.from_rows(r.shape)), 6)) for r in dissolve.gaps(units, shells, ["county"], most=3).collect()))
    assert made[0] == made[1] == made[2] and {c for c, *_ in made[0]} == {"01", "02"}
    assert sum(a for *_, a in made[0]) == pytest.approx(21 + 17) and len({(c, v) for c, v, _ in made[0]}) == len(made[0])


def test_voids_send_no_more_than_counties_through_the_driver(spark, monkeypatch):
    """Whatever is written on the way, and the result, joins by shuffle; but a row a county may be sent to all tasks."""
    import re

    from drawscope import scratch
    from drawscope.operators import components, tiles
    from drawscope.plans import registry

    plans = []
    seen = lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString())

    def watched(df, label, **options):
        seen(df)
        return scratch.materialise(df, label, **options)

    for module in (dissolve, components, tiles):
        monkeypatch.setattr(module, "materialise", watched)
    monkeypatch.setattr(components.components, "__defaults__", (*components.components.__defaults__[:-1], 0))  # by rounds, as on larger tables
    seen(registry.QUERIES["voids_numbered"](spark, "/root/testdata/sf0.001"))
    keys = {k for plan in plans for k in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan)}
    assert len(plans) >= 8 and {re.sub(r"#\d+", "", k) for k in keys} <= {"county"}
    assert not any("BroadcastNestedLoopJoin" in plan or "CartesianProduct" in plan for plan in plans)
