"""Tiles, pairs, nearest points, voids and buffers against plain searches."""

import math
import random

import pytest
from pyspark.sql import functions as F

from drawscope.functions import rings
from drawscope.operators import dissolve, shapes, tiles
from drawscope.plans import config

KIND = f"county string, precinct_id string, shape {rings.SHAPE}"


def turned(x, y, w, h, angle):
    """A closed rectangle around (x, y)."""
    c, s = math.cos(angle), math.sin(angle)
    ring = [(x + c * a - s * b, y + s * a + c * b) for a, b in ((-w, -h), (w, -h), (w, h), (-w, h))]
    return [[ring + ring[:1]]]


def layer(spark, shapes_, county="01"):
    return spark.createDataFrame([(county, f"u{i:05}", s) for i, s in enumerate(shapes_)], KIND)


def boxes(spark, rows):
    return spark.createDataFrame(rows, "county string, id int, minx double, miny double, maxx double, maxy double")


def test_a_wide_box_among_many_small_ones_makes_few_rows(spark):
    rng = random.Random(1)
    n = 100_000
    small = spark.range(n).select(F.lit("01").alias("county"), F.col("id").cast("int").alias("id"), (F.rand(1) * 1000).alias("minx"), (F.rand(2) * 1000).alias("miny"))
    small = small.select("*", (F.col("minx") + 1).alias("maxx"), (F.col("miny") + 1).alias("maxy"))
    wide = boxes(spark, [("01", n, 0.0, rng.random(), 1000.0, 999.0)])
    rows = tiles.dealt(small.unionByName(wide), ["county"])
    assert rows.count() < 3 * n
    assert rows.where(F.col("id") != n).groupBy(*tiles.TILE).count().agg(F.max("count")).first()[0] <= 64


def test_pairs_of_dense_and_sparse_places(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        dense = i % 3
        x, y = (rng.random() * 2, rng.random() * 2) if dense else (rng.random() * 1000, rng.random() * 1000)
        w = rng.choice([0.01, 0.05, 0.2] if dense else [5.0, 80.0])
        rows.append((rng.choice(["01", "02"]), i, x, y, x + w, y + w * rng.random()))
    rows += [("01", 900, 0.0, 0.0, 1000.0, 1000.0), ("01", 901, 1.0, 1.0, 1.0, 1.0), ("02", 902, None, None, None, None), ("03", 903, 5.0, 5.0, 6.0, 6.0)]
    rows += [("04", 1000 + i, 0.0, 0.0, 1.0, 1.0) for i in range(80)]  # all in one place
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and None not in (a[2], b[2]) and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]}
    for most in (4, 32):
        got = [(r.id_a, r.id_b) for r in tiles.meeting(boxes(spark, rows), ["county"], most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_nearest_points(spark):
    rng = random.Random(3)
    points = [(rng.choice("ab"), f"n{i:04}", round(rng.random() * 10, 1), round(rng.random() * 10, 1)) for i in range(400)] + [("a", f"far{i}", 1000.0 + i, -500.0) for i in range(3)] + [("d", "x", None, 1.0)]
    asked = [("a", f"q{i}", rng.random() * 14 - 2, rng.random() * 14 - 2) for i in range(40)] + [("a", "gone", -1e6, 1e6), ("b", "q1", 5.05, 5.05), ("c", "none", 0.0, 0.0), ("a", "at", points[0][2], points[0][3])]
    got = tiles.nearest(spark.createDataFrame(asked, "county string, u string, ux double, uy double"), spark.createDataFrame(points, "county string, node string, x double, y double"), ["county"])
    want = {}
    for c, u, x, y in asked:
        near = sorted(((px - x) * (px - x) + (py - y) * (py - y), n) for k, n, px, py in points if k == c and px is not None)
        if near:
            want[c, u] = near[0]
    assert {(r.county, r.u): (r.d2, r.node) for r in got.collect()} == want


def test_nearest_looks_at_few_points(spark):
    points = spark.range(20_000).select(F.lit("a").alias("county"), F.col("id").cast("string").alias("node"), (F.rand(5) * 100).alias("x"), (F.rand(6) * 100).alias("y"))
    asked = spark.range(200).select(F.lit("a").alias("county"), F.col("id").cast("string").alias("u"), (F.rand(7) * 300 - 100).alias("ux"), (F.rand(8) * 300 - 100).alias("uy"))
    plan = tiles.nearest(asked, points, ["county"])
    assert plan.count() == 200
    import re

    made = [int(m.replace(",", "")) for m in re.findall(r"number of output rows: ([\d,]+)", plan._jdf.queryExecution().executedPlan().toString())]
    assert all(m < 50 * 200 or m >= 20_000 for m in made)


@pytest.mark.parametrize("most", [3, 24])
def test_voids_equal_one_overlay(spark, most):
    rng = random.Random(4)
    plain = [turned(rng.random() * 100, rng.random() * 100, 2 + 6 * rng.random(), 2 + 6 * rng.random(), rng.random() * 3) for _ in range(60)]
    ring = [(50 + r * math.cos(a), 50 + r * math.sin(a)) for a, r in ((k * math.pi / 25, 45 + 8 * (k % 3)) for k in range(50))]
    hole = [(48.0, 48.0), (48.0, 52.0), (52.0, 52.0), (52.0, 48.0), (48.0, 48.0)]
    shell = [[ring + ring[:1], hole]]
    units, shells = layer(spark, [*plain, None, []]), spark.createDataFrame([("01", shell), ("02", turned(5, 5, 1, 1, 0.3)), ("01", None)], f"county string, shape {rings.SHAPE}")
    want = shapes.difference(shapes.union([shell]), plain)
    got = [r for r in dissolve.voids(units, shells, 0.05, tile_units=most).collect()]
    of = lambda c: sorted(r.area_m2 for r in got if r.county == c)
    assert of("01") == pytest.approx(sorted(a for p in want if (a := shapes.area([p])) >= 0.05), abs=1e-4) and of("02") == pytest.approx([4.0])
    for r in got:
        assert len(shapes.from_rows(r.shape)) == 1
    c = {r.county: r for r in dissolve.shell_coverage(units, shells, most=most).collect()}
    whole, covered = shapes.area(shapes.union([shell])), shapes.union(plain)
    assert (c["01"].shell_area, c["01"].union_area, c["01"].void_area) == pytest.approx((whole, shapes.area(covered), shapes.area(want)), abs=1e-4)
    assert (c["02"].covered_area, c["02"].void_ratio) == (0.0, 1.0)


def test_a_larger_county_has_more_tasks_and_no_longer_ones(spark):
    def deal(n):
        side = int(n**0.5)
        units = layer(spark, [turned(i % side * 3.0, i // side * 3.0, 1.2, 1.2, 0.2) for i in range(n)])
        shell = spark.createDataFrame([("01", turned(side * 1.5, side * 1.5, side * 1.5, side * 1.5, 0.0))], f"county string, shape {rings.SHAPE}")
        per = dissolve._parted(units, shell, ["county"], 0.0, 0.0, dissolve.MOST).groupBy(*tiles.TILE).count().collect()
        return len(per), max(r["count"] for r in per)

    (few, one), (many, other) = deal(100), deal(1600)
    assert many >= 10 * few and other <= 2 * max(one, dissolve.MOST)


def convex(rng, x, y, r):
    angles = sorted(rng.random() * 2 * math.pi for _ in range(9))
    ring = [(x + r * math.cos(a), y + r * math.sin(a)) for a in angles]
    return [[ring + ring[:1]]]


def length(shape):
    return sum(math.dist(a, b) for polygon in shape for ring in polygon for a, b in zip(ring, ring[1:], strict=False))


def test_buffers_have_the_exact_area(spark):
    rng = random.Random(5)
    plain = [convex(rng, 50.0 + 40 * (i % 3), 50.0 + 40 * (i // 3), 12.0) for i in range(9)]
    units = layer(spark, plain)
    shell = spark.createDataFrame([("01", [[[(0.0, 0.0), (200.0, 0.0), (200.0, 200.0), (0.0, 200.0), (0.0, 0.0)]]])], f"county string, shape {rings.SHAPE}")
    for reach in (0.5, 3.0):
        exact = sum(shapes.area(s) + length(s) * reach + math.pi * reach * reach for s in plain)
        c = dissolve.shell_coverage(units, shell, unit_buffer=reach).first()
        assert c.union_area == pytest.approx(exact, rel=1e-3) and c.covered_area == pytest.approx(c.union_area)
    ell = [(0.0, 0.0), (0.0, 10.0), (4.0, 10.0), (4.0, 4.0), (10.0, 4.0), (10.0, 0.0), (0.0, 0.0)]  # runs right round: turned
    inner = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0), (1.0, 1.0)]
    other = {r.county: r for r in dissolve.shell_coverage(layer(spark, [[[ell]]]), shell.withColumn("county", F.lit("02")), unit_buffer=1.0).collect()}
    assert other["02"].union_area == 0 and other["02"].void_ratio == 1
    c = dissolve.shell_coverage(layer(spark, [[[ell, inner]]]), shell, unit_buffer=0.5).first()
    assert c.union_area == pytest.approx(64 - 4 + 40 * 0.5 + 5 / 4 * math.pi * 0.25 - 0.25 + (4 - 1), rel=1e-3)


def test_shells_grow_and_shrink(spark):
    shell = spark.createDataFrame([("01", [[[(0.0, 0.0), (100.0, 0.0), (100.0, 60.0), (0.0, 60.0), (0.0, 0.0)]]])], f"county string, shape {rings.SHAPE}")
    units = layer(spark, [turned(50.0, 30.0, 10.0, 10.0, 0.0)])
    area = lambda **k: sum(r.area_m2 for r in dissolve.voids(units, shell, 1.0, **k).collect())
    assert area() == pytest.approx(5600)
    assert area(shell_buffer=-5.0) == pytest.approx(90 * 50 - 400)
    assert area(shell_buffer=5.0) == pytest.approx(6000 + 320 * 5 + math.pi * 25 - 400, rel=1e-3)
    assert area(unit_buffer=2.0) == pytest.approx(6000 - (400 + 160 + math.pi * 4), rel=1e-3)
    # A void between two units that a buffer closes.
    pair = layer(spark, [turned(25.0, 30.0, 24.5, 30.0, 0.0), turned(75.0, 30.0, 24.5, 30.0, 0.0)])
    assert len(dissolve.voids(pair, shell, 1.0).collect()) == 3 and sorted(round(r.area_m2) for r in dissolve.voids(pair, shell, 1.0, unit_buffer=0.6).collect()) == []


def test_cells_and_thresholds_may_be_given(spark):
    shell = spark.createDataFrame([("01", turned(500.0, 500.0, 500.0, 500.0, 0.0))], f"county string, shape {rings.SHAPE}")
    units = layer(spark, [turned(200.0, 500.0, 200.0, 500.0, 0.0)])
    cut = lambda **k: dissolve.voids(units, shell, 1.0, True, least=100.0, width=None, **k).collect()
    assert len(cut()) == 1  # a void of one and a half units is not parted
    by = cut(part_from=1000.0, cell_area=40_000.0)
    assert len(by) > 10 and sum(r.area_m2 for r in by) == pytest.approx(600_000, rel=1e-3) and max(r.area_m2 for r in by) <= 40_000 * 1.001
    assert len(cut(part_from=1000.0, auto_size=False)) == 1


def test_shapes_that_meet_need_no_buffer(spark):
    units = layer(spark, [turned(0.0, 0.0, 1.0, 1.0, 0.0), turned(2.0, 0.0, 1.0, 1.0, 0.0), turned(4.01, 0.0, 1.0, 1.0, 0.0), turned(5.5, 1.5, 1.0, 1.0, 0.4)])
    found = lambda **k: sorted((r.src[-1], r.dst[-1]) for r in config.Contiguity("fuzzy", **k).edges(units, ["county"]).collect())
    assert found() == [("0", "1"), ("2", "3")] and found(buffer_m=0.01) == [("0", "1"), ("1", "2"), ("2", "3")]


def plain_distance(a, b):
    """All pairs of segments, and whether one lies in the other."""
    lines = lambda s: [(p, q) for polygon in s for ring in polygon for p, q in zip(ring, ring[1:], strict=False)]
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    best = math.inf
    for p, q in lines(a):
        for r, s in lines(b):
            if side(p, q, r) * side(p, q, s) < 0 and side(r, s, p) * side(r, s, q) < 0:
                return 0.0
            best = min(best, *(shapes._to_segment(*x, y, z) for x, y, z in ((p, r, s), (q, r, s), (r, p, q), (s, p, q))))
    inside = lambda one, other: any(shapes.contains(p[0], *ring[0]) and not any(shapes.contains(h, *ring[0]) for h in p[1:]) for p in other for polygon in one for ring in polygon)
    return 0.0 if best == 0 or inside(a, b) or inside(b, a) else best


def wavy(rng, n, x, y, r):
    ring = [(x + (r + rng.random()) * math.cos(a), y + (r + rng.random()) * math.sin(a)) for a in (2 * math.pi * k / n for k in range(n))]
    return [[ring + ring[:1]]]


def test_distances_equal_all_pairs():
    rng = random.Random(7)
    for _ in range(150):
        a, b = (wavy(rng, rng.choice([3, 7, 40]), rng.random() * 12, rng.random() * 12, rng.random() * 4) for _ in range(2))
        if rng.random() < 0.3:
            a[0].append([(p[0] * 0.5, p[1] * 0.5) for p in a[0][0]])
        assert shapes.distance(a, b) == pytest.approx(plain_distance(a, b), abs=1e-9)
    square = turned(0.0, 0.0, 1.0, 1.0, 0.0)
    assert shapes.distance(square, turned(2.0, 0.0, 1.0, 1.0, 0.0)) == 0 and shapes.distance(square, []) == math.inf
    ring = [[square[0][0], [(x / 2, y / 2) for x, y in square[0][0]]]]
    assert shapes.distance(ring, turned(0.0, 0.0, 0.25, 0.25, 0.0)) == pytest.approx(0.25)


def test_distance_of_long_outlines_is_quick():
    import time

    rng = random.Random(8)
    a, b = wavy(rng, 800, 0.0, 0.0, 10.0), wavy(rng, 800, 30.0, 5.0, 10.0)
    import pyarrow as pa

    from drawscope.functions import flat

    both = flat.of(pa.array([shapes.to_rows(a), shapes.to_rows(b)], flat.SHAPE))
    began = time.perf_counter()
    for _ in range(10):
        found = shapes.apart(shapes.Outline(both, 0), shapes.Outline(both, 1))
    assert (time.perf_counter() - began) / 10 < 0.02 and found == pytest.approx(plain_distance(a, b))
