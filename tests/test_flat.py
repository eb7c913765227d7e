"""Flat shapes: WKB, soundness and repair against plain ones."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from drawscope.functions import flat, rings
from drawscope.operators import shapes


def column(found):
    return pa.array([None if s is None else shapes.to_rows(s) for s in found], flat.SHAPE)


def star(rng, n=8, x=0.0, y=0.0, shuffled=False):
    angles = sorted(rng.random() * 2 * math.pi for _ in range(n))
    if shuffled:
        rng.shuffle(angles)
    ring = [(x + (1 + rng.random()) * math.cos(a), y + (1 + rng.random()) * math.sin(a)) for a in angles]
    return ring + ring[:1]


SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
small = lambda x, y, s: [(x, y), (x, y + s), (x + s, y + s), (x + s, y), (x, y)]
NAMED = {
    "square": ([[SQUARE]], True),
    "hole": ([[SQUARE, small(1.0, 1.0, 1.0)]], True),
    "two holes": ([[SQUARE, small(0.5, 0.5, 1.0), small(2.0, 2.0, 1.0)]], True),
    "island in a hole": ([[SQUARE, small(1.0, 1.0, 2.0)], [small(1.5, 1.5, 1.0)]], True),
    "two parts": ([[SQUARE], [small(5.0, 0.0, 1.0)]], True),
    "bow-tie": ([[[(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]]], False),
    "spike": ([[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (4.0, 9.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]], False),
    "hole outside": ([[SQUARE, small(9.0, 9.0, 1.0)]], False),
    "hole in a hole": ([[SQUARE, small(0.5, 0.5, 3.0), small(1.0, 1.0, 1.0)]], False),
    "shell in a shell": ([[SQUARE], [small(1.0, 1.0, 1.0)]], False),
    "open": ([[SQUARE[:-1]]], False),
    "repeat": ([[[SQUARE[0], *SQUARE]]], False),
    "line": ([[[(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (0.0, 0.0)]]], False),
    "triangle": ([[[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]]], True),
    "touching holes": ([[SQUARE, small(1.0, 1.0, 1.0), small(2.0, 2.0, 1.0)]], False),  # in doubt: left to the overlay
    "no ring": ([[]], False),
    "empty": ([], False),
    "null": (None, False),
    "no number": ([[[(0.0, 0.0), (math.nan, 0.0), (1.0, 1.0), (0.0, 0.0)]]], False),
}


def test_named_shapes():
    found = flat.sound(flat.of(column([s for s, _ in NAMED.values()])))
    assert dict(zip(NAMED, found.tolist(), strict=True)) == {k: v for k, (_, v) in NAMED.items()}


def plain_sound(ring):
    """A ring by all pairs of its segments."""
    n = len(ring) - 1
    side = lambda p, q, r: np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    for i in range(n):
        for j in range(i + 1, n):
            a, b, c, d = ring[i], ring[i + 1], ring[j], ring[j + 1]
            if j - i in (1, n - 1):
                continue
            if side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0 and max(min(a[0], b[0]), min(c[0], d[0])) <= min(max(a[0], b[0]), max(c[0], d[0])) and max(min(a[1], b[1]), min(c[1], d[1])) <= min(max(a[1], b[1]), max(c[1], d[1])):
                return False
    return True


def test_random_rings_against_all_pairs(monkeypatch):
    rng = random.Random(1)
    found = [star(rng, rng.randrange(4, 14), rng.random() * 3, rng.random() * 3, rng.random() < 0.5) for _ in range(400)]
    want = [plain_sound(r) for r in found]
    assert 50 < sum(want) < 350
    for pairs in (1 << 20, 50):
        monkeypatch.setattr(flat, "PAIRS", pairs)
        assert flat.sound(flat.of(column([[[r]] for r in found]))).tolist() == want
    areas = flat.areas(flat.of(column([[[r]] for r in found])))
    assert areas == pytest.approx([abs(shapes.ring_area(r)) for r in found])


def test_wkb_there_and_back():
    rng = random.Random(2)
    found = [[[star(rng)], [star(rng, 5, 9.0), small(9.0, 0.0, 0.1)]], None, [], [[SQUARE]], None, [[star(rng, 30)]]]
    arrays = flat.of(column(found))
    assert flat.to_arrow(arrays).to_pylist() == column(found).to_pylist()
    wkb = flat.to_wkb(arrays)
    assert [v is None for v in wkb.to_pylist()] == [s is None for s in found]
    assert flat.to_arrow(flat.from_wkb(wkb)).to_pylist() == column(found).to_pylist()
    assert flat.to_wkb(flat.of(column([]))).to_pylist() == []
    big = bytes.fromhex("000000000300000001000000044010000000000000" + "0" * 16 + "3ff0000000000000" * 2 + "0" * 32 + "4010000000000000" + "0" * 16)
    assert flat.to_arrow(flat.from_wkb(pa.array([big], pa.binary()))).to_pylist()[0][0][0][1] == {"x": 1.0, "y": 1.0}
    with pytest.raises(ValueError, match="kind 1"):
        flat.from_wkb(pa.array([bytes.fromhex("0101000000") + b"\0" * 16], pa.binary()))


def test_repair_keeps_sound_rows_and_mends_others(spark):
    rows = [(k, s if s is None else shapes.to_rows(s)) for k, (s, _) in NAMED.items() if k != "no number"]
    df = spark.createDataFrame(rows, f"name string, shape {rings.SHAPE}")
    got = {r.name: r for r in shapes.repair(df.withColumnRenamed("name", "area_after").withColumnRenamed("area_after", "name")).collect()}
    want = {k: shapes.repaired(shapes.from_rows(s)) for k, s in rows}
    for k, (shape, valid) in want.items():
        assert got[k].was_valid == valid and got[k].area_after == pytest.approx(shapes.area(shape)) and got[k].is_empty == (not shape), k
    assert got["touching holes"].area_after == got["two holes"].area_after == pytest.approx(14.0)
