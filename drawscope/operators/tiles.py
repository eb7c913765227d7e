"""Tiles of a quadtree that follows the data: where boxes meet, and which point is nearest.

A scope's tiles are squares of side ``side / 2**level`` from a point just below the lower left corner of all its boxes. That point
and the side are dyadic, so no border passes a hair from coordinates that are round numbers: it meets them, or is well away. Boxes are dealt
to tiles of one level first; tiles that still hold more than ``most`` boxes no larger than themselves
are parted sixteenfold, round after round. So dense places get small tiles, and a box that is far larger than the others
is dealt to the tiles there are, not to all small squares it covers. Nothing is gathered: a round is
a count by tile and a join by tile; only ids and bounds move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise, release

BOUNDS = ("minx", "miny", "maxx", "maxy")
TILE = ("level", "ix", "iy")
ROUNDS = 10


def size_of(level: Column | str = "level") -> Column:
    """Side of a tile. Halving is exact, so tiles of all levels share their borders to the last bit."""
    return F.col("side") / F.pow(F.lit(2.0), F.col(level) if isinstance(level, str) else level)


def _spread(rows: DataFrame, low: dict[str, Column], high: dict[str, Column]) -> DataFrame:
    for i, v in (("ix", "x"), ("iy", "y")):
        rows = rows.withColumn(i, F.explode(F.sequence(low[v], high[v])))
    return rows


def dealt(boxes: DataFrame, scope: list[str], most: int = 32) -> DataFrame:
    """``boxes`` (scope, …, minx, miny, maxx, maxy), a row for each tile that a box meets, with x0, y0, side, level, ix, iy.

    Rows without bounds go nowhere. Written to the shared folder.
    """
    known = materialise(boxes.where(" and ".join(f"{b} is not null" for b in BOUNDS)), "boxes")
    span = F.greatest(F.max("maxx") - F.min("minx"), F.max("maxy") - F.min("miny")) * (1 + 1e-9) + 1e-9
    step = F.pow(F.lit(2.0), F.floor(F.log2("__span")) - 4)
    low = lambda v: F.floor(F.col(v) / (step / 1024)) * (step / 1024)
    whole = known.groupBy(*scope).agg(F.min("minx").alias("x0"), F.min("miny").alias("y0"), span.alias("__span"), F.count("*").alias("__n"))
    root = whole.select(*scope, low("x0").alias("x0"), low("y0").alias("y0"), (F.ceil((F.col("__span") + step / 1024) / step) * step).alias("side"), "__n")
    level = F.greatest(F.lit(0), F.ceil(F.log(F.col("__n") / most) / F.log(F.lit(4.0)))).cast("int")
    first = known.join(root, scope).withColumn("level", level).drop("__n")

    def place(v: str, at: str, level: Column | str = "level") -> Column:
        return F.floor((F.col(f"{at}{v}") - F.col(f"{v}0")) / size_of(level)).cast("bigint")

    rows = materialise(_spread(first, {v: place(v, "min") for v in "xy"}, {v: place(v, "max") for v in "xy"}), "tiles")
    for _ in range(ROUNDS):
        small = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")) <= size_of()
        heavy = rows.where(small).groupBy(*scope, *TILE).agg(F.count("*").alias("__n")).where(F.col("__n") > most).select(*scope, *TILE, F.lit(True).alias("__heavy"))
        if heavy.isEmpty():
            break
        heavy = materialise(heavy, "heavy-tiles")
        both = rows.join(heavy.hint("merge"), [*scope, *TILE], "left")
        down = both.where("__heavy").drop("__heavy").withColumns({"level": F.col("level") + 2, "__x": F.col("ix") * 4, "__y": F.col("iy") * 4}).drop("ix", "iy")
        inner = {v: (F.greatest(F.col(f"__{v}"), place(v, "min")), F.least(F.col(f"__{v}") + 3, place(v, "max"))) for v in "xy"}
        parted = _spread(down, {v: inner[v][0] for v in "xy"}, {v: inner[v][1] for v in "xy"}).drop("__x", "__y")
        before, rows = rows, materialise(both.where("__heavy is null").drop("__heavy").unionByName(parted), "tiles")
        release(before, heavy)
    release(known)
    return rows


def meeting(boxes: DataFrame, scope: list[str], most: int = 32) -> DataFrame:
    """(scope, id_a, id_b, bounds of both) of boxes (scope, id, bounds) that meet, a < b, each pair once:
    in the tile that holds the lower left corner of what both share."""
    rows = dealt(boxes.select(*scope, "id", *BOUNDS), scope, most)
    at = {x: [F.col(c).alias(f"{c}_{x}") for c in ("id", *BOUNDS)] for x in "ab"}
    left = rows.select(*scope, *TILE, "x0", "y0", "side", *at["a"])
    met = left.join(rows.select(*scope, *TILE, *at["b"]), [*scope, *TILE]).where("id_a < id_b and minx_a <= maxx_b and minx_b <= maxx_a and miny_a <= maxy_b and miny_b <= maxy_a")
    home = [F.floor((F.greatest(f"min{v}_a", f"min{v}_b") - F.col(f"{v}0")) / size_of()) == F.col(f"i{v}") for v in "xy"]
    return met.where(home[0] & home[1]).select(*scope, *(f"{c}_{x}" for c in ("id", *BOUNDS) for x in "ab"))


#: Points of a tile at the lowest level of the search for neighbours, and how many tiles one is parted into.
LEAF, FAN = 4, 4


def nearest(asked: DataFrame, points: DataFrame, scope: list[str]) -> DataFrame:
    """(asked's columns, node, d2): for each row of ``asked`` (scope, u, ux, uy), u unique in its scope, the point of the same scope
    (scope, node, x, y) at the least squared distance, ties to the least node. Rows without a point in their scope go.

    Branch and bound from one tile that holds a scope down to tiles of about ``LEAF`` points: each tile knows one
    of its points. The least distance to those is an upper bound, and a tile that lies farther away is not looked into.
    No point nearer than the bound can lie there, so the result is exact.
    """
    placed = materialise(points.select(*scope, "node", "x", "y").where("x is not null and y is not null"), "points")
    span = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    root = materialise(placed.groupBy(*scope).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (span * (1 + 1e-9) + 1e-9).alias("side"), F.count("*").alias("__n")), "roots")
    most = root.agg(F.max("__n")).first()[0]
    depth = 0
    while most and FAN ** (2 * depth) * LEAF < most:
        depth += 1
    step = (FAN - 1).bit_length()
    cell = lambda v, level: F.floor((F.col(v) - F.col(f"{v}0")) / size_of(F.lit(step * level))).cast("bigint")
    d2 = lambda x, y: (F.col(x) - F.col("ux")) * (F.col(x) - F.col("ux")) + (F.col(y) - F.col("uy")) * (F.col(y) - F.col("uy"))
    based = placed.join(root.drop("__n"), scope)
    queries = asked.join(root.drop("__n"), scope)
    found = queries.select(*scope, "u", "ux", "uy", "x0", "y0", "side", F.lit(0).cast("bigint").alias("ix"), F.lit(0).cast("bigint").alias("iy"))
    for level in range(1, depth + 1):
        tiles = based.withColumns({"ix": cell("x", level), "iy": cell("y", level)}).groupBy(*scope, "ix", "iy").agg(F.min(F.struct("node", "x", "y")).alias("p"))
        tiles = tiles.withColumns({f"__{i}": F.floor(F.col(i) / FAN).cast("bigint") for i in ("ix", "iy")})
        up = found.withColumnsRenamed({"ix": "__ix", "iy": "__iy"})
        size = size_of(F.lit(step * level))
        away = [F.greatest(F.lit(0.0), F.col(f"{v}0") + F.col(f"i{v}") * size - F.col(f"u{v}"), F.col(f"u{v}") - F.col(f"{v}0") - (F.col(f"i{v}") + 1) * size) for v in "xy"]
        # Rounding may put a point a hair outside the tile it was dealt to.
        opened = up.join(tiles.hint("merge"), [*scope, "__ix", "__iy"]).withColumns({"__least": (away[0] * away[0] + away[1] * away[1]) * (1 - 1e-9), "__bound": d2("p.x", "p.y")})
        bound = F.min("__bound").over(Window.partitionBy(*scope, "u"))
        found = opened.withColumn("__best", bound).where(F.col("__least") <= F.col("__best")).select(*found.columns)
    last = based.withColumns({"ix": cell("x", depth), "iy": cell("y", depth)}).select(*scope, "ix", "iy", "node", "x", "y")
    best = found.join(last.hint("merge"), [*scope, "ix", "iy"]).groupBy(*scope, "u").agg(F.min(F.struct(d2("x", "y").alias("d2"), "node")).alias("b"))
    return asked.join(best.hint("merge"), [*scope, "u"]).select(*asked.columns, "b.node", "b.d2")
