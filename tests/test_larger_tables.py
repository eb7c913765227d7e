"""What only larger tables showed: units without orders, tile borders beside round coordinates."""

import math

from pyspark.sql import functions as F

from drawscope.operators import shapes, tiles
from drawscope.plans import registry


def test_units_without_orders_have_no_voters_and_voids_have_null(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, 7), (2, 7)], "c_custkey bigint, c_nationkey int").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(10, 1, "1-URGENT")], "o_orderkey bigint, o_custkey bigint, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(1, 7)], "s_suppkey bigint, s_nationkey int").write.parquet(f"{d}/supplier.parquet")
    rows = {r.precinct_id: r.voters for r in registry.QUERIES["votes_joined_void_masked"](spark, d).collect()}
    assert rows == {"07-001-000": 1, "07-002-000": 0, "gap-07-0000": None}


def test_a_corner_of_two_near_vertices_stays():
    step = shapes.SNAP
    ring = shapes._straight([(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (2.0 - step, 1.0), (0.0, 1.0)])
    assert math.isclose(shapes.ring_area(ring), 2.0, abs_tol=1e-6)


def test_tile_borders_meet_round_coordinates_or_are_well_away(spark):
    side = 450
    units = spark.range(8 * side).select(F.lit("01").alias("county"), (F.col("id") % 8).cast("double").alias("minx"), F.floor(F.col("id") / 8).cast("double").alias("miny"))
    rows = tiles.dealt(units.select("*", (F.col("minx") + 1).alias("maxx"), (F.col("miny") + 1).alias("maxy")), ["county"], 24)
    for v in "xy":
        line = F.col(f"{v}0") + F.col(f"i{v}") * tiles.size_of()
        off = F.abs(line - F.round(line))
        assert rows.where((off > 0) & (off < 1e-3)).isEmpty()
