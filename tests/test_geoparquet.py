"""GeoParquet layers: footers, bounds, commit and abort; projection there and back."""

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from drawscope.functions import rings
from drawscope.sources import geoparquet, stored

KIND = f"precinct_id string, n int, shape {rings.SHAPE}"


def square(x, y, s=1.0):
    return [[[(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]]]


def parts(path):
    return sorted(f for f in os.listdir(path) if f.endswith(".parquet"))


def test_a_layer_keeps_its_system_and_bounds(spark, tmp_path):
    path = f"{tmp_path}/layer"
    units = spark.createDataFrame([(f"u{i}", i, square(10.0 * i, 5.0) if i % 5 else None) for i in range(20)], KIND).repartitionByRange(4, "n")
    geoparquet.write(units, path, geoparquet.UTM_33N)
    about = geoparquet.described(path)
    assert (about["crs"], about["kinds"], about["bounds"], about["files"]) == ("EPSG:32633", ["MultiPolygon"], [10.0, 5.0, 191.0, 6.0], 4)
    back = geoparquet.read(spark, f"file://{path}")
    assert back.columns == ["precinct_id", "n", "shape"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, units.collect()))
    meta = json.loads(pq.read_metadata(f"{path}/{parts(path)[0]}").metadata[b"geo"])
    assert meta["version"] == "1.1.0" and meta["columns"]["geometry"]["crs"]["conversion"]["parameters"][1]["value"] == 15
    assert not [f for f in os.listdir(path) if f.startswith("_staging")]
    geoparquet.write(units.limit(3), path, mode="append")
    with pytest.raises(PySparkException, match="mixes"):
        geoparquet.read(spark, path).count()
    geoparquet.write(units.limit(3), path)
    assert geoparquet.read(spark, path).count() == 3 and geoparquet.described(path)["crs"] == "OGC:CRS84"


def test_files_that_miss_the_box_stay_closed(spark, tmp_path):
    path = f"{tmp_path}/layer"
    units = spark.createDataFrame([(f"u{i}", i, square(10.0 * i, 0.0)) for i in range(40)], KIND).repartitionByRange(8, "n")
    geoparquet.write(units, path)
    whole = geoparquet.read(spark, path)
    assert whole.rdd.getNumPartitions() == 8
    near = geoparquet.read(spark, path, (0.0, -1.0, 45.0, 3.0))
    assert near.rdd.getNumPartitions() == 1 and {r.precinct_id for r in near.collect()} >= {f"u{i}" for i in range(5)}
    assert geoparquet.read(spark, path, (0.0, 50.0, 45.0, 60.0)).count() == 0


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/layer"
    units = spark.createDataFrame([(f"u{i}", i, square(float(i), 0.0)) for i in range(10)], KIND).repartition(3)
    geoparquet.write(units, path)
    before = parts(path)
    broken = units.withColumn("n", F.when(F.col("n") == 7, F.raise_error(F.lit("no")).cast("int")).otherwise(F.col("n")))
    with pytest.raises(PySparkException):
        geoparquet.write(broken, path)
    assert sorted(os.listdir(path)) == before and geoparquet.read(spark, path).count() == 10


def test_other_files_are_refused(spark, tmp_path):
    pq.write_table(pa.table({"geometry": pa.array([b""])}), f"{tmp_path}/a.parquet")
    with pytest.raises(PySparkException, match="no geo entry"):
        geoparquet.read(spark, str(tmp_path)).count()
    with pytest.raises(PySparkException, match="no layer"):
        geoparquet.read(spark, f"{tmp_path}/none").count()
    with pytest.raises(ValueError, match="unknown reference system"):
        geoparquet.projjson("EPSG:1")
    assert geoparquet.projjson("EPSG:32733")["conversion"]["parameters"][4]["value"] == 10_000_000


def test_wkb_columns(spark):
    units = spark.createDataFrame([("a", 1, square(0.0, 0.0)), ("b", 2, None)], KIND)
    assert stored.from_wkb(stored.with_wkb(units)).collect() == units.select("precinct_id", "n", "shape").collect()


def test_degrees_to_metres_and_back(spark):
    rows = spark.range(2000).select((12 + F.rand(1) * 6).alias("x"), (F.rand(2) * 80).alias("y"))
    p = rings.lonlat(rings.utm(F.struct("x", "y")))
    worst = rows.select(F.greatest(F.abs(p["x"] - F.col("x")), F.abs(p["y"] - F.col("y"))).alias("d")).agg(F.max("d")).first()[0]
    assert worst < 1e-9
