"""Draws that arrive in parts against the same draws in batch."""

import random

import pytest
from pyspark.sql import functions as F

from drawscope.plans import metrics
from drawscope.streaming import arriving

N_UNITS, N_DRAWS = 12, 30


@pytest.fixture
def case(spark):
    rng = random.Random(1)
    units = spark.createDataFrame([(c, f"{c}u{i}", float(rng.randrange(50)), float(rng.randrange(50))) for c in ("01", "02") for i in range(N_UNITS)], "county string, precinct_id string, votes_a double, votes_b double")
    rows = [(c, d, 1 + d % 2, f"{c}u{i}", rng.randrange(1, 4)) for c in ("01", "02") for d in range(N_DRAWS) for i in range(N_UNITS)]
    rng.shuffle(rows)
    return units, rows


def put(spark, rows, folder, name):
    spark.createDataFrame(rows, arriving.ENSEMBLE).coalesce(1).write.parquet(f"{folder}/{name}")


def found(spark, sink, kind="metrics"):
    return spark.read.parquet(f"{sink}/{kind}").drop("batch")


def plain(rows):
    return sorted((r.county, r.draw, *(None if r[m] is None else round(r[m], 9) for m in metrics.METRICS)) for r in rows)


def test_split_files_equal_the_batch(spark, case, tmp_path):
    units, rows = case
    folder, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame(rows, arriving.ENSEMBLE).repartition(5).write.parquet(folder)  # every draw lies in several files
    arriving.measured_parts(spark, folder, units, sink, f"{tmp_path}/check", files_per_batch=1).awaitTermination(300)
    batch = metrics.draw_metrics(units, spark.createDataFrame(rows, arriving.ENSEMBLE), ["county"])
    assert plain(found(spark, sink).collect()) == plain(batch.collect()) and found(spark, sink, "late").count() == 0
    of = {(r.county, r.metric): r for r in arriving.quantiles(spark, sink).collect()}
    for (county, metric), r in of.items():
        values = sorted(x[metric] for x in batch.where(F.col("county") == county).collect() if x[metric] is not None)
        assert r.n_draws == len(values) == N_DRAWS and values[0] <= r.p05 <= r.p50 <= r.p95 <= values[-1]
        assert abs(sum(v <= r.p50 for v in values) - N_DRAWS / 2) <= N_DRAWS * 0.1 or values.count(r.p50) > 1


def test_late_parts_and_restarts(spark, case, tmp_path):
    units, rows = case
    folder, sink, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"
    mine = [r for r in rows if r[1] < 3]
    half = [r for r in mine if not (r[1] == 1 and r[3] == "01u4")]  # one unit of one draw is missing
    run = lambda: arriving.measured_parts(spark, f"{folder}/*", units, sink, check).awaitTermination(300)
    put(spark, half[: len(half) // 2], folder, "a")
    run()
    put(spark, half[len(half) // 2 :], folder, "b")
    run()  # a new query goes on from the checkpoint
    assert {(r.county, r.draw) for r in found(spark, sink).collect()} == {(c, d) for c in ("01", "02") for d in range(3)} - {("01", 1)}
    put(spark, [r for r in mine if r[1] == 0][:5] + [("01", 1, 1, "01u5", 9), ("01", 1, 1, "stranger", 1)], folder, "c")  # late, repeated, unknown
    run()
    assert found(spark, sink, "late").agg(F.sum("n_rows")).first()[0] == 5
    assert ("01", 1) not in {(r.county, r.draw) for r in found(spark, sink).collect()}
    put(spark, [r for r in mine if r[1] == 1 and r[3] == "01u4"], folder, "d")
    run()
    batch = metrics.draw_metrics(units, spark.createDataFrame(mine, arriving.ENSEMBLE), ["county"])
    assert plain(found(spark, sink).collect()) == plain(batch.collect())
