"""Settings, ensemble sources and stored reports."""

import json
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from drawscope.operators.units import ContractError, ordered_columns
from drawscope.plans import config
from drawscope.sources import stored


def test_bloc_coding(spark):
    raw = {"schema_version": config.CODING_SCHEMA, "a": ["v1"], "b": ["v2", "v3"], "label_a": "A"}
    coding = config.BlocCoding.parse(raw)
    assert coding.label_a == "A" and coding.table(spark).count() == 3
    for wrong in (raw | {"schema_version": "x"}, raw | {"b": ["v1"]}, raw | {"a": [], "b": []}, raw | {"a": "v1"}):
        with pytest.raises(ContractError):
            config.BlocCoding.parse(wrong)
    wide = spark.createDataFrame([("u", 1, None)], "precinct_id string, v1 bigint, v2 bigint")
    assert [tuple(r) for r in config.long_votes(wide, coding).collect()] == [("u", "v1", 1)]
    assert config.long_votes(wide.select("precinct_id"), coding).count() == 0


def test_options_are_checked():
    for wrong in ({"rule": "bishop"}, {"rule": "fuzzy", "buffer_m": -1}):
        with pytest.raises(ContractError):
            config.Contiguity(**wrong)
    with pytest.raises(ContractError):
        config.Problem(ndists=0)


def test_sources_and_preflight(spark):
    folder = f"/tmp/checkpoints/test-{uuid.uuid4().hex}"
    units = spark.createDataFrame([("c", "b", 1), ("c", "a", 1)], "county string, precinct_id string, population int")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    nd = spark.createDataFrame([("c", 2)], "county string, ndists int")
    spark.createDataFrame([(0, 1, 5), (1, 1, 6)], "unit_index int, draw int, district int").coalesce(1).write.option("header", True).csv(folder)
    got = config.EnsembleSource("csv", folder).load(spark, units.drop("population"))
    assert {(r.precinct_id, r.district, r.chain) for r in got.collect()} == {("a", 5, 1), ("b", 6, 1)}
    assert config.EnsembleSource("generated", draws=2).load(spark, units, edges, nd).count() == 4
    with pytest.raises(ContractError, match="fewer units"):
        config.preflight(units, edges, nd.withColumn("ndists", F.lit(3)))
    with pytest.raises(ContractError, match="pieces"):
        config.preflight(units, edges.limit(0), nd, connected=True)
    for bad in (config.EnsembleSource("x"), config.EnsembleSource("csv", folder)):
        with pytest.raises(ContractError):
            bad.load(spark)


def test_county_reports_become_flat_rows(spark):
    folder = f"/tmp/checkpoints/test-{uuid.uuid4().hex}"
    for c, v in (("01", 0.5), ("02", None)):
        p = Path(f"{folder}/counties/{c}/reports/partisan.json")
        p.parent.mkdir(parents=True)
        one = {"focal_value": v, "ensemble_mean": 0.25, "ensemble_p05": 0.0, "ensemble_p95": 1.0, "percentile_rank": 60.0}
        p.write_text(json.dumps({"party_label_a": "A", "metrics": {"seat_share_a": one}}))
    rows = stored.metric_rows(stored.reports(spark, folder, "partisan.json"), ["seat_share_a", "efficiency_gap"])
    assert {(r.maz, r.metric, r.focal_value, r.percentile_rank) for r in rows.collect()} == {("01", "seat_share_a", 0.5, 60.0), ("02", "seat_share_a", None, 60.0)}


def test_known_columns_come_first(spark):
    df = spark.createDataFrame([(1, 2, 3, "u")], "votes_b int, votes_a int, voters int, precinct_id string")
    assert ordered_columns(df).columns == ["precinct_id", "voters", "votes_a", "votes_b"]


def test_scopes_delete_what_they_wrote(spark):
    from drawscope import scratch

    with scratch.scope(spark):
        with scratch.scope(spark):
            inner = scratch.materialise(spark.range(3), "inner")
            assert inner.count() == 3
        outer = scratch.materialise(spark.range(2), "outer")
    for df in (inner, outer):
        assert not Path(df.scratch_path.removeprefix("file://")).exists()


def test_a_scope_leaves_other_threads_tables(spark):
    from threading import Event, Thread

    from drawscope import scratch

    inside, written, kept = Event(), Event(), []

    def other():
        with scratch.scope(spark):
            inside.wait(60)
            kept.append(scratch.materialise(spark.range(5), "other"))
            written.set()
            left.wait(60)
            kept.append(kept[0].count())

    left = Event()
    thread = Thread(target=other)
    thread.start()
    with scratch.scope(spark):
        inside.set()
        assert written.wait(60)
        mine = scratch.materialise(spark.range(2), "mine")
    assert not Path(mine.scratch_path.removeprefix("file://")).exists()
    left.set()
    thread.join(60)
    assert kept[1] == 5 and not Path(kept[0].scratch_path.removeprefix("file://")).exists()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from drawscope import scratch

    for master, wrong in (("yarn", True), ("spark://a:7077", True), ("local-cluster[2,1,1024]", True), ("local[4]", False), ("local", False)):
        kept = {}
        session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d, set=kept.__setitem__), sparkContext=SimpleNamespace(master=master))
        if wrong:
            with pytest.raises(ValueError, match="share"):
                scratch.shared_folder(session)
        assert wrong or scratch.shared_folder(session) == kept["spark.checkpoint.dir"]
