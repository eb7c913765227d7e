"""County reports, draw series, connectivity and what voids leave out."""

import json
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from drawscope.operators import dissolve, graph
from drawscope.operators import units as ops
from drawscope.operators.units import ContractError
from drawscope.plans import diagnostics, metrics, reports

COUNTY = "county string, precinct_id string"


def inputs(spark):
    """One county of two units and two draws that both give each unit a district of its own."""
    units = spark.createDataFrame([("01", "u1"), ("01", "u2"), ("01", "other")], COUNTY)
    votes = spark.createDataFrame([("u1", "a1", 30), ("u1", "b1", 10), ("u2", "a1", 10), ("u2", "b1", 30), ("other", "a1", 99)], "precinct_id string, list_id string, votes bigint")
    coding = spark.createDataFrame([("a1", "a"), ("b1", "b")], "list_id string, bloc string")
    focal = spark.createDataFrame([("u1", "1"), ("u2", "2")], "precinct_id string, district string")
    ensemble = spark.createDataFrame([("01", d, 1, u, x) for d, (x1, x2) in enumerate([(1, 2), (2, 1)], 1) for u, x in (("u1", x1), ("u2", x2))], "county string, draw int, chain int, precinct_id string, district int")
    voters = spark.createDataFrame([("u1", 40), ("u2", 40)], "precinct_id string, voters bigint")
    districts = spark.createDataFrame([("01", 2)], "county string, ndists int")
    return units, votes, coding, focal, ensemble, voters, districts


def test_reports_of_every_county_in_one_job(spark):
    found = reports.county_reports(*inputs(spark), extra={"run_id": "r1"}, tolerance=0.25)
    folder = f"/tmp/checkpoints/test-{uuid.uuid4().hex}"
    reports.write_county_reports(found, folder)
    read = lambda kind: json.loads(next(Path(folder, f"report={kind}", "county=01").glob("*.txt")).read_text())
    d, p = read("diagnostics"), read("partisan")
    assert (d["n_units"], d["n_draws"], d["ndists"], d["ensemble"]) == (2, 2, 2, {"n_unique": 2, "n_duplicate": 0})
    assert d["population"]["mean_of_max_abs_rel_deviation"] == 0 and d["population"]["draws_exceeding_tolerance"] == [False, False]
    assert d["extra"]["run_id"] == p["extra"]["run_id"] == "r1" and p["extra"]["report_county"] == "01"
    assert (d["chains"], d["county_splits"], d["smc_log"]) == (None, None, None)
    assert p["coverage"] == {"n_units": 2, "n_units_with_positive_two_party_votes": 2, "n_units_missing_vote_row": 0, "n_units_missing_focal_district": 0, "n_voting_units_missing_focal": 0}
    assert (p["party_label_a"], p["extra"]["coding"], p["extra"]["n_units_in_focal_aggregate"]) == ("A", {"a_lists": ["a1"], "b_lists": ["b1"]}, 2)
    assert p["extra"]["vote_balance"] == {"balance_requested": True, "balance_mode": "symmetric", "balance_applied": True, "skip_reason": None, "scale_factor": 1.0, "sum_a_before": 40.0, "sum_b_before": 40.0, "sum_two_party_before": 80.0}
    assert p["extra"]["policy"]["safety"]["on_small_values"] == "raise"
    gap = p["metrics"]["efficiency_gap"]
    assert gap["focal_value"] == pytest.approx(0) and gap["percentile_rank"] == 100 and gap["n_draws"] == 2
    assert set(p["metrics"]) == set(metrics.METRICS) and p["extra"]["efficiency_gap_definition"] == reports.GAP_DEFINITION


def test_strict_reports_want_every_voting_unit_in_the_enacted_plan(spark):
    units, votes, coding, focal, *rest = inputs(spark)
    with pytest.raises(ContractError):
        reports.county_reports(units, votes, coding, focal.limit(1).where("precinct_id = 'u1'"), *rest, strict=True)


def test_draw_series_has_every_draw(spark):
    units, votes, coding, _, ensemble, *_ = inputs(spark)
    rows = metrics.draw_series(units, votes, coding, ensemble, ["county"]).collect()
    assert sorted({r.draw for r in rows}) == [1, 2] and len(rows) == 2 * len(metrics.METRICS)


def test_bundle_equals_its_parts(spark):
    *_, ensemble, voters, districts = inputs(spark)
    assigned = ensemble.join(voters.withColumnRenamed("voters", "population"), "precinct_id")
    b = diagnostics.bundle(assigned, districts, ["county"]).first()
    u = diagnostics.uniqueness(assigned, ["county"]).first()
    assert (b.n_draws, b.n_unique, b.n_duplicate) == (u.n_draws, u.n_unique, u.n_duplicate)


def test_splits_and_both_r_hats(spark):
    # Counties X and Y of two units each; draws 1 to 4 in two chains.
    plans = {1: (1, 1, 1, 1), 2: (1, 2, 1, 2), 3: (1, 1, 1, 2), 4: (1, 2, 1, 2)}
    rows = [("s", d, 1 + (d > 2), f"u{i}", x, 1.0, "XXYY"[i]) for d, plan in plans.items() for i, x in enumerate(plan)]
    assigned = spark.createDataFrame(rows, "scope string, draw int, chain int, precinct_id string, district int, population double, maz string")
    districts = spark.createDataFrame([("s", 2)], "scope string, ndists int")
    b = diagnostics.bundle(assigned, districts, ["scope"], 0.4, "maz").first()
    assert (b.n_counties_in_frame, b.per_draw_n_split_counties, b.mean_n_split_counties, b.max_n_split_counties) == (2, [0, 2, 1, 2], 1.25, 2)
    assert (b.per_draw_max_abs_rel_deviation, b.draws_exceeding_tolerance, b.n_exceeding) == ([1.0, 0.0, 0.5, 0.0], [True, False, True, False], 2)
    hat = lambda series: diagnostics.r_hat(spark.createDataFrame([("s", 1 + i // 2, i, float(v)) for i, v in enumerate(series)], "scope string, chain int, draw int, value double"), ["scope"]).first().r_hat
    assert (b.n_chains, b.r_hat_max_abs_rel_pop_deviation, b.r_hat_n_split_counties) == (2, hat([1, 0, 0.5, 0]), hat([0, 2, 1, 2]))
    assert (b.n_draws, b.n_unique, b.n_duplicate, b.parse_status) == (4, 3, 1, None)
    one = diagnostics.bundle(assigned.where("chain = 1"), districts, ["scope"]).first()
    assert (one.n_chains, one.n_exceeding, one.draws_exceeding_tolerance, one.per_draw_n_split_counties) == (None, None, None, None)


def test_a_unit_without_enacted_district_is_counted(spark):
    units, votes, coding, focal, *rest = inputs(spark)
    (r,) = reports.county_reports(units, votes.where("precinct_id <> 'u2' or list_id <> 'a1'"), coding, focal.where("precinct_id = 'u1'"), *rest, labels=("one", "two")).collect()
    p = json.loads(r.partisan)
    assert p["coverage"]["n_voting_units_missing_focal"] == p["coverage"]["n_units_missing_focal_district"] == 1
    assert p["extra"]["n_units_in_focal_aggregate"] == 1 and p["party_label_b"] == "two"


def plain_log(err, out, read, most):
    """The block of one run, from the texts of its files."""
    import re

    if not err and not out:
        return ("no_log_paths", 0, 0, None)
    text = ""
    for name, path in (("stderr", err), ("stdout", out)):
        if path:
            text += f"--- {name} ---\n{read[path]}\n" if path in read else f"[{name}: missing file {path}]\n"
    hits = len(re.findall(r"(?im)(effective\s+sample\s+size|(^|\s)ESS\s*[:=])", text))
    return ("scanned", hits, min(most, len(text)), text[-most:])


def test_logs_from_paths(spark, tmp_path):
    from drawscope.sources import logs

    texts = {"a.err": "Some preamble\nEffective sample size: 42%\nmore\n", "a.out": "ESS: 3\nx ESS = 4 less", "long.err": "ESS=1\n" * 900 + "é" * 300, "empty.out": ""}
    read = {}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
        read[str(tmp_path / name)] = text
    (tmp_path / "raw.err").write_bytes(b"\xff ESS: \xe9\n")
    read[str(tmp_path / "raw.err")] = "\ufffd ESS: \ufffd\n"
    at = lambda name: name and str(tmp_path / name)
    pairs = [("a.err", "a.out"), ("long.err", "a.out"), ("a.out", "long.err"), (None, None), ("", None), ("gone.err", None), ("gone.err", "a.out"), (None, "empty.out"), ("raw.err", "gone.out")]
    wanted = spark.createDataFrame([(i, at(e), at(o)) for i, (e, o) in enumerate(pairs)], "run int, stderr_path string, stdout_path string")
    for most in (4000, 60):
        found = logs.scanned(wanted, logs.files(spark, str(tmp_path), "*.*", most), ["run"], most).orderBy("run").collect()
        got = [(r.parse_status, r.ess_line_hits, r.log_excerpt_chars, r.excerpt_suffix) for r in found]
        assert got == [plain_log(at(e), at(o), read, most) for e, o in pairs]
    schemed = wanted.where("run = 0").withColumn("stderr_path", F.concat(F.lit("file://"), "stderr_path"))
    assert logs.scanned(schemed, logs.files(spark, str(tmp_path)), ["run"]).first().ess_line_hits == 3


def test_pieces_of_districts_against_a_plain_walk(spark):
    import random

    random.seed(4)
    nodes = [f"n{i}" for i in range(30)]
    edges = {tuple(sorted(random.sample(nodes, 2))) for _ in range(35)}
    rows = [("a" if i < 15 else "b", d, n, random.randint(1, 3)) for d in (1, 2, 3) for i, n in enumerate(nodes)]
    got = graph.district_components(spark.createDataFrame(rows, "county string, draw int, precinct_id string, district int"), spark.createDataFrame(sorted(edges), "src string, dst string"))
    want = {}
    for c, d, _, k in rows:
        mine = {n for c2, d2, n, k2 in rows if (c2, d2, k2) == (c, d, k)}
        left, n_pieces = set(mine), 0
        while left:
            n_pieces, walk = n_pieces + 1, [left.pop()]
            while walk:
                at = walk.pop()
                near = {y if x == at else x for x, y in edges if at in (x, y)} & left
                left -= near
                walk += near
        want[c, d, k] = (n_pieces, len(mine))
    assert {(r.county, r.draw, r.district): (r.n_pieces, r.n_units) for r in got.collect()} == want


def test_cells_left_out_are_reported(spark):
    square = lambda x, y, s: [[[(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]]]
    kind = "county string, precinct_id string, shape array<array<array<struct<x:double,y:double>>>>"
    units = spark.createDataFrame([("01", "u", square(0.0, 0.0, 1.0))], kind)
    shells = spark.createDataFrame([("01", None, square(0.0, 0.0, 10.0))], kind)
    cut = lambda most: dissolve.voids(units, shells, 0.1, True, 1.0, 1.0, 50.0, 2.0, None, None, most).agg(F.sum("area_m2").alias("a"), F.max("cells_left_out").alias("n")).first()
    whole, part = cut(None), cut(5)
    assert whole.n == 0 and whole.a == pytest.approx(99, rel=0.02) and part.n > 0 and part.a < 50


def test_index_of_all_units_is_that_of_their_order(spark):
    ids = [f"{i * 7919 % 1000:03}" for i in range(200)]
    got = ops.unit_index_of_all(spark.createDataFrame([(u,) for u in ids], "precinct_id string").repartition(5)).collect()
    assert {r.precinct_id: r.unit_index for r in got} == {u: i for i, u in enumerate(sorted(ids))}
