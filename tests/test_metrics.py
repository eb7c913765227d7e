"""Two-bloc metrics, balance, diagnostics, rules, rollup: facts on tiny tables."""

import json

import pytest
from pyspark.sql import functions as F

from drawscope.operators import units as ops
from drawscope.operators.units import ContractError
from drawscope.plans import diagnostics, figures, metrics, rollup, rules

SKIP = metrics.Policy(safety=metrics.Safety(on_small_values="skip_balance"))


def of_totals(spark, *pairs):
    t = spark.createDataFrame([("c", d, float(a), float(b)) for d, (a, b) in enumerate(pairs)], "county string, district int, a double, b double")
    return metrics.plan_metrics(t, ["county"]).first()


@pytest.mark.parametrize("pairs, gap", [([(80, 20)], 0.4), ([(20, 80)], -0.4), ([(50, 50)], 0.0), ([(100, 0)], 1.0), ([(80, 20), (0, 0)], 0.4)])
def test_winner_surplus_gap(spark, pairs, gap):
    assert of_totals(spark, *pairs).efficiency_gap == pytest.approx(gap)


def test_ties_seats_and_shares(spark):
    r = of_totals(spark, (50, 50), (60, 40), (0, 0))
    assert r.seat_share_a == 0.75 and r.vote_share_a == pytest.approx(0.55) and r.mean_median_a_share_diff == pytest.approx(0.0)
    assert of_totals(spark, (1e6, 1e6 + 1e-7)).seat_share_a == 0.5  # nearly equal is a tie
    empty = of_totals(spark, (0, 0))
    assert empty.vote_share_a == 0 and empty.seat_share_a == 0 and empty.mean_median_a_share_diff is None


def case(spark, focal=(("u1", "d1"), ("u2", "d2"))):
    units = spark.createDataFrame([("c", "u1"), ("c", "u2"), ("c", "gap-01-0001")], "county string, precinct_id string")
    votes = spark.createDataFrame([("u1", "1", 80), ("u1", "2", 20), ("u2", "1", 30), ("u2", "2", 70), ("u2", "9", 5)], "precinct_id string, list_id string, votes bigint")
    coding = spark.createDataFrame([("1", "a"), ("2", "b")], "list_id string, bloc string")
    plan = spark.createDataFrame(list(focal), "precinct_id string, district string")
    ensemble = spark.createDataFrame([("c", n, 1, u, d) for n, ds in ((1, (1, 2, 1)), (2, (1, 1, 2))) for u, d in zip(("u1", "u2", "gap-01-0001"), ds, strict=True)], "county string, draw int, chain int, precinct_id string, district int")
    return units, votes, coding, plan, ensemble


def test_comparison(spark):
    units, votes, coding, plan, ensemble = case(spark)
    rows = {r.metric: r for r in metrics.compare(units, votes, coding, plan, ensemble).collect()}
    assert rows["vote_share_a"].ensemble_mean == pytest.approx(0.5)  # balanced
    assert rows["seat_share_a"].focal_value == 0.5 and rows["seat_share_a"].percentile_rank == 100.0
    assert {r.n_draws for r in rows.values()} == {2}


def test_strict_and_loose_enacted_plan(spark):
    units, votes, coding, plan, ensemble = case(spark, focal=(("u1", "d1"), ("u2", " ")))
    with pytest.raises(Exception, match="lack an enacted district"):
        metrics.compare(units, votes, coding, plan, ensemble).collect()
    rows = {r.metric: r for r in metrics.compare(units, votes, coding, plan, ensemble, strict=False, policy=metrics.Policy(balance=False)).collect()}
    assert rows["efficiency_gap"].focal_value == pytest.approx((80 - 20 - 20) / 100)
    joined = metrics.bloc_votes(units, votes, coding).join(metrics.first_focal(plan), "precinct_id", "left")
    c = metrics.coverage(joined, ["county"]).first()
    assert (c.n_units, c.n_units_with_positive_two_party_votes, c.n_units_missing_vote_row, c.n_units_missing_focal_district, c.n_voting_units_missing_focal) == (3, 2, 1, 2, 1)


def test_percentile_rank_and_quantiles(spark):
    draws = spark.createDataFrame([("c", n, "m", float(v)) for n, v in enumerate([0, 0.25, 0.5, 0.75, 1])], "county string, draw int, metric string, value double")
    for focal, rank in ((0.0, 20.0), (0.5, 60.0), (1.0, 100.0), (None, 0.0)):
        f = spark.createDataFrame([("c", "m", focal)], "county string, metric string, focal_value double")
        r = metrics.summarise(draws, f, ["county"]).first()
        assert r.percentile_rank == rank and r.ensemble_p05 == pytest.approx(0.05) and r.ensemble_p95 == pytest.approx(0.95)


def test_balance_modes(spark):
    v = spark.createDataFrame([("c", "u", 80.0, 20.0), ("c", "v", 10.0, 40.0), ("z", "w", 5.0, 0.0), ("e", "x", 0.0, 0.0)], "county string, precinct_id string, votes_a double, votes_b double")
    f = {r.county: r for r in metrics.balance_factors(v, ["county"], SKIP).collect()}
    assert f["z"].skip_reason == "bloc_total_below_eps_bloc" and f["e"].skip_reason == "total_turnout_below_eps_total" and f["c"].factor == pytest.approx((60 / 90) ** 0.5)
    b = metrics.balanced(v.where("county = 'c'"), ["county"]).agg(F.sum("votes_a"), F.sum("votes_b")).first()
    assert b[0] == pytest.approx(b[1])
    with pytest.raises(Exception, match="unsafe"):
        metrics.balanced(v, ["county"]).collect()
    assert {r.skip_reason for r in metrics.balance_factors(v, ["county"], metrics.Policy(balance=False)).collect()} == {"balance_disabled"}
    for wrong in ({"eps_bloc": 0}, {"on_small_values": "x"}):
        with pytest.raises(ValueError):
            metrics.Safety(**wrong)
    with pytest.raises(ValueError):
        metrics.Policy(mode="x")
    assert json.dumps(metrics.Policy().summary())


def assigned(spark, rows):
    return spark.createDataFrame([("c", n, ch, u, d, float(p)) for n, ch, u, d, p in rows], "county string, draw int, chain int, precinct_id string, district int, population double")


def test_population_deviation(spark):
    two = spark.createDataFrame([("c", 2)], "county string, ndists int")
    of = lambda rows: diagnostics.population_deviation(assigned(spark, rows), two, ["county", "draw"], ["county"]).first().deviation
    assert of([(1, 1, u, d, p) for u, d, p in (("a", 1, 10), ("b", 1, 10), ("c", 2, 30), ("d", 2, 30))]) == 0.5
    assert of([(1, 1, u, d, 25) for u, d in (("a", 1), ("b", 1), ("c", 2), ("d", 2))]) == 0.0
    assert of([(1, 1, "a", 1, 10)]) == 1.0  # a label that no unit has
    assert of([(1, 1, "a", 1, 10), (1, 1, "b", 2, 10), (1, 1, "c", 9, 20)]) == 0.5  # out of range counts in the total
    assert of([(1, 1, "a", 1, 0)]) == 0.0


def test_splits_and_uniqueness(spark):
    rows = assigned(spark, [(n, 1, u, d, 1) for n, ds in ((1, (1, 2)), (2, (1, 2)), (3, (2, 1))) for u, d in zip("ab", ds, strict=True)])
    u = diagnostics.uniqueness(rows, ["county"]).first()
    assert (u.n_draws, u.n_unique, u.n_duplicate) == (3, 2, 1)  # relabelled plans are different
    assert diagnostics.plan_signature(rows, ["county"]).select("signature").distinct().count() == 2
    assert {r.n_split_counties for r in diagnostics.county_splits(rows, ["draw"]).collect()} == {1}


def test_r_hat(spark):
    def of(*chains):
        rows = [("c", k, n, float(v)) for k, chain in enumerate(chains) for n, v in enumerate(chain)]
        return diagnostics.r_hat(spark.createDataFrame(rows, "county string, chain int, draw int, value double"), ["county"]).first().r_hat

    assert of([1, 2, 3, 4], [1, 2, 3, 4]) == 1.0 and of([0, 0.1, 0.2], [5, 5.1, 5.2]) > 1.2
    assert of([1, 1], [1, 1]) == 1.0 and of([1, 1], [2, 2]) is None and of([1, 2]) is None and of([1, 2, 9], [1]) is None
    assert of([1, 2, 3, 100], [1, 2, 3]) == 1.0  # cut to the shortest chain


def test_log_scan(spark):
    logs = spark.createDataFrame([("Effective sample size\nESS: 4",), ("guess: lesson",), (" ",), (None,), ("x" * 5000,)], "text string")
    rows = diagnostics.log_report(logs).collect()
    assert [(r.parse_status, r.ess_line_hits) for r in rows] == [("scanned", 2), ("scanned", 0), ("empty_or_unreadable", 0), ("empty_or_unreadable", 0), ("scanned", 0)]
    assert len(rows[4].excerpt_suffix) == 4000


def edges(spark):
    return spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")


def broken(spark, labels, populations=(1, 1, 1, 1), nd=2, spec=None, **kw):
    rows = assigned(spark, [(1, 1, u, d, p) for u, d, p in zip("abcd", labels, populations, strict=True)]).withColumn("where", F.when(F.col("precinct_id") == "a", "x").otherwise("y"))
    spec = spec or rules.Spec(rules.ElectorBalance(nd, 0.15), rules.Contiguity(True), rules.CountyContainment(False))
    found = rules.violations(rows, spark.createDataFrame([("c", nd)], "county string, ndists int"), edges(spark), ["county"], spec, **kw)
    return sorted((r.code, r.district) for r in found.collect())


def test_rules(spark):
    assert broken(spark, (1, 1, 2, 2)) == []
    assert broken(spark, (1, 2, 1, 2)) == [("district_disconnected", 1), ("district_disconnected", 2)]
    assert broken(spark, (1, 1, 1, 2)) == [("elector_deviation", 1), ("elector_deviation", 2)]
    assert broken(spark, (1, 1, 1, 1)) == [("district_label_coverage", None)]
    assert broken(spark, (1, 1, 2, 7)) == [("invalid_district_label", None)]
    assert broken(spark, (1, 1, 2, 2), (0, 0, 0, 0)) == [("zero_total_electors", None)]
    contained = rules.Spec(rules.ElectorBalance(2, 0.15), rules.Contiguity(False), rules.CountyContainment(True))
    assert broken(spark, (1, 1, 2, 2), spec=contained) == [("missing_county_ids", None)]
    assert broken(spark, (1, 1, 2, 2), spec=contained, county="where") == [("county_span_violation", 1)]
    assert rules.Spec.from_json(contained.to_json()) == contained
    with pytest.raises(ValueError):
        rules.Spec.from_json('{"schema_version": "x"}')


def test_rollup_weights_and_partial_runs(spark):
    counts = spark.createDataFrame([("01", 6), ("02", 5)], "maz string, n_oevk bigint")
    both = {r.maz: r.weight for r in rollup.weights(counts, counts).collect()}
    assert both == {"01": pytest.approx(6 / 11), "02": pytest.approx(5 / 11)}
    one = counts.where("maz = '02'")
    with pytest.raises(Exception, match="missing"):
        rollup.weights(counts, one).collect()
    assert rollup.weights(counts, one, allow_partial=True).first().weight == 1.0
    assert rollup.completeness(counts, one).first().missing == ["01"]
    reports = spark.createDataFrame([("01", "m", 1.0, 2.0, None), ("02", "m", None, 4.0, None)], "maz string, metric string, focal_value double, ensemble_mean double, percentile_rank double")
    n = rollup.national_metrics(reports, rollup.weights(counts, counts)).first()
    assert n.weighted_mean_focal == 1.0 and n.weighted_mean_ensemble_mean == pytest.approx(32 / 11) and n.weighted_mean_percentile_rank is None


def test_focus_counties_and_histograms(spark):
    rows = [("01", 0.0, 0.0), ("14", 0.0, 0.1), ("02", 0.9, 0.0), ("03", 0.5, 0.0), ("04", 0.1, 0.0)]
    reports = spark.createDataFrame([(m, "seat_share_a", f, e) for m, f, e in rows], "maz string, metric string, focal_value double, ensemble_mean double")
    w = spark.createDataFrame([(m, 0.2) for m, _, _ in rows], "maz string, weight double")
    assert [r.maz for r in figures.focus_counties(reports, w).orderBy("place").collect()] == ["01", "14", "02", "03"]
    v = spark.createDataFrame([("k", float(x)) for x in range(17)] + [("flat", 2.0)], "k string, value double")
    h = {(r.k, r.bin): r for r in figures.histogram(v, ["k"]).collect()}
    assert h["k", 15].n == 2 and sum(h["k", b].n for b in range(16)) == 17
    assert h["flat", 8].n == 1 and h["flat", 0].bin_lo == 1.5


def test_allocation_failures_come_in_order(spark):
    def focal(rows):
        return spark.createDataFrame(rows, "precinct_id string, maz string, oevk_id_full string")

    good = focal([("a", "1", "0101"), ("b", "1", "0102"), ("c", "2", "0201")])
    assert {(r.maz, r.n_oevk) for r in ops.allocation(good, 3, ["01", "02"]).collect()} == {("01", 2), ("02", 1)}
    for rows, total, counties, message in (
        ([], 3, ["01"], "empty"),
        ([("a", "1", None)], 3, ["01"], "null or repeated"),
        ([("a", "1", "x")], 3, ["01"], "national number"),
        ([("a", "1", "x"), ("b", "2", "x")], 1, ["01", "02"], "more than one county"),
        ([("a", "1", "x")], 1, ["01", "02"], "missing counties"),
        ([("a", "3", "x")], 1, [], "unexpected"),
    ):
        with pytest.raises(ContractError, match=message):
            ops.allocation(focal(rows), total, counties)
