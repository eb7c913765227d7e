"""County reports: diagnostics and comparison of every county in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import finite
from ..operators.units import on_units, population_of
from . import diagnostics, metrics

# Schema of the report and name of the gap's definition.
REPORT_SCHEMA = "drawscope.county_report/v1"
GAP_DEFINITION = "winner_surplus"


def county_reports(
    units: DataFrame,
    votes: DataFrame,
    coding: DataFrame,
    focal: DataFrame,
    ensemble: DataFrame,
    voters: DataFrame,
    districts: DataFrame,
    scope: list[str] | None = None,
    policy: metrics.Policy | None = None,
    tolerance: float | None = None,
    strict: bool = False,
    extra: dict[str, str] | None = None,
    labels: tuple[str, str] = ("A", "B"),
    split_by: str | None = None,
    logs: DataFrame | None = None,
) -> DataFrame:
    """(scope, diagnostics, partisan): the two JSON texts of each county (DOM11).

    diagnostics: the blocks of ``diagnostics.BLOCKS``. partisan: the labels of the blocs, metrics, coverage of the units by votes
    and enacted plan, and as ``extra`` the lists of each bloc, the policy, what balancing did, and how many units the
    enacted plan's totals hold. Numbers that are undefined or not finite are null in the texts, never left out.

    ``units``, ``votes`` and ``focal`` may hold more units than the ensemble; its units count. ``split_by``: a column of
    ``units`` whose splits are counted. ``logs``: by scope. ``extra`` goes into both texts.
    """
    scope = scope or ["county"]
    policy = policy or metrics.Policy()
    key = [*scope, "precinct_id"]
    mine = units.join(ensemble.select(*key).distinct(), key, "left_semi")
    people = population_of(mine.select("precinct_id"), voters)
    if split_by and split_by not in scope:
        people = people.join(mine.select("precinct_id", split_by), "precinct_id")
    found = diagnostics.bundle(on_units(ensemble, people), districts, scope, tolerance, split_by, logs)
    more = [F.lit(v).alias(k) for k, v in (extra or {}).items()] + [F.col(c).cast("string").alias(f"report_{c}") for c in scope]
    schema = F.lit(REPORT_SCHEMA).alias("schema_version")
    diagnosed = F.struct(schema, *diagnostics.blocks(), F.struct(*more).alias("extra"))
    compared, about = metrics.comparison(mine.select(*key), votes, coding, focal, ensemble, scope, policy, strict)
    numbers = ("focal_value", "ensemble_mean", "ensemble_p05", "ensemble_p95", "percentile_rank")
    per = compared.groupBy(*scope).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", F.struct(*(finite(F.col(c)).alias(c) for c in numbers), "n_draws"))))).alias("metrics"))
    lists = coding.agg(*(F.sort_array(F.collect_set(F.when(F.col("bloc") == b, F.col("list_id")))).alias(f"{b}_lists") for b in ("a", "b")))
    applied = F.struct(F.lit(policy.balance).alias("balance_requested"), F.lit(policy.mode).alias("balance_mode"), F.col("factor").isNotNull().alias("balance_applied"), "skip_reason", F.col("factor").alias("scale_factor"), F.col("sum_a").alias("sum_a_before"), F.col("sum_b").alias("sum_b_before"), (F.col("sum_a") + F.col("sum_b")).alias("sum_two_party_before"))
    counted = ("n_units", "n_units_with_positive_two_party_votes", "n_units_missing_vote_row", "n_units_missing_focal_district", "n_voting_units_missing_focal")
    safety = F.struct(*(F.lit(v).alias(k) for k, v in policy.summary()["safety"].items()))
    judged = F.struct(
        schema,
        F.lit(labels[0]).alias("party_label_a"),
        F.lit(labels[1]).alias("party_label_b"),
        F.col("metrics"),
        F.struct(*counted).alias("coverage"),
        F.struct(
            *more,
            F.lit(GAP_DEFINITION).alias("efficiency_gap_definition"),
            F.struct(F.lit(policy.balance).alias("balance"), F.lit(policy.mode).alias("mode"), safety.alias("safety")).alias("policy"),
            F.struct("a_lists", "b_lists").alias("coding"),
            (F.col("n_units") - F.col("n_units_missing_focal_district")).alias("n_units_in_focal_aggregate"),
            applied.alias("vote_balance"),
        ).alias("extra"),
    )
    options = {"ignoreNullFields": "false"}
    partisan = per.join(about, scope).crossJoin(lists).select(*scope, F.to_json(judged, options).alias("partisan"))  # one row of lists
    return found.select(*scope, F.to_json(diagnosed, options).alias("diagnostics")).join(partisan, scope)


def write_county_reports(reports: DataFrame, path: str, scope: list[str] | None = None) -> None:
    """One folder a county and kind of report: ``<path>/report=<kind>/<scope>=<value>/``."""
    scope = scope or ["county"]
    rows = reports.unpivot(scope, ["diagnostics", "partisan"], "report", "value")
    rows.select("report", *scope, "value").repartition("report", *scope).write.partitionBy("report", *scope).text(path)
