"""District-weighted national summary of county reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def completeness(counts: DataFrame, reported: DataFrame, county: str = "maz") -> DataFrame:
    """One row: expected and reporting counties, and which are missing."""
    both = counts.select(county).join(reported.select(county, F.lit(True).alias("has")).distinct(), county, "left")
    return both.agg(F.count("*").alias("expected_counties"), F.count("has").alias("contributing"), F.array_sort(F.collect_list(F.when(F.col("has").isNull(), F.col(county)))).alias("missing"))


def weights(counts: DataFrame, reported: DataFrame, county: str = "maz", allow_partial: bool = False) -> DataFrame:
    """(county, weight): its districts over the national sum; if counties are missing and that
    is allowed, over the sum of those that report."""
    here = counts.join(reported.select(county).distinct(), county, "left_semi")
    sums = counts.agg(F.sum("n_oevk").cast("double").alias("all_n"), F.count("*").alias("all_c")).crossJoin(here.agg(F.sum("n_oevk").cast("double").alias("here_n"), F.count("*").alias("here_c")))
    partial = F.col("here_c") < F.col("all_c")
    base = F.when(partial, F.col("here_n")).otherwise(F.col("all_n"))
    if not allow_partial:
        base = F.when(partial, F.raise_error(F.lit("county reports are missing; allow_partial weighs those that exist")).cast("double")).otherwise(F.col("all_n"))
    return here.crossJoin(F.broadcast(sums)).select(county, (F.col("n_oevk") / base).alias("weight"))


def weighted_mean(value, weight):
    """Over the rows whose value is known; null if none is."""
    known = F.sum(F.when(value.isNotNull(), weight))
    return F.when(known > 0, F.sum(weight * value) / known)


def national_metrics(reports: DataFrame, weighted: DataFrame, county: str = "maz") -> DataFrame:
    """A row a metric: weighted means of focal value, ensemble mean and percentile (AGG15).
    reports: (county, metric, focal_value, ensemble_mean, percentile_rank)."""
    w = F.col("weight")
    rows = reports.join(F.broadcast(weighted), county)
    return rows.groupBy("metric").agg(*(weighted_mean(F.col(c), w).alias(f"weighted_mean_{n}") for c, n in (("focal_value", "focal"), ("ensemble_mean", "ensemble_mean"), ("percentile_rank", "percentile_rank"))), F.count("*").alias("n_counties"))


def national_diagnostics(reports: DataFrame, weighted: DataFrame, county: str = "maz") -> DataFrame:
    """reports: (county, n_draws, n_unique, mean_of_max_abs_rel_deviation)."""
    w = F.col("weight")
    share = F.when(F.col("n_draws") > 0, F.col("n_unique") / F.col("n_draws"))
    return reports.join(F.broadcast(weighted), county).agg(weighted_mean(F.col("mean_of_max_abs_rel_deviation"), w).alias("weighted_mean_pop_mean_max_abs_rel_deviation"), weighted_mean(share, w).alias("weighted_mean_unique_draw_fraction"))


def county_and_national(reports: DataFrame, counts: DataFrame, county: str = "maz") -> DataFrame:
    """County rows and the national one in a single pass with grouping sets (an extension)."""
    rows = reports.join(F.broadcast(counts.select(county, "n_oevk")), county)
    known = F.sum(F.when(F.col("focal_value").isNotNull(), F.col("n_oevk")))
    return rows.groupingSets([["metric", county], ["metric"]], "metric", county).agg((F.sum(F.col("n_oevk") * F.col("focal_value")) / known).alias("focal_value"), (F.sum(F.col("n_oevk") * F.col("ensemble_mean")) / F.sum(F.when(F.col("ensemble_mean").isNotNull(), F.col("n_oevk")))).alias("ensemble_mean"))
