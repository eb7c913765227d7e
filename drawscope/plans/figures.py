"""Tables behind the charts and maps; drawing is left to the reader's tool."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import MISSING, county_label, district_key, json_object

PLOTTED = ("seat_share_a", "efficiency_gap", "mean_median_a_share_diff")

#: Fixed value: counties that are always in focus.
ALWAYS = ("01", "14")


def national_bars(national: DataFrame) -> DataFrame:
    """Enacted against ensemble mean in percentage points (FIG1)."""
    return national.where(F.col("metric").isin(list(PLOTTED))).select("metric", (F.col("weighted_mean_focal") * 100.0).alias("focal_pp"), (F.col("weighted_mean_ensemble_mean") * 100.0).alias("ensemble_pp"))


def percentile_matrix(reports: DataFrame, weighted: DataFrame, county: str = "maz") -> DataFrame:
    """County by metric, counties that have all of them; rank orders by weight (FIG2, JN8)."""
    rows = reports.where(F.col("metric").isin(list(PLOTTED)))
    wide = rows.groupBy(county).pivot("metric", list(PLOTTED)).agg(F.first("percentile_rank"))
    full = rows.groupBy(county).agg(F.countDistinct("metric").alias("n")).where(F.col("n") == len(PLOTTED))
    return _ranked(wide.join(full.select(county), county, "left_semi").join(weighted, county), F.desc("weight"), F.col(county))


def _ranked(df: DataFrame, *order) -> DataFrame:
    """One row a county: a window over all of them is small."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def seat_deltas(reports: DataFrame, weighted: DataFrame, county: str = "maz") -> DataFrame:
    """Enacted less mean seat share, ascending (FIG3)."""
    rows = reports.where("metric = 'seat_share_a'").join(weighted, county)
    return _ranked(rows.select(county, ((F.col("focal_value") - F.col("ensemble_mean")) * 100.0).alias("delta_pp"), "weight"), F.col("delta_pp").asc_nulls_last(), F.col(county))


def gap_intervals(reports: DataFrame, weighted: DataFrame, county: str = "maz") -> DataFrame:
    """Efficiency gap and its interval, by vote share, then weight, falling (FIG4, JN9)."""
    gap = reports.where("metric = 'efficiency_gap'").select(county, "focal_value", "ensemble_p05", "ensemble_p95")
    share = reports.where("metric = 'vote_share_a'").select(county, F.col("focal_value").alias("vote_share_a"))
    rows = gap.join(share, county, "left").join(weighted, county, "left").withColumn("county_label", county_label(F.col(county)))
    return _ranked(rows, F.desc_nulls_last("vote_share_a"), F.desc_nulls_last("weight"), F.col(county))


def histogram(values: DataFrame, keys: list[str], value: str = "value", bins: int = 16) -> DataFrame:
    """Equal-width bins from least to greatest, the last one closed (FIG5-7). Constant data
    lie in bins of total width 1 around the value, as charting tools do."""
    edges = values.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    flat = F.col("lo") == F.col("hi")
    edges = edges.select(*keys, F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int")
    counted = values.where(F.col(value).isNotNull()).join(F.broadcast(edges), keys).groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))
    grid = edges.select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counted, [*keys, "bin"], "left").select(*keys, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_lo"), F.coalesce("n", F.lit(0)).alias("n"))


def unique_fractions(diagnostics: DataFrame, weighted: DataFrame, county: str = "maz") -> DataFrame:
    """Unique and repeated shares of draws; the three most repeated and the fixed counties are labelled (FIG8, FIG9)."""
    rows = diagnostics.join(weighted, county)
    unique = F.coalesce(F.when(F.col("n_draws") > 0, F.col("n_unique") / F.col("n_draws")), F.lit(0.0))
    repeated = F.coalesce(F.when(F.col("n_draws") > 0, (F.col("n_draws") - F.col("n_unique")) / F.col("n_draws")), F.lit(0.0))
    placed = _ranked(rows.select(county, "weight", unique.alias("unique_frac"), repeated.alias("dup_frac")), F.desc("dup_frac"), F.col(county))
    return placed.withColumn("labelled", (F.col("place") <= 3) | F.col(county).isin(list(ALWAYS)))


def focus_counties(reports: DataFrame, weighted: DataFrame, n: int = 4, county: str = "maz") -> DataFrame:
    """The fixed counties that report, then those whose seat share differs most, up to n (ORD3)."""
    rows = reports.where("metric = 'seat_share_a'").join(weighted, county).withColumn("delta_abs", F.abs(F.col("focal_value") - F.col("ensemble_mean")))
    fixed = F.when(F.col(county) == ALWAYS[0], 0).when(F.col(county) == ALWAYS[1], 1).otherwise(2)
    placed = _ranked(rows.select(county, "delta_abs", "weight"), fixed, F.when(fixed < 2, F.lit(None)).otherwise(F.col("delta_abs")).desc_nulls_last(), F.desc_nulls_last("weight"), F.col(county))
    return placed.where(F.col("place") <= n)


def popup_totals(assigned: DataFrame, scope: list[str]) -> DataFrame:
    """Bloc totals and units by district key; units without a district count under a marker (AGG17)."""
    return assigned.groupBy(*scope, district_key(F.col("district")).alias("district_key")).agg(F.sum("votes_a").alias("votes_a"), F.sum("votes_b").alias("votes_b"), F.count("*").alias("n_units"))


def popups(assigned: DataFrame, scope: list[str]) -> DataFrame:
    """Each unit with its own and its district's votes as a JSON object (MAP1, FN16)."""
    keyed = assigned.withColumn("district_key", district_key(F.col("district")))
    joined = keyed.join(popup_totals(assigned, scope).withColumnsRenamed({"votes_a": "da", "votes_b": "db", "n_units": "dn"}), [*scope, "district_key"])
    names = F.array(*map(F.lit, ("district", "unit_a", "unit_b", "district_a", "district_b", "district_units")))
    values = F.array(F.col("district_key"), *(F.col(c).cast("bigint").cast("string") for c in ("votes_a", "votes_b", "da", "db", "dn")))
    return joined.select(*scope, "precinct_id", json_object(names, values).alias("popup"))


__all__ = ["MISSING", "focus_counties", "gap_intervals", "histogram", "national_bars", "percentile_matrix", "popup_totals", "popups", "seat_deltas", "unique_fractions"]
