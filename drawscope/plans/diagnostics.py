"""How an ensemble behaves: population balance, county splits, uniqueness, convergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import log_scan
from ..scratch import materialise


def population_deviation(assigned: DataFrame, districts: DataFrame, keys: list[str], scope: list[str], population: str = "population") -> DataFrame:
    """Per plan: the greatest |population - ideal| / ideal over districts 1..ndists (AGG7, JN12).

    assigned: (keys, scope, district, population); districts: (scope, ndists). A label that no
    unit has counts as an empty district; labels out of range count in the total only. An
    ideal of zero or less gives 0.
    """
    per = list(dict.fromkeys([*scope, *keys]))
    totals = assigned.groupBy(*per, "district").agg(_population(population).alias("p"))
    return _deviation(totals, districts, per, scope)


def _population(column: str = "population"):
    return F.sum(F.coalesce(F.col(column), F.lit(0)).cast("double"))


def _deviation(totals: DataFrame, districts: DataFrame, per: list[str], scope: list[str]) -> DataFrame:
    """``totals``: (per, district, p)."""
    plans = totals.join(F.broadcast(districts.select(*scope, "ndists")), scope)
    inside = F.when(F.col("district").between(1, F.col("ndists")), F.col("p"))
    # |p - ideal| is greatest at the largest or the smallest district: no second pass is needed.
    out = plans.groupBy(*per, "ndists").agg(F.sum("p").alias("total"), F.max(inside).alias("high"), F.min(inside).alias("low"), F.count(inside).alias("present"))
    ideal = F.col("total") / F.col("ndists")
    low = F.when(F.col("present") < F.col("ndists"), F.least(F.lit(0.0), F.coalesce("low", F.lit(0.0)))).otherwise(F.col("low"))
    worst = F.greatest(F.abs(F.coalesce("high", F.lit(0.0)) - ideal), F.abs(low - ideal)) / ideal
    return out.select(*per, F.when(ideal <= 0, 0.0).otherwise(worst).alias("deviation"), ideal.alias("ideal"), "total")


def population_summary(deviations: DataFrame, scope: list[str], tolerance: float | None = None) -> DataFrame:
    """Mean, greatest and 95 % point over draws, the series itself, and what exceeds (AGG8)."""
    series = F.transform(F.sort_array(F.collect_list(F.struct("draw", "deviation"))), lambda x: x["deviation"])
    more = [F.count_if(F.col("deviation") > tolerance).alias("n_exceeding")] if tolerance is not None else []
    return deviations.groupBy(*scope).agg(
        F.first("ideal").alias("ideal_per_district"),
        F.first("total").alias("total_population"),
        F.avg("deviation").alias("mean_of_max_abs_rel_deviation"),
        F.max("deviation").alias("max_of_max_abs_rel_deviation"),
        F.percentile("deviation", 0.95).alias("p95_of_max_abs_rel_deviation"),
        series.alias("per_draw_max_abs_rel_deviation"),
        *more,
    )


def county_splits(assigned: DataFrame, keys: list[str], county: str = "county") -> DataFrame:
    """Per draw: counties whose units lie in more than one district (AGG9)."""
    per = assigned.groupBy(*keys, county).agg(F.countDistinct("district").alias("n"))
    return per.groupBy(*[k for k in keys if k != county]).agg(F.count_if(F.col("n") > 1).alias("n_split_counties"))


def uniqueness(assigned: DataFrame, scope: list[str]) -> DataFrame:
    """Different and repeated label vectors over draws (AGG10).

    A plan's vector is known by two sums of hashes over its (unit, district) pairs: they need
    no order, combine map-side, and are never collected to one row of a plan's size.
    """
    signed = assigned.groupBy(*scope, "draw").agg(*(F.sum(h).alias(n) for n, h in _hashes().items()))
    return _unique(signed, scope)


def _hashes() -> dict[str, Column]:
    pair = F.xxhash64("precinct_id", "district")
    again = F.xxhash64(F.lit(11), "district", "precinct_id")
    # Halves of 31 bits can be summed over two thousand million units without overflow.
    return {f"s{2 * i + j}": F.shiftrightunsigned(h, n).bitwiseAND(F.lit(0x7FFFFFFF)) for i, h in enumerate((pair, again)) for j, n in enumerate((0, 32))}


def _unique(signed: DataFrame, scope: list[str]) -> DataFrame:
    return signed.groupBy(*scope).agg(F.countDistinct("s0", "s1", "s2", "s3").alias("n_unique"), F.count("*").alias("n_draws")).select(*scope, "n_draws", "n_unique", (F.col("n_draws") - F.col("n_unique")).alias("n_duplicate"))


def plan_signature(assigned: DataFrame, scope: list[str]) -> DataFrame:
    """sha256 of each draw's labels in unit order, for exchange with other tools."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("precinct_id", "district"))), lambda x: x["district"].cast("string"))
    return assigned.groupBy(*scope, "draw").agg(F.sha2(F.array_join(ordered, ","), 256).alias("signature"))


def chain_sizes(draws: DataFrame, scope: list[str]) -> DataFrame:
    return draws.select(*scope, "chain", "draw").distinct().groupBy(*scope, "chain").agg(F.count("*").alias("n"), F.min("draw").alias("first_draw"))


def r_hat(series: DataFrame, scope: list[str], value: str = "value") -> DataFrame:
    """Univariate Gelman-Rubin statistic over chains (AGG21, AGG22).

    series: (scope, chain, draw, value). Chains are cut to the length of the shortest. Fewer
    than two chains or two draws give null; no variance within gives 1 if the means agree
    and null (infinite) otherwise; the result is at least 1.
    """
    ranked = series.withColumn("rn", F.row_number().over(Window.partitionBy(*scope, "chain").orderBy("draw")))
    length = ranked.groupBy(*scope, "chain").agg(F.count("*").alias("len"))
    shortest = length.groupBy(*scope).agg(F.min("len").alias("n"), F.count("*").alias("m"))
    cut = ranked.join(shortest, scope).where("rn <= n")
    per = cut.groupBy(*scope, "chain", "n", "m").agg(F.avg(value).alias("mu"), F.var_samp(value).alias("w"))
    out = per.groupBy(*scope, "n", "m").agg(F.avg("w").alias("within"), F.var_samp("mu").alias("between"))
    n, w, b = F.col("n").cast("double"), F.col("within"), F.col("between")
    value_ = F.sqrt(((n - 1) / n * w + b) / w)
    ok = (F.col("m") >= 2) & (n >= 2)
    return out.select(*scope, F.col("m").alias("n_chains"), F.when(ok & (w > 0), F.greatest(F.lit(1.0), value_)).when(ok & (b == 0), 1.0).alias("r_hat"))


def log_report(logs: DataFrame, text: str = "text") -> DataFrame:
    scanned = log_scan(F.col(text))
    return logs.select("*", scanned["parse_status"].alias("parse_status"), scanned["ess_line_hits"].alias("ess_line_hits"), scanned["excerpt_suffix"].alias("excerpt_suffix"))


#: Columns of ``bundle`` in the blocks of a report.
BLOCKS = {
    "population": ("ideal_per_district", "total_population", "per_draw_max_abs_rel_deviation", "draws_exceeding_tolerance", "n_exceeding", "mean_of_max_abs_rel_deviation", "max_of_max_abs_rel_deviation", "p95_of_max_abs_rel_deviation"),
    "county_splits": ("n_counties_in_frame", "per_draw_n_split_counties", "mean_n_split_counties", "max_n_split_counties"),
    "chains": ("n_chains", "r_hat_max_abs_rel_pop_deviation", "r_hat_n_split_counties"),
    "ensemble": ("n_unique", "n_duplicate"),
    "smc_log": ("parse_status", "stderr_path", "stdout_path", "ess_line_hits", "log_excerpt_chars", "excerpt_suffix"),
}


def bundle(assigned: DataFrame, districts: DataFrame, scope: list[str], tolerance: float | None = None, county: str | None = None, logs: DataFrame | None = None) -> DataFrame:
    """Population, splits, convergence, uniqueness and sampler log of every scope (DOM10): the columns of ``BLOCKS``,
    n_units, n_draws and ndists.

    assigned: (scope, draw, chain, precinct_id, district, population), and the column ``county`` if one is named, whose
    splits are counted then (it may be one of the scope). logs: what ``sources.logs.scanned`` returns, by scope. Without
    them, without ``tolerance`` or with one chain only, the columns they give are null.

    The ensemble is read once: one aggregation by (scope, draw, county, district), written, holds all that is asked. A draw
    covers every unit (the ensemble's contract), so the units of a scope are those of a draw.
    """
    part = F.col(county) if county else F.lit(None).cast("string")
    sums = [F.sum(h).alias(n) for n, h in _hashes().items()]
    parts = materialise(assigned.groupBy(*scope, "draw", "district", part.alias("__county")).agg(_population().alias("p"), F.count("*").alias("n"), F.min("chain").alias("chain"), *sums), "plan-parts")
    plans = parts.groupBy(*scope, "draw").agg(F.sum("n").alias("n"), F.min("chain").alias("chain"), *(F.sum(c).alias(c) for c in _hashes()))
    deviation = _deviation(parts.groupBy(*scope, "draw", "district").agg(F.sum("p").alias("p")), districts, [*scope, "draw"], scope)
    # A row of ``parts`` is a district within a county.
    per = parts.groupBy(*scope, "draw", "__county").agg(F.count("*").alias("n")).groupBy(*scope, "draw").agg(F.count_if(F.col("n") > 1).alias("splits"), F.count("*").alias("counties"))
    drawn = plans.select(*scope, "draw", "chain", "n").join(deviation, [*scope, "draw"]).join(per, [*scope, "draw"])
    drawn = materialise(drawn.withColumn("splits", F.when(F.lit(county is not None), F.col("splits"))), "draw-facts")
    population = population_summary(drawn, scope, tolerance)
    over = F.transform("per_draw_max_abs_rel_deviation", lambda x: x > tolerance) if tolerance is not None else F.lit(None).cast("array<boolean>")
    population = population.withColumn("draws_exceeding_tolerance", over).withColumn("n_exceeding", F.col("n_exceeding") if tolerance is not None else F.lit(None).cast("bigint"))
    series = F.transform(F.sort_array(F.collect_list(F.struct("draw", "splits"))), lambda x: x["splits"])
    facts = drawn.groupBy(*scope).agg(
        F.max("n").alias("n_units"),
        F.when(F.lit(county is not None), F.max("counties")).alias("n_counties_in_frame"),
        F.when(F.lit(county is not None), series).alias("per_draw_n_split_counties"),
        F.avg("splits").alias("mean_n_split_counties"),
        F.max("splits").alias("max_n_split_counties"),
    )
    hats = r_hat(drawn.select(*scope, "chain", "draw", F.col("deviation").alias("d"), F.col("splits").cast("double").alias("s")).unpivot([*scope, "chain", "draw"], ["d", "s"], "metric", "value").where("value is not null"), [*scope, "metric"])
    of = lambda metric: F.max(F.when((F.col("metric") == metric) & (F.col("n_chains") >= 2), F.col("r_hat")))
    chains = hats.groupBy(*scope).agg(F.max(F.when(F.col("n_chains") >= 2, F.col("n_chains"))).alias("n_chains"), of("d").alias("r_hat_max_abs_rel_pop_deviation"), of("s").alias("r_hat_n_split_counties"))
    out = facts.join(districts.select(*scope, "ndists"), scope).join(population, scope).join(_unique(plans, scope), scope).join(chains, scope, "left")
    if logs is not None:
        out = out.join(logs.select(*scope, *BLOCKS["smc_log"]), scope, "left")
    else:
        kinds = dict.fromkeys(BLOCKS["smc_log"], "string") | {"ess_line_hits": "bigint", "log_excerpt_chars": "bigint"}
        out = out.withColumns({c: F.lit(None).cast(kinds[c]) for c in BLOCKS["smc_log"]})
    return out.select(*scope, "n_units", "n_draws", "ndists", *(c for block in BLOCKS.values() for c in block))


def blocks() -> list[Column]:
    """A ``bundle``'s columns as a report has them: numbers of the whole, then a struct for each block (null
    where it has no content)."""
    empty = {"county_splits": "n_counties_in_frame", "chains": "n_chains", "smc_log": "parse_status"}
    whole = [F.col(c) for c in ("n_units", "n_draws", "ndists")]
    return whole + [F.when(F.col(empty[b]).isNotNull(), F.struct(*c)).alias(b) if b in empty else F.struct(*c).alias(b) for b, c in BLOCKS.items()]
