"""Two-bloc metrics of plans, enacted or simulated, for all scopes and draws at once.

Votes are summed per (keys, district), then metrics per keys: two chained hash aggregations.
A *scope* is what votes are balanced over (a county). Undefined values are null, never NaN.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.units import ContractError, on_units
from ..scratch import materialise

METRICS = ("vote_share_a", "seat_share_a", "efficiency_gap", "mean_median_a_share_diff")


@dataclass(frozen=True)
class Safety:
    """Least totals, and what to do below them: raise, skip_balance or clip (the same as skip)."""

    eps_bloc: float = 1e-9
    eps_total: float = 1e-9
    on_small_values: str = "raise"

    def __post_init__(self) -> None:
        if self.eps_bloc <= 0 or self.eps_total <= 0:
            raise ValueError("eps_bloc and eps_total must be positive")
        if self.on_small_values not in ("raise", "skip_balance", "clip"):
            raise ValueError(f"unknown on_small_values {self.on_small_values!r}")


@dataclass(frozen=True)
class Policy:
    balance: bool = True
    mode: str = "symmetric"
    safety: Safety = field(default_factory=Safety)

    def __post_init__(self) -> None:
        if self.mode != "symmetric":
            raise ValueError(f"unsupported balance mode {self.mode!r}")

    def summary(self) -> dict:
        return asdict(self)


def bloc_votes(units: DataFrame, votes: DataFrame, coding: DataFrame, unit: str = "precinct_id") -> DataFrame:
    """``units`` with the columns votes_a, votes_b and in_votes. votes: (unit, list_id, votes);
    coding: (list_id, bloc) with bloc a or b. Lists without a bloc, and missing cells, add 0 (PRJ3)."""
    coded = votes.join(F.broadcast(coding), "list_id", "left")
    cell = F.coalesce(F.col("votes").cast("double"), F.lit(0.0))
    sums = coded.groupBy(unit).agg(F.sum(F.when(F.col("bloc") == "a", cell).otherwise(0.0)).alias("votes_a"), F.sum(F.when(F.col("bloc") == "b", cell).otherwise(0.0)).alias("votes_b"), F.lit(True).alias("in_votes"))
    joined = units.join(sums, unit, "left")
    return joined.withColumns({"votes_a": F.coalesce("votes_a", F.lit(0.0)), "votes_b": F.coalesce("votes_b", F.lit(0.0)), "in_votes": F.coalesce("in_votes", F.lit(False))})


def balance_factors(votes: DataFrame, scope: list[str], policy: Policy | None = None) -> DataFrame:
    """Per scope: sum_a, sum_b, factor x = sqrt(sum_b / sum_a) (null if not balanced), skip_reason (AGG26)."""
    policy = policy or Policy()
    s = policy.safety
    sums = votes.groupBy(*scope).agg(F.sum("votes_a").alias("sum_a"), F.sum("votes_b").alias("sum_b"))
    a, b = F.col("sum_a"), F.col("sum_b")
    small = (a <= s.eps_bloc) | (b <= s.eps_bloc)
    reason = F.lit("balance_disabled") if not policy.balance else F.when(a + b <= s.eps_total, "total_turnout_below_eps_total").when(small, "bloc_total_below_eps_bloc")
    if policy.balance and s.on_small_values == "raise":
        # Raised by whatever job reads the factors: no action of its own.
        reason = F.when(a + b <= s.eps_total, "total_turnout_below_eps_total").when(small, F.raise_error(F.lit(f"vote balance unsafe: a bloc total is at most {s.eps_bloc}")).cast("string"))
    return sums.withColumn("skip_reason", reason.cast("string")).withColumn("factor", F.when(F.col("skip_reason").isNull(), F.sqrt(b / a)))


def balanced(votes: DataFrame, scope: list[str], policy: Policy | None = None) -> DataFrame:
    """``votes`` with votes_a and votes_b scaled by their scope's factor. Scopes are few (one row
    each); the factors are joined back, so no scope is gathered in one task."""
    factors = balance_factors(votes, scope, policy).select(*scope, "factor")
    x = F.coalesce("factor", F.lit(1.0))
    return votes.join(factors, scope).withColumns({"votes_a": F.col("votes_a") * x, "votes_b": F.col("votes_b") / x}).drop("factor")


def district_totals(assigned: DataFrame, keys: list[str], district: str = "district") -> DataFrame:
    """Bloc totals and number of units by district (AGG1, AGG17)."""
    return assigned.groupBy(*keys, district).agg(F.sum("votes_a").alias("a"), F.sum("votes_b").alias("b"), F.count("*").alias("n_units"))


def tie(a: Column, b: Column) -> Column:
    """Totals that are equal up to rounding, or no turnout (FN7)."""
    t = a + b
    return (t <= 0) | (F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * 1e-12, F.greatest(F.lit(1e-9), t * 1e-12)))


def _seats(a: Column, b: Column) -> Column:
    return F.sum(F.when(a + b <= 0, 0.0).when(tie(a, b), 0.5).when(a > b, 1.0).otherwise(0.0))


def _wasted(a: Column, b: Column) -> tuple[Column, Column]:
    """The winner wastes its margin, the loser all its votes; a tie wastes nothing."""
    live, even = a + b > 0, tie(a, b)
    of = lambda x, y: F.sum(F.when(~live | even, 0.0).when(x > y, x - y).otherwise(x))
    return of(a, b), of(b, a)


def vote_share(a: Column, b: Column, eps: float) -> Column:
    t = F.sum(a) + F.sum(b)
    return F.when(t > 0, F.sum(a) / t).otherwise(0.0)


def seat_share(a: Column, b: Column, eps: float) -> Column:
    n = F.sum(F.when(a + b > 0, 1.0).otherwise(0.0))
    return F.when(n > 0, _seats(a, b) / n).otherwise(0.0)


def efficiency_gap(a: Column, b: Column, eps: float) -> Column:
    wa, wb = _wasted(a, b)
    t = F.sum(F.when(a + b > 0, a + b).otherwise(0.0))
    return F.when(t > eps, (wa - wb) / t).otherwise(0.0)


def mean_median(a: Column, b: Column, eps: float) -> Column:
    share = F.when(a + b > 0, a / (a + b))
    return F.avg(share) - F.percentile(share, 0.5)


#: Name of each metric and its aggregate over the district totals of one plan.
REGISTRY: dict[str, Callable[[Column, Column, float], Column]] = {
    "vote_share_a": vote_share,
    "seat_share_a": seat_share,
    "efficiency_gap": efficiency_gap,
    "mean_median_a_share_diff": mean_median,
}


def plan_metrics(totals: DataFrame, keys: list[str], policy: Policy | None = None, names: tuple[str, ...] = METRICS) -> DataFrame:
    """A row of metrics per plan (AGG2-5, DOM7)."""
    eps = (policy or Policy()).safety.eps_total
    a, b = F.col("a"), F.col("b")
    return totals.groupBy(*keys).agg(*(REGISTRY[n](a, b, eps).alias(n) for n in names))


def seats(totals: DataFrame, keys: list[str]) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return totals.groupBy(*keys).agg(_seats(a, b).alias("seats_a"), F.count_if(a + b > 0).alias("n_effective"), F.sum("a").alias("total_a"), F.sum("b").alias("total_b"))


def first_focal(focal: DataFrame, unit: str = "precinct_id", district: str = "district") -> DataFrame:
    """One label a unit; empty labels are none. Of several, the least (rows have no order) (JN4)."""
    label = F.nullif(F.trim(F.col(district).cast("string")), F.lit(""))
    return focal.groupBy(unit).agg(F.min(label).alias("focal_district"))


def coverage(units: DataFrame, scope: list[str]) -> DataFrame:
    """Counters over units that hold votes_a, votes_b, in_votes and focal_district (AGG16)."""
    voting = F.col("votes_a") + F.col("votes_b") > 0
    miss = F.col("focal_district").isNull()
    return units.groupBy(*scope).agg(
        F.count("*").alias("n_units"),
        F.count_if(voting).alias("n_units_with_positive_two_party_votes"),
        F.count_if(~F.col("in_votes")).alias("n_units_missing_vote_row"),
        F.count_if(miss).alias("n_units_missing_focal_district"),
        F.count_if(voting & miss).alias("n_voting_units_missing_focal"),
    )


def long_metrics(rows: DataFrame, keys: list[str], names: tuple[str, ...] = METRICS) -> DataFrame:
    return rows.unpivot(keys, list(names), "metric", "value")


def draw_metrics(units: DataFrame, ensemble: DataFrame, scope: list[str], policy: Policy | None = None) -> DataFrame:
    """Metrics of every (scope, draw). ``units`` hold balanced votes. The ensemble is the large
    side: it is joined as it lies, and only its partial sums by district are shuffled."""
    votes = units.select(*scope, "precinct_id", "votes_a", "votes_b")
    return plan_metrics(district_totals(on_units(ensemble, votes, [*scope, "precinct_id"]), [*scope, "draw"]), [*scope, "draw"], policy)


def draw_series(units: DataFrame, votes: DataFrame, coding: DataFrame, ensemble: DataFrame, scope: list[str], policy: Policy | None = None) -> DataFrame:
    """(scope, draw, metric, value) of every draw, for histograms (DOM13)."""
    blocs = balanced(materialise(bloc_votes(units, votes, coding), "blocs"), scope, policy)
    return long_metrics(draw_metrics(blocs, ensemble, scope, policy), [*scope, "draw"])


def compare(units: DataFrame, votes: DataFrame, coding: DataFrame, focal: DataFrame, ensemble: DataFrame, scope: list[str] | None = None, policy: Policy | None = None, strict: bool = True) -> DataFrame:
    """Enacted plan against the ensemble (DOM8): a row for each scope and metric.

    units (scope, precinct_id) are the ensemble's units; votes (precinct_id, list_id, votes);
    coding (list_id, bloc); focal (precinct_id, district); ensemble (scope, draw, precinct_id,
    district). ``strict``: a voting unit without an enacted district stops the job (DOM9).

    A focal value that is undefined becomes 0, except for the mean-median difference. Values
    are compared after rounding to 12 digits, since sums come in any order on a cluster.
    """
    return comparison(units, votes, coding, focal, ensemble, scope, policy, strict)[0]


def comparison(units: DataFrame, votes: DataFrame, coding: DataFrame, focal: DataFrame, ensemble: DataFrame, scope: list[str] | None = None, policy: Policy | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(what ``compare`` returns, a row for each scope with the counters of ``coverage`` and the totals, factor and
    skip reason of ``balance_factors``)."""
    scope = scope or ["county"]
    # A row a unit, read by the enacted plan, the draws, the count of units and the strict check: written once.
    raw = materialise(bloc_votes(units, votes, coding), "blocs")
    blocs = balanced(raw, scope, policy)
    labels = first_focal(focal)
    labelled = blocs.join(labels, "precinct_id", "left")
    if strict and labelled.where((F.col("votes_a") + F.col("votes_b") > 0) & F.col("focal_district").isNull()).limit(1).count():
        raise ContractError("units with votes lack an enacted district")
    enacted = plan_metrics(district_totals(labelled.where("focal_district is not null"), scope, "focal_district"), scope, policy)
    focal_rows = long_metrics(enacted, scope).withColumnRenamed("value", "focal_value")
    focal_rows = focal_rows.withColumn("focal_value", F.when((F.col("metric") != "mean_median_a_share_diff"), F.coalesce("focal_value", F.lit(0.0))).otherwise(F.col("focal_value")))
    draws = long_metrics(draw_metrics(blocs, ensemble, scope, policy), [*scope, "draw"])
    return summarise(draws, focal_rows, scope), coverage(raw.join(labels, "precinct_id", "left"), scope).join(balance_factors(raw, scope, policy), scope)


def summarise(draws: DataFrame, focal_rows: DataFrame, scope: list[str]) -> DataFrame:
    """Mean, 5 % and 95 % points of the draws (linear interpolation, AGG11), and the share of
    draws that are at most the enacted value (AGG12). The enacted values are one row for each
    scope and metric, so they are joined to the draws before the only aggregation."""
    keys = [*scope, "metric"]
    below = F.coalesce(F.round("value", 12) <= F.round("focal_value", 12), F.lit(False))
    return draws.join(focal_rows, keys, "left").groupBy(*keys).agg(
        F.first("focal_value").alias("focal_value"),
        F.avg("value").alias("ensemble_mean"),
        F.percentile("value", 0.05).alias("ensemble_p05"),
        F.percentile("value", 0.95).alias("ensemble_p95"),
        (100.0 * F.avg(below.cast("double"))).alias("percentile_rank"),
        F.count("*").alias("n_draws"),
    )


def recomputed_difference(stored: DataFrame, fresh: DataFrame, keys: list[str], column: str = "efficiency_gap", tolerance: float = 1e-9) -> DataFrame:
    """Rows whose stored and recomputed values differ by more than ``tolerance``, or of which one is missing (DOM14)."""
    both = stored.select(*keys, F.col(column).alias("stored")).join(fresh.select(*keys, F.col(column).alias("recomputed")), keys, "full_outer")
    return both.where(F.coalesce(F.abs(F.col("stored") - F.col("recomputed")) > tolerance, F.lit(True)))
