"""Geometry quality: overlaps between units, severity flags, hubs of overlaps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rings
from ..functions.keys import joined_reasons, worst_severity
from . import tiles
from .units import ContractError, official

OVERLAP = ("n_overlap_partners", "sum_overlap_area_m2", "max_overlap_area_m2", "max_overlap_ratio")


def measured(units: DataFrame, shape: str = "shape", unit: str = "precinct_id") -> DataFrame:
    """Area, outer perimeter, compactness, parts and holes of each unit (GEO5). Null shapes give nulls."""
    s = F.col(shape)
    sized = units.select(*[c for c in units.columns if c != shape], rings.area(s).alias("area_m2"), rings.exterior_length(s).alias("perimeter_m"), rings.n_parts(s).alias("n_polygon_parts"), rings.n_holes(s).alias("n_holes"))
    return sized.withColumn("polsby_popper", rings.polsby_popper(F.col("area_m2"), F.col("perimeter_m")))


def box_pairs(units: DataFrame, scope: list[str], shape: str = "shape", unit: str = "precinct_id", grow: float = 0.0, most: int = 32) -> DataFrame:
    """Pairs (a < b) within a scope whose bounds meet (JN6), with both shapes.

    Bounds are dealt to tiles that follow the data (``tiles.meeting``). ``grow`` widens them on every side. Only ids and bounds
    are dealt; shapes are fetched for the pairs that are kept, so ids are unique within a scope.
    """
    b = rings.bounds(F.col(shape))
    boxed = units.where(F.size(shape) > 0).select(*scope, F.col(unit).alias("id"), *((b[n] + (-grow if n.startswith("min") else grow)).alias(n) for n in tiles.BOUNDS))
    shapes = [units.select(*scope, F.col(unit).alias(f"id_{x}"), F.col(shape).alias(f"s_{x}")) for x in "ab"]
    return tiles.meeting(boxed, scope, most).join(shapes[0], [*scope, "id_a"]).join(shapes[1], [*scope, "id_b"])


def overlap_pairs(pairs: DataFrame, intersection: Column, scope: list[str], min_area: float = 5.0, min_ratio: float | None = 0.001) -> DataFrame:
    """Material overlaps (GEO6): of at least ``min_area``, and of at least ``min_ratio`` of the smaller unit."""
    sized = pairs.select(*scope, F.col("id_a").alias("precinct_id_a"), F.col("id_b").alias("precinct_id_b"), intersection.alias("intersection_area_m2"), F.least(rings.area(F.col("s_a")), rings.area(F.col("s_b"))).alias("smaller"))
    ratio = F.when(F.col("smaller") > 0, F.col("intersection_area_m2") / F.col("smaller")).otherwise(0.0)
    out = sized.withColumn("overlap_ratio_max", ratio).drop("smaller").where(F.col("intersection_area_m2") >= min_area)
    return out.where(F.col("overlap_ratio_max") >= min_ratio) if min_ratio is not None else out


def rectangle_intersection() -> Column:
    """Common area of units that are axis-parallel rectangles, from their bounds."""
    side = lambda c: F.greatest(F.lit(0.0), F.least(f"max{c}_a", f"max{c}_b") - F.greatest(f"min{c}_a", f"min{c}_b"))
    return side("x") * side("y")


def overlap_units(units: DataFrame, pairs: DataFrame, unit: str = "precinct_id") -> DataFrame:
    """Partners, sum and greatest of a unit's overlaps, 0 for units without (AGG13)."""
    sides = pairs.select(F.col("precinct_id_a").alias(unit), F.col("precinct_id_b").alias("other"), "intersection_area_m2", "overlap_ratio_max").unionByName(pairs.select(F.col("precinct_id_b").alias(unit), F.col("precinct_id_a").alias("other"), "intersection_area_m2", "overlap_ratio_max"))
    per = sides.groupBy(unit).agg(F.countDistinct("other").alias(OVERLAP[0]), F.sum("intersection_area_m2").alias(OVERLAP[1]), F.max("intersection_area_m2").alias(OVERLAP[2]), F.max("overlap_ratio_max").alias(OVERLAP[3]))
    return merged(units.select(unit), per, unit)


def merged(metrics: DataFrame, overlaps: DataFrame, unit: str = "precinct_id", check: bool = False) -> DataFrame:
    """Overlap columns on metrics, missing as 0 (JN5); ``check``: both sides hold a unit once."""
    if check:
        for side in (metrics, overlaps):
            if side.groupBy(unit).count().where("count > 1").limit(1).count():
                raise ContractError(f"{unit} isn't unique")
    out = metrics.join(overlaps, unit, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0 if c == OVERLAP[0] else 0.0)) for c in OVERLAP if c in out.columns})


@dataclass(frozen=True)
class Flags:
    min_county_n_for_tukey: int = 20
    tukey_k_warn: float = 1.5
    tukey_k_severe: float = 3.0
    warn_if_overlap_partners_ge: int | None = 1
    severe_if_overlap_partners_ge: int | None = 15
    warn_polsby_below: float | None = None


def fences(rows: DataFrame, scope: list[str], options: Flags) -> DataFrame:
    """Quartiles of log area per county that has enough of them and some spread (AGG20)."""
    log = F.when(F.col("area_m2") > 0, F.log("area_m2"))
    per = rows.groupBy(*scope).agg(F.percentile(log, 0.25).alias("q1"), F.percentile(log, 0.75).alias("q3"), F.count(log).alias("n_log"))
    return per.where((F.col("n_log") >= options.min_county_n_for_tukey) & (F.col("q3") > F.col("q1")))


def flagged(rows: DataFrame, scope: list[str], options: Flags | None = None) -> DataFrame:
    """qa_severity and qa_reasons of each unit (FN20): partners, area fences, compactness."""
    o = options or Flags()
    limits = fences(rows, scope, o).select(*scope, "q1", "q3")
    joined = rows.join(F.broadcast(limits), scope, "left")
    log = F.when(F.col("area_m2") > 0, F.log("area_m2"))
    spread = F.col("q3") - F.col("q1")
    outside = lambda k: F.coalesce((log < F.col("q1") - k * spread) | (log > F.col("q3") + k * spread), F.lit(False))
    n = F.col("n_overlap_partners")
    severe = F.lit(False) if o.severe_if_overlap_partners_ge is None else n >= o.severe_if_overlap_partners_ge
    warn = F.lit(False) if o.warn_if_overlap_partners_ge is None else (n >= o.warn_if_overlap_partners_ge) & ~severe
    far = outside(o.tukey_k_severe)
    mild = outside(o.tukey_k_warn) & ~far
    thin = F.lit(False) if o.warn_polsby_below is None else F.coalesce(F.col("polsby_popper") < o.warn_polsby_below, F.lit(False))
    reasons = joined_reasons((severe, f"overlap_partners>={o.severe_if_overlap_partners_ge}"), (warn, f"overlap_partners>={o.warn_if_overlap_partners_ge}"), (far, "log_area_tukey_far"), (mild, "log_area_tukey_mild"), (thin, f"polsby_popper<{o.warn_polsby_below}"))
    return joined.select(*rows.columns, worst_severity((severe, 2), (far, 2), (warn, 1), (mild, 1), (thin, 1)).alias("qa_severity"), reasons.alias("qa_reasons"))


def summarised(rows: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row of counts by severity (AGG14)."""
    counts = rows.agg(*(F.count_if(F.col("qa_severity") == s).alias(f"n_{s}") for s in ("ok", "warn", "severe")), F.count_if(F.col("n_overlap_partners") > 0).alias("n_precincts_with_overlap"))
    return counts if pairs is None else counts.crossJoin(pairs.agg(F.count("*").alias("n_material_overlap_pairs")))


def hotspots(rows: DataFrame, n: int = 10, unit: str = "precinct_id") -> DataFrame:
    """Units with most partners, ties by id (ORD2)."""
    return rows.select(unit, "n_overlap_partners").orderBy(F.desc("n_overlap_partners"), unit).limit(n)


@dataclass(frozen=True)
class HubDrop:
    hard_min_partners: int | None = 100
    soft_min_partners: int | None = 30
    mass_ratio: float = 1.5
    max_drop_rows: int = 200
    allow_exceed_max: bool = False

    def __post_init__(self) -> None:
        if not 0 < self.mass_ratio < float("inf"):
            raise ValueError("mass_ratio must be finite and positive")

    @property
    def tiers(self) -> tuple[bool, bool]:
        return tuple(v is not None and v > 0 for v in (self.hard_min_partners, self.soft_min_partners))


def hub_masks(rows: DataFrame, options: HubDrop | None = None) -> DataFrame:
    """Boolean columns hard, soft and drop (FLT6)."""
    o = options or HubDrop()
    hard_on, soft_on = o.tiers
    n, a, s = F.col("n_overlap_partners"), F.col("area_m2"), F.col("sum_overlap_area_m2")
    sound = a.isNotNull() & ~F.isnan(a) & (a > 0) & (a < float("inf"))
    hard = n >= o.hard_min_partners if hard_on else F.lit(False)
    soft = F.coalesce((n >= o.soft_min_partners) & sound & (s >= o.mass_ratio * a), F.lit(False)) if soft_on else F.lit(False)
    return rows.withColumns({"hard": hard, "soft": soft}).withColumn("drop", F.col("hard") | F.col("soft"))


def dropped_hubs(rows: DataFrame, options: HubDrop | None = None, unit: str = "precinct_id") -> DataFrame:
    """What is dropped, and why; more than the limit is an error (FLT7)."""
    o = options or HubDrop()
    out = hub_masks(rows, o).where("drop")
    if o.max_drop_rows > 0 and not o.allow_exceed_max:
        n = out.limit(o.max_drop_rows + 1).count()
        if n > o.max_drop_rows:
            raise ContractError(f"more than max_drop_rows={o.max_drop_rows} units would be dropped")
    return out.select(unit, F.when(F.col("hard"), "hard").otherwise("soft").alias("reason"), "n_overlap_partners", "sum_overlap_area_m2", "area_m2")


def without_hubs(units: DataFrame, dropped: DataFrame, unit: str = "precinct_id") -> DataFrame:
    """Official units in ``dropped`` go; others are never dropped."""
    gone = official(units).join(dropped.select(unit), unit, "left_semi").select(unit) if "unit_kind" in units.columns else dropped.select(unit)
    return units.join(gone, unit, "left_anti")


def least_area(rows: DataFrame, least: float) -> DataFrame:
    return rows.where(F.col("area_m2") >= least)


def area_totals(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Number, total and mean area per county (AGG19)."""
    return rows.groupBy(*scope).agg(F.count("*").alias("n_units"), F.sum("area_m2").alias("total_area_m2"), F.avg("area_m2").alias("mean_area_m2"))


def repair_statistics(rows: DataFrame, listed: int = 50) -> DataFrame:
    """rows: (precinct_id, area_before, area_after, was_valid, is_empty) (AGG24)."""
    ids = F.array_sort(F.collect_list(F.when(F.col("is_empty"), F.col("precinct_id"))))
    return rows.agg(F.count_if(~F.col("was_valid")).alias("n_invalid"), F.count_if("is_empty").alias("n_empty"), F.max(F.abs(F.col("area_after") - F.col("area_before"))).alias("max_abs_area_delta"), F.slice(ids, 1, listed).alias("empty_ids"))
