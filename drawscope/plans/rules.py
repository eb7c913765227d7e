"""Legal rules as a table of violations, for all draws at once.

Rules come in stages, and a plan that breaks one of an early stage is not held against later
ones: counties known, electors present, labels in range, labels used; then balance, contiguity
and county span together.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import district_components

SCHEMA = "drawscope.constraint_spec/v1"


@dataclass(frozen=True)
class ElectorBalance:
    ndists: int = 106
    max_relative_deviation: float = 0.15


@dataclass(frozen=True)
class Contiguity:
    enabled: bool = True


@dataclass(frozen=True)
class CountyContainment:
    enabled: bool = True


@dataclass(frozen=True)
class Spec:
    elector_balance: ElectorBalance = field(default_factory=ElectorBalance)
    contiguity: Contiguity = field(default_factory=Contiguity)
    county_containment: CountyContainment = field(default_factory=CountyContainment)

    def to_json(self) -> str:
        return json.dumps({"schema_version": SCHEMA} | asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Spec:
        raw = json.loads(text)
        if raw.get("schema_version") != SCHEMA:
            raise ValueError(f"unsupported schema {raw.get('schema_version')!r}")
        return Spec(ElectorBalance(**raw["elector_balance"]), Contiguity(**raw["contiguity"]), CountyContainment(**raw["county_containment"]))


def violations(assigned: DataFrame, districts: DataFrame, edges: DataFrame | None, scope: list[str], spec: Spec | None = None, county: str | None = None) -> DataFrame:
    """(scope, draw, code, district): what every plan breaks (DOM2).

    assigned: (scope, draw, precinct_id, district, population and, if counties count, the column
    ``county``); districts: (scope, ndists).
    """
    spec = spec or Spec()
    keys = [*scope, "draw"]
    none = F.lit(None).cast("int")
    if spec.county_containment.enabled and county is None:
        return assigned.select(*keys).distinct().select(*keys, F.lit("missing_county_ids").alias("code"), none.alias("district"))
    rows = assigned.join(F.broadcast(districts.select(*scope, "ndists")), scope)
    nd, d = F.col("ndists"), F.col("district")
    outside = d.isNull() | (d < 1) | (d > nd)
    per = rows.groupBy(*keys, "ndists", "district").agg(F.sum(F.coalesce(F.col("population").cast("double"), F.lit(0.0))).alias("p"), F.count("*").alias("n"), *([F.countDistinct(county).alias("counties")] if county else []))
    plans = per.groupBy(*keys, "ndists").agg(F.sum("p").alias("total"), F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("n_outside"), F.count_if(~outside).alias("used"))
    stage = F.when(F.col("total") <= 0, "zero_total_electors").when(F.col("n_outside") > 0, "invalid_district_label").when(F.col("used") < nd, "district_label_coverage")
    staged = plans.withColumn("code", stage)
    zero = staged.where(F.col("code").isNotNull() & (F.col("code") != "invalid_district_label")).select(*keys, "code", none.alias("district"))
    wrong = assigned.join(staged.where("code = 'invalid_district_label'").select(*keys, "ndists"), keys).where(outside).select(*keys, F.lit("invalid_district_label").alias("code"), none.alias("district"))
    sound = staged.where("code is null").select(*keys, "total")
    checked = per.join(sound, keys)
    ideal = F.col("total") / nd
    out = [zero, wrong, checked.where(F.abs(F.col("p") - ideal) / ideal > spec.elector_balance.max_relative_deviation + 1e-12).select(*keys, F.lit("elector_deviation").alias("code"), "district")]
    if spec.contiguity.enabled and edges is not None:
        pieces = district_components(assigned.join(sound.select(*keys), keys, "left_semi"), edges, scope)
        out.append(pieces.where("n_pieces > 1").select(*keys, F.lit("district_disconnected").alias("code"), "district"))
    if spec.county_containment.enabled:
        out.append(checked.where("counties > 1").select(*keys, F.lit("county_span_violation").alias("code"), "district"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found
