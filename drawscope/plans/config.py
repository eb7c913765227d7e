"""Settings of a run: bloc coding, problem, contiguity, where draws come from."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, quality, shapes
from ..operators.ensembles import from_indexed, index_contract
from ..operators.units import ContractError, unit_index, unit_index_of_all
from ..sources import stored
from . import generate

CODING_SCHEMA = "drawscope.bloc_coding/v1"


@dataclass(frozen=True)
class BlocCoding:
    """Which vote columns make up bloc A and bloc B (DOM15)."""

    a: tuple[str, ...]
    b: tuple[str, ...]
    label_a: str = "bloc a"
    label_b: str = "bloc b"

    def __post_init__(self) -> None:
        shared = sorted(set(self.a) & set(self.b))
        if shared:
            raise ContractError(f"columns of both blocs: {shared}")
        if not (self.a or self.b):
            raise ContractError("neither bloc has a column")

    @staticmethod
    def parse(raw: dict[str, Any]) -> BlocCoding:
        if raw.get("schema_version") != CODING_SCHEMA:
            raise ContractError(f"unsupported schema {raw.get('schema_version')!r}")
        sides = []
        for name in ("a", "b"):
            value = raw.get(name) or []
            if not isinstance(value, list):
                raise ContractError(f"{name!r} must be a list of columns")
            sides.append(tuple(map(str, value)))
        labels = {k: str(raw[k]) for k in ("label_a", "label_b") if raw.get(k)}
        return BlocCoding(*sides, **labels)

    @staticmethod
    def load(path: str) -> BlocCoding:
        return BlocCoding.parse(json.loads(Path(path).read_text(encoding="utf-8")))

    def table(self, spark: SparkSession) -> DataFrame:
        """(list_id, bloc), as the metrics take it; columns stand for list ids."""
        rows = [(c, "a") for c in self.a] + [(c, "b") for c in self.b]
        return spark.createDataFrame(rows, "list_id string, bloc string")


def long_votes(wide: DataFrame, coding: BlocCoding, key: str = "precinct_id") -> DataFrame:
    """The coding's columns of a wide vote table as (unit, list_id, votes); absent columns add nothing."""
    have = [c for c in (*coding.a, *coding.b) if c in wide.columns]
    if not have:
        return wide.select(key).limit(0).select(key, F.lit("").alias("list_id"), F.lit(0).cast("bigint").alias("votes"))
    return wide.select(key, *have).unpivot([key], have, "list_id", "votes").where("votes is not null")


@dataclass(frozen=True)
class Contiguity:
    """How neighbours are found (GR11): queen, rook, or fuzzy: shapes that meet, once widened by a buffer in metres if there is one."""

    rule: str = "queen"
    buffer_m: float | None = None

    def __post_init__(self) -> None:
        if self.rule not in ("queen", "rook", "fuzzy"):
            raise ContractError(f"unknown contiguity {self.rule!r}")
        if self.buffer_m is not None and self.buffer_m < 0:
            raise ContractError("a buffer can't be negative")

    def edges(self, units: DataFrame, scope: list[str]) -> DataFrame:
        if self.rule != "fuzzy":
            return graph.contiguity(units, self.rule, scope)
        return shapes.fuzzy_contiguity(quality.box_pairs(units, scope, grow=self.buffer_m or 0.0), self.buffer_m or 0.0, scope)


@dataclass(frozen=True)
class Problem:
    """What is to be judged: number of districts, names, tolerance, contiguity."""

    ndists: int = 106
    unit: str = "precinct_id"
    county: str = "maz"
    population: str = "voters"
    crs: str = "EPSG:4326"
    tolerance: float = 0.25
    contiguity: Contiguity = field(default_factory=Contiguity)

    def __post_init__(self) -> None:
        if self.ndists < 1 or self.tolerance < 0:
            raise ContractError("ndists must be positive, tolerance not negative")


@dataclass(frozen=True)
class EnsembleSource:
    """Where draws come from (DOM4): a stored ensemble, a sampler's CSV, or the generator."""

    kind: str
    path: str = ""
    draws: int = 4
    seed: int = 0
    per_chain: int | None = None

    def load(self, spark: SparkSession, units: DataFrame | None = None, edges: DataFrame | None = None, districts: DataFrame | None = None, scope: tuple[str, ...] = ("county",)) -> DataFrame:
        if self.kind == "parquet":
            return stored.ensemble(spark, self.path)
        if units is None:
            raise ContractError(f"{self.kind!r} needs units")
        if self.kind == "csv":
            rows = stored.sampler_csv(spark, self.path)
            # Indexes are those within a scope where the file names it, and those of all units otherwise.
            own = [c for c in scope if c in rows.columns]
            if index_contract(rows, own).where("not ok").limit(1).count():
                raise ContractError("a draw's unit indexes aren't 0 to n - 1")
            return from_indexed(rows, unit_index(units, own) if own else unit_index_of_all(units), own)
        if self.kind == "generated":
            if edges is None or districts is None:
                raise ContractError("the generator needs edges and districts")
            preflight(units, edges, districts, scope[0])
            return generate.generate(units, edges, districts, self.draws, self.seed, self.per_chain)
        raise ContractError(f"unknown ensemble source {self.kind!r}")


def preflight(units: DataFrame, edges: DataFrame, districts: DataFrame, scope: str = "county", connected: bool = False) -> None:
    """Counties can be sampled: no fewer units than districts and, if wanted, one piece (DOM6)."""
    few = units.groupBy(scope).agg(F.count("*").alias("n")).join(districts, scope).where(F.col("n") < F.col("ndists"))
    bad = [r[scope] for r in few.orderBy(scope).limit(20).collect()]
    if bad:
        raise ContractError(f"counties with fewer units than districts: {bad}")
    if connected:
        bad = [r[scope] for r in graph.health(units, edges, scope).where("not ok").orderBy(scope).limit(20).collect()]
        if bad:
            raise ContractError(f"counties in several pieces: {bad}")
