"""Plan ensembles as long tables (scope, draw, chain, precinct_id, district), and other layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import column_draw, draw_column
from .units import ContractError

WIDE_LIMIT = 1024


def completeness(ensemble: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Per scope: units, draws, rows, and whether every unit has one district in every draw (SRC12, PIV2)."""
    cells = ensemble.groupBy(*scope, "precinct_id", "draw").agg(F.count("*").alias("n"), F.count_if(F.col("district").isNull()).alias("nulls"))
    agg = [F.countDistinct("precinct_id").alias("n_units"), F.countDistinct("draw").alias("n_draws"), F.count("*").alias("n_cells"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("nulls"), F.lit(0)).alias("n_null")]
    out = cells.groupBy(*scope).agg(*agg) if scope else cells.agg(*agg)
    return out.withColumn("complete", (F.col("n_cells") == F.col("n_units") * F.col("n_draws")) & (F.col("n_null") == 0))


def collapse(ensemble: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """One row a (unit, draw): the least district, where rows repeat (they have no order)."""
    return ensemble.groupBy(*scope, "precinct_id", "draw").agg(F.min("district").alias("district"))


def require_complete(ensemble: DataFrame, scope: Sequence[str] = ()) -> None:
    if completeness(ensemble, scope).where("not complete").limit(1).count():
        raise ContractError("a unit lacks a district in some draw")


def first_chain(ensemble: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """The chain of a draw: that of its least unit (AGG23)."""
    return ensemble.groupBy(*scope, "draw").agg(F.min_by("chain", "precinct_id").alias("chain"))


def chain_of_draw(draw, n_per_run: int):
    """Chains of equal length one after another (WIN3)."""
    return ((draw - 1 - (draw - 1) % n_per_run) / n_per_run + 1).cast("int")


def to_wide(ensemble: DataFrame, draws: Sequence[int], key: str = "precinct_id", limit: int = WIDE_LIMIT) -> DataFrame:
    """A column d000001… for the n-th of ``draws`` (PIV4)."""
    if len(draws) > limit:
        raise ContractError(f"{len(draws)} draws are more than {limit} columns; use the long layout")
    place = F.create_map(*(F.lit(x) for i, d in enumerate(draws, 1) for x in (int(d), draw_column(i))))
    named = ensemble.where(F.col("draw").isin(list(draws))).select(key, F.try_element_at(place, F.col("draw")).alias("c"), "district")
    return named.groupBy(key).pivot("c", [draw_column(i + 1) for i in range(len(draws))]).agg(F.first("district"))


def to_long(wide: DataFrame, key: str = "precinct_id") -> DataFrame:
    """Wide columns back to (unit, draw index, district) (SRC13, PIV3)."""
    columns = [c for c in wide.columns if len(c) == 7 and c[0] == "d" and c[1:].isdigit()]
    return wide.unpivot([key], columns, "c", "district").select(key, column_draw(F.col("c")).alias("draw"), "district")


def from_columns(spark: SparkSession, unit_ids: Sequence[str], columns: Sequence[Sequence[int]], draw_ids: Sequence[int] | None = None, chains: Sequence[int] | None = None) -> DataFrame:
    """A long table from one list of districts a draw; shapes are checked (PIV5)."""
    draws = list(draw_ids) if draw_ids is not None else list(range(1, len(columns) + 1))
    if len(set(unit_ids)) != len(unit_ids):
        raise ContractError("unit ids repeat")
    if any(len(c) != len(unit_ids) for c in columns):
        raise ContractError("a draw's length isn't the number of units")
    if len(draws) != len(columns) or (chains is not None and len(chains) != len(columns)):
        raise ContractError("draw ids and chains must be as many as draws")
    rows = [(int(d), int(chains[i]) if chains is not None else None, list(map(int, columns[i]))) for i, d in enumerate(draws)]
    held = spark.createDataFrame(rows, "draw int, chain int, labels array<int>")
    units = F.lit(list(unit_ids)) if unit_ids else F.array().cast("array<string>")
    return held.select("draw", "chain", F.explode(F.arrays_zip(units.alias("u"), F.col("labels").alias("d"))).alias("z")).select(F.col("z.u").alias("precinct_id"), "draw", "chain", F.col("z.d").alias("district"))


def from_label_columns(units: DataFrame, columns: Sequence[str], draw_ids: Sequence[int] | None = None, chains: Sequence[int] | None = None, key: str = "precinct_id") -> DataFrame:
    """A long table from a table with a column of districts for each draw (PIV5). A unit that repeats, or lacks a
    district, stops the job that reads it."""
    draws = list(draw_ids) if draw_ids is not None else list(range(1, len(columns) + 1))
    if len(draws) != len(columns) or len(set(draws)) != len(draws) or (chains is not None and len(chains) != len(columns)):
        raise ContractError("draw ids and chains must be as many as draws, and differ")
    whole = F.expr(" and ".join(f"`{c}` is not null" for c in columns)) if columns else F.lit(True)
    one = units.groupBy(key).agg(F.count("*").alias("__n"), *(F.first(c).alias(c) for c in columns))
    sure = F.when((F.col("__n") == 1) & whole, F.col(key)).otherwise(F.raise_error(F.lit("a unit repeats or lacks a district")))
    labels = F.array(*(F.struct(F.lit(int(d)).alias("draw"), F.lit(int(chains[i]) if chains is not None else None).cast("int").alias("chain"), F.col(columns[i]).cast("int").alias("district")) for i, d in enumerate(draws)))
    return one.select(sure.cast(units.schema[key].dataType).alias(key), F.explode(labels).alias("z")).select(key, "z.draw", "z.chain", "z.district")


def from_indexed(rows: DataFrame, units: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Sampler rows (unit_index, draw, chain, district) with ids for indexes (SRC11).
    units: (scope, unit_index, precinct_id)."""
    return rows.join(units.select(*scope, "unit_index", "precinct_id").hint("merge"), [*scope, "unit_index"]).select(*scope, "precinct_id", "draw", "chain", "district")


def index_contract(rows: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Per draw: whether the unit indexes are exactly 0 to n - 1 (SRC11)."""
    per = rows.groupBy(*scope, "draw").agg(F.count("*").alias("n_rows"), F.countDistinct("unit_index").alias("n_units"), F.min("unit_index").alias("low"), F.max("unit_index").alias("high"))
    return per.withColumn("ok", (F.col("n_rows") == F.col("n_units")) & (F.col("low") == 0) & (F.col("high") == F.col("n_units") - 1))


def single_draw(ensemble: DataFrame, draw: int) -> DataFrame:
    """One draw's districts; the filter and the columns reach the Parquet scan (SRC14)."""
    return ensemble.where(F.col("draw") == draw).select("precinct_id", "district")
