"""Sinks: tables through Spark's writers, small documents as text through them too."""

from __future__ import annotations

import json
import subprocess
import sys
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ensembles import require_complete, to_wide
from ..operators.units import unit_index
from .stored import ENSEMBLE_SCHEMA, fingerprint, id_hash


def finite_nulls(df: DataFrame) -> DataFrame:
    """Every double, at any depth, null where it isn't finite (SNK6)."""

    def fixed(c, kind):
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: fixed(x, kind.elementType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*(fixed(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, v: fixed(v, kind.valueType))
        return c

    return df.select(*(fixed(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet, zstd (SNK1, SNK5)."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json_rows(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """One strict JSON object a row (SNK6)."""
    keep = [c for c in partition_by]
    rows = finite_nulls(df).select(*keep, F.to_json(F.struct(*[c for c in df.columns if c not in keep]), {"ignoreNullFields": "false"}).alias("value"))
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*keep) if keep else writer).text(path)


def write_document(spark: SparkSession, value: dict, path: str) -> None:
    """A small JSON document, in whatever store the path names."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True, allow_nan=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def geojson_rows(units: DataFrame, shape: str = "shape") -> DataFrame:
    """A GeoJSON feature a row (newline-delimited GeoJSON) (SNK2)."""
    coordinates = F.transform(shape, lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"]))))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates"))
    properties = F.struct(*[c for c in units.columns if c != shape])
    return units.select(F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("value"))


def write_ensemble(ensemble: DataFrame, folder: str, layout: str = "long", metadata: dict | None = None, check: bool = True) -> dict:
    """An ensemble and its manifest (SNK3). ``long`` is partitioned by county where there is one,
    so a county's draws are read alone; ``wide`` has a column a draw.

    The manifest holds the numbers of units and draws, the draws and their chains, sha256 of the sorted
    unit ids, and sha256 over the files. Unit ids lie beside it as a table, since there is no bound on them.
    """
    spark = ensemble.sparkSession
    scope = [c for c in ("county",) if c in ensemble.columns]
    if check:
        require_complete(ensemble, scope)
    if layout == "wide":
        draws = [r.draw for r in ensemble.select("draw").distinct().orderBy("draw").limit(1025).collect()]
        write_table(to_wide(ensemble, draws), f"{folder}/assignments")
    elif layout == "long":
        write_table(ensemble, f"{folder}/assignments", scope)
    else:
        raise ValueError(f"unknown layout {layout!r}")
    chain = F.min("chain") if "chain" in ensemble.columns else F.lit(None).cast("int")
    per = ensemble.groupBy("draw").agg(chain.alias("chain")).orderBy("draw").collect()  # a row a draw
    write_table(ensemble.select("precinct_id").distinct().orderBy("precinct_id"), f"{folder}/units")
    units = spark.read.parquet(f"{folder}/units")
    meta = {
        "schema_version": ENSEMBLE_SCHEMA,
        "layout": layout,
        "precinct_id_column": "precinct_id",
        "n_units": units.count(),
        "n_draws": len(per),
        "draw_ids": [r.draw for r in per],
        "chain_per_draw": [r.chain for r in per] if any(r.chain is not None for r in per) else None,
        "unit_ids_hash": id_hash(units),
        "sha256": fingerprint(spark, f"{folder}/assignments", "*.parquet"),
        "metadata": metadata or {},
    }
    write_document(spark, meta, f"{folder}/manifest")
    return meta


def write_edges(edges: DataFrame, folder: str, meta: dict | None = None) -> None:
    """Edges and their description (SNK4)."""
    write_table(edges, f"{folder}/edges")
    write_document(edges.sparkSession, {"schema_version": "drawscope.adjacency/v1"} | (meta or {}), f"{folder}/meta")


def sampler_bundle(units: DataFrame, edges: DataFrame, scope: Sequence[str] = ("county",)) -> tuple[DataFrame, DataFrame]:
    """(indexed units, indexed edges i < j) for an external sampler (SNK7)."""
    indexed = unit_index(units, scope)
    a = indexed.select("precinct_id", F.col("unit_index").alias("a"), *scope)
    b = indexed.select(F.col("precinct_id").alias("other"), F.col("unit_index").alias("b"))
    pairs = edges.select("src", "dst").join(a, F.col("src") == F.col("precinct_id")).join(b, F.col("dst") == F.col("other"))
    return indexed, pairs.select(*scope, F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))


def write_bundle(units: DataFrame, edges: DataFrame, folder: str, run: dict, scope: Sequence[str] = ("county",)) -> None:
    indexed, pairs = sampler_bundle(units, edges, scope)
    write_table(indexed, f"{folder}/units", scope)
    writer = pairs.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*scope) if scope else writer).csv(f"{folder}/edges")
    write_document(units.sparkSession, {"schema_version": "drawscope.sampler_run/v1"} | run, f"{folder}/run")


def run_manifest(stages: Sequence[str], inputs: dict[str, str], argv: Sequence[str] | None = None) -> dict:
    """What was run, on which inputs (name: hash), from which commit (SNK9)."""
    try:
        head = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        head = None
    return {"schema_version": "drawscope.run/v1", "created_utc": datetime.now(UTC).isoformat(), "argv": list(argv if argv is not None else sys.argv), "stages": list(stages), "inputs": inputs, "git_head": head}


def realigned(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """(old stem, new stem, changed): shell files renamed by a table (old, new) (SNK13)."""
    joined = files.join(F.broadcast(mapping), files["stem"] == mapping["old"], "left")
    new = F.coalesce("new", "stem")
    return joined.select(F.col("stem"), new.alias("new_stem"), (new != F.col("stem")).alias("changed"))
