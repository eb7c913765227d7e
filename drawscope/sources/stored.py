"""Stored tables: ensembles, edges, shells, geometry as WKB, and JSON documents beside them."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flat, rings
from ..functions.keys import county_code
from ..operators.ensembles import require_complete, to_long
from ..operators.graph import normal_edges
from ..operators.units import ContractError

ENSEMBLE_SCHEMA = "drawscope.ensemble/v1"


def fingerprint(spark: SparkSession, path: str, pattern: str = "*") -> str:
    """sha256 of a file's bytes, or over the sorted ``name<tab>sha256`` lines of a folder's files, at any
    depth (SNK10, FN19). Only one line a file comes to the driver."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    rows = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("h")).orderBy("name", "h").collect()
    if len(rows) == 1 and path.rstrip("/").endswith(rows[0].name):
        return rows[0].h
    return hashlib.sha256("\n".join(f"{r.name}\t{r.h}" for r in rows).encode()).hexdigest()


def id_hash(units: DataFrame, key: str = "precinct_id") -> str:
    """A hash of a set of ids that needs no order and combines map-side."""
    halves = [F.sum(F.shiftrightunsigned(h, n).bitwiseAND(F.lit(0x7FFFFFFF))) for h in (F.xxhash64(key), F.xxhash64(F.lit(11), key)) for n in (0, 32)]
    return "-".join(f"{x or 0:x}" for x in units.select(key).distinct().agg(*halves).first())


def verify(spark: SparkSession, folder: str) -> list[str]:
    """What of a stored ensemble differs from its manifest: nothing, if it is as it was written."""
    meta = read_manifest(spark, folder) or {}
    long = ensemble(spark, folder)
    counted = long.agg(F.countDistinct("precinct_id").alias("n_units"), F.countDistinct("draw").alias("n_draws")).first()
    found = {"n_units": counted.n_units, "n_draws": counted.n_draws, "unit_ids_hash": id_hash(long), "sha256": fingerprint(spark, f"{folder}/assignments", "*.parquet")}
    return [k for k, v in found.items() if meta.get(k) != v]


def ensemble(spark: SparkSession, folder: str, check: bool = False) -> DataFrame:
    """A stored ensemble as long rows; its manifest, if any, says how it lies (SRC12, SRC13)."""
    meta = read_manifest(spark, folder)
    df = spark.read.parquet(f"{folder}/assignments")
    if meta:
        if meta.get("schema_version") != ENSEMBLE_SCHEMA:
            raise ContractError(f"unsupported ensemble schema {meta.get('schema_version')!r}")
        if meta.get("layout") == "wide":
            draws = meta.get("draw_ids") or []
            df = to_long(df)
            if draws:
                place = F.create_map(*(F.lit(x) for i, d in enumerate(draws, 1) for x in (i, int(d))))
                df = df.withColumn("draw", place[F.col("draw")])
    if check:
        require_complete(df, [c for c in ("county",) if c in df.columns])
    return df


def read_manifest(spark: SparkSession, folder: str) -> dict | None:
    """The manifest beside an ensemble, read through Spark (any store)."""
    try:
        return json.loads("\n".join(r.value for r in spark.read.text(f"{folder}/manifest", wholetext=True).collect()))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def sampler_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows (unit_index, draw, chain, district) of a sampler (SRC11); chain is 1 if there is none."""
    raw = spark.read.option("header", True).csv(path)
    gone = [c for c in ("unit_index", "draw", "district") if c not in raw.columns]
    if gone:
        raise ContractError(f"sampler file lacks {gone}")
    chain = F.col("chain").cast("int") if "chain" in raw.columns else F.lit(1)
    return raw.select(F.col("unit_index").cast("int").alias("unit_index"), F.col("draw").cast("int").alias("draw"), chain.alias("chain"), F.col("district").cast("int").alias("district"))


def edges(spark: SparkSession, path: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """Stored edges, normalised (SRC15)."""
    return normal_edges(spark.read.parquet(path), src, dst)


def county_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(county_code(F.col("maz")).alias("maz"), "n_oevk")


def reports(spark: SparkSession, run: str, name: str) -> DataFrame:
    """Reports of all counties, ``<run>/counties/<cc>/reports/<name>``, with their county (SRC16)."""
    rows = spark.read.option("multiLine", True).json(f"{run}/counties/*/reports/{name}")
    return rows.withColumn("maz", F.regexp_extract(F.col("_metadata.file_path"), r"/counties/([^/]+)/reports/", 1))


def metric_rows(partisan: DataFrame, names: list[str]) -> DataFrame:
    """Flat rows (maz, metric, focal_value, …) of nested county reports (PIV6)."""
    keep = ("focal_value", "ensemble_mean", "ensemble_p05", "ensemble_p95", "percentile_rank")
    have = [n for n in names if n in partisan.schema["metrics"].dataType.names]
    one = lambda n: F.struct(F.lit(n).alias("metric"), *(F.col(f"metrics.{n}.{k}").cast("double").alias(k) for k in keep))
    return partisan.select("maz", F.explode(F.array(*map(one, have))).alias("m")).select("maz", "m.*")


def json_document(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


# ---- geometry -------------------------------------------------------------------------------

_GEOJSON = "type string, features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def shells(spark: SparkSession, folder: str) -> DataFrame:
    """(county, shape) of a folder of GeoJSON files named by county; ``ksh``, where given, must agree (SRC10)."""
    raw = spark.read.schema(_GEOJSON).option("multiLine", True).json(f"{folder}/*.geojson")
    stem = county_code(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.geojson$", 1))
    rows = raw.select(stem.alias("county"), F.explode("features").alias("f")).select("county", county_code(F.try_element_at("f.properties", F.lit("ksh"))).alias("ksh"), "f.geometry")
    nested = F.from_json("geometry.coordinates", "array<array<array<array<double>>>>")
    simple = F.array(F.from_json("geometry.coordinates", "array<array<array<double>>>"))
    coordinates = F.when(F.col("geometry.type") == "MultiPolygon", nested).when(F.col("geometry.type") == "Polygon", simple)
    shape = F.transform(coordinates, lambda p: F.transform(p, lambda r: F.transform(r, lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))))
    checked = F.when(F.col("ksh").isNotNull() & (F.col("ksh") != F.col("county")), F.raise_error(F.lit("a shell's ksh isn't its file's county"))).otherwise(F.col("county")).cast("string")
    return rows.select(checked.alias("county"), shape.alias("shape"))


def with_wkb(units: DataFrame, shape: str = "shape", column: str = "geometry") -> DataFrame:
    """``shape`` as little-endian WKB multipolygons, batch by batch."""

    @F.arrow_udf("binary")
    def encoded(values: pa.Array) -> pa.Array:
        return flat.to_wkb(flat.of(values))

    return units.withColumn(column, encoded(F.col(shape))).drop(shape)


def from_wkb(rows: DataFrame, column: str = "geometry", shape: str = "shape") -> DataFrame:
    """WKB polygons and multipolygons, of either byte order, as nested arrays."""

    @F.arrow_udf(rings.SHAPE)
    def decoded(values: pa.Array) -> pa.Array:
        return flat.to_arrow(flat.from_wkb(values.cast(pa.binary())))

    return rows.withColumn(shape, decoded(F.col(column))).drop(column)
