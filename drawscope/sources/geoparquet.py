"""GeoParquet 1.1 layers: WKB geometry with its reference system, kinds and bounds in each file's footer.

Spark's own Parquet writer keeps no footer entry of others, so this is a data source: ``write`` makes a file a task, beside
the layer, and moves all of them into it when every task is done; a task that fails or is tried again leaves nothing. ``read``
lists the files' footers, checks them, passes over files whose bounds miss a box, and gives shapes in nested
arrays. Paths are of any store that pyarrow knows, and of the executors' shared folder.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from ..functions import flat

FORMAT = "drawscope_geoparquet"
GEOMETRY, SHAPE = "geometry", "shape"
VERSION = "1.1.0"

_POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
_SHAPE = T.ArrayType(T.ArrayType(T.ArrayType(_POINT)))

#: Zone and hemisphere of the metric system that layers are repaired in.
UTM_33N = "EPSG:32633"
LONLAT = "OGC:CRS84"

_ELLIPSOID = {"name": "WGS 84", "semi_major_axis": 6378137, "inverse_flattening": 298.257223563}
_GEOGRAPHIC = {"type": "GeographicCRS", "name": "WGS 84", "datum": {"type": "GeodeticReferenceFrame", "name": "World Geodetic System 1984", "ellipsoid": _ELLIPSOID}}


def _axes(kind: str, unit: str, names: list[tuple[str, str, str]]) -> dict:
    return {"subtype": kind, "axis": [{"name": n, "abbreviation": a, "direction": d, "unit": unit} for n, a, d in names]}


def projjson(name: str) -> dict | None:
    """The reference system as PROJJSON: longitude and latitude (which is what a layer without one has), or a UTM zone of WGS 84."""
    authority, _, code = name.partition(":")
    if name in (LONLAT, "EPSG:4326"):
        axes = _axes("ellipsoidal", "degree", [("Geodetic longitude", "Lon", "east"), ("Geodetic latitude", "Lat", "north")])
        return _GEOGRAPHIC | {"coordinate_system": axes, "id": {"authority": "OGC", "code": "CRS84"}}
    if authority == "EPSG" and code.isdigit() and (32601 <= int(code) <= 32660 or 32701 <= int(code) <= 32760):
        zone, south = int(code) % 100, int(code) > 32700
        given = {"Latitude of natural origin": (0, "degree", 8801), "Longitude of natural origin": (zone * 6 - 183, "degree", 8802), "Scale factor at natural origin": (0.9996, "unity", 8805), "False easting": (500000, "metre", 8806), "False northing": (10_000_000 if south else 0, "metre", 8807)}
        return {
            "type": "ProjectedCRS",
            "name": f"WGS 84 / UTM zone {zone}{'S' if south else 'N'}",
            "base_crs": _GEOGRAPHIC | {"coordinate_system": _axes("ellipsoidal", "degree", [("Geodetic latitude", "Lat", "north"), ("Geodetic longitude", "Lon", "east")])},
            "conversion": {
                "name": f"UTM zone {zone}{'S' if south else 'N'}",
                "method": {"name": "Transverse Mercator", "id": {"authority": "EPSG", "code": 9807}},
                "parameters": [{"name": k, "value": v, "unit": u, "id": {"authority": "EPSG", "code": c}} for k, (v, u, c) in given.items()],
            },
            "coordinate_system": _axes("Cartesian", "metre", [("Easting", "E", "east"), ("Northing", "N", "north")]),
            "id": {"authority": "EPSG", "code": int(code)},
        }
    raise ValueError(f"unknown reference system {name!r}")


def crs_name(meta: dict) -> str | None:
    """``authority:code`` of a layer's footer; one without a system is in longitude and latitude, one with null in none."""
    column = meta["columns"][meta["primary_column"]]
    if "crs" not in column:
        return LONLAT
    known = (column["crs"] or {}).get("id")
    return f"{known['authority']}:{known['code']}" if known else None


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return pyarrow.fs.FileSystem.from_uri(path) if ":/" in path else (pyarrow.fs.LocalFileSystem(), path)


def _footer(files: pyarrow.fs.FileSystem, path: str) -> tuple[dict, pa.Schema]:
    footer = pq.read_metadata(path, filesystem=files)
    raw = (footer.metadata or {}).get(b"geo")
    if raw is None:
        raise ValueError(f"{path} has no geo entry in its footer")
    meta = json.loads(raw)
    column = meta["columns"][meta["primary_column"]]
    if column["encoding"] != "WKB":
        raise ValueError(f"{path} holds {column['encoding']}, not WKB")
    return meta, footer.schema.to_arrow_schema()


@dataclass
class Written(WriterCommitMessage):
    file: str | None


@dataclass
class Part(InputPartition):
    file: str


class Writer(DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, path: str, crs: str, overwrite: bool):
        self.schema, self.path, self.crs, self.overwrite = to_arrow_schema(schema), path.rstrip("/"), projjson(crs), overwrite
        self.run = uuid.uuid4().hex
        # Hidden from readers, and in the layer's own folder, so moving is a rename.
        self.staging = f"{self.path}/_staging-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, staging = _store(self.staging)
        files.create_dir(staging, recursive=True)
        name = f"part-{uuid.uuid4().hex}.zstd.parquet"
        at = self.schema.get_field_index(SHAPE)
        kept = [f for f in self.schema if f.name != SHAPE]
        schema = pa.schema([*kept, pa.field(GEOMETRY, pa.binary())])
        box, rows, writer = None, 0, None
        try:
            for batch in iterator:
                arrays = flat.of(batch.column(at))
                here = flat.bounds(arrays)
                if here is not None:
                    box = here if box is None else [*map(min, box[:2], here[:2]), *map(max, box[2:], here[2:])]
                writer = writer or pq.ParquetWriter(f"{staging}/{name}", schema, filesystem=files, compression="zstd")
                writer.write_batch(pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)).cast(f.type) for f in kept), flat.to_wkb(arrays)], schema=schema))
                rows += batch.num_rows
            if writer:
                column = {"encoding": "WKB", "geometry_types": ["MultiPolygon"], "crs": self.crs} | ({"bbox": [float(v) for v in box]} if box is not None else {})
                writer.add_key_value_metadata({"geo": json.dumps({"version": VERSION, "primary_column": GEOMETRY, "columns": {GEOMETRY: column}})})
        finally:
            if writer:
                writer.close()
        return Written(name if rows else None)

    def commit(self, messages: list[Written | None]) -> None:
        files, path = _store(self.path)
        files.create_dir(path, recursive=True)
        old = [f.path for f in files.get_file_info(pyarrow.fs.FileSelector(path)) if f.base_name.startswith("part-")] if self.overwrite else []
        for m in messages:
            if m and m.file:
                files.move(f"{path}/_staging-{self.run}/{m.file}", f"{path}/{m.file}")
        for f in old:
            files.delete_file(f)
        self._clear(files, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_store(self.path))

    def _clear(self, files: pyarrow.fs.FileSystem, path: str) -> None:
        if files.get_file_info(f"{path}/_staging-{self.run}").type == pyarrow.fs.FileType.Directory:
            files.delete_dir(f"{path}/_staging-{self.run}")


class Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, path: str, box: list[float] | None):
        self.schema, self.path, self.box = to_arrow_schema(schema), path.rstrip("/"), box

    def partitions(self) -> list[Part]:
        files, path = _store(self.path)
        found, systems = [], set()
        for f in sorted(_parts(files, path)):
            meta, _ = _footer(files, f)
            systems.add(crs_name(meta))
            bounds = meta["columns"][meta["primary_column"]].get("bbox")
            if self.box and bounds:
                half = len(bounds) // 2
                if bounds[0] > self.box[2] or bounds[1] > self.box[3] or bounds[half] < self.box[0] or bounds[half + 1] < self.box[1]:
                    continue
            found.append(Part(f))
        if len(systems) > 1:
            raise ValueError(f"{self.path} mixes reference systems: {sorted(map(str, systems))}")
        return found

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        files, _ = _store(self.path)
        primary = _footer(files, partition.file)[0]["primary_column"]
        with files.open_input_file(partition.file) as source:
            for batch in pq.ParquetFile(source).iter_batches(4096):
                shape = flat.to_arrow(flat.from_wkb(batch.column(batch.schema.get_field_index(primary)).cast(pa.binary())))
                columns = [shape if f.name == SHAPE else batch.column(batch.schema.get_field_index(f.name)).cast(f.type) for f in self.schema]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, self.schema, strict=True)], names=self.schema.names)


def _parts(files: pyarrow.fs.FileSystem, path: str) -> list[str]:
    info = files.get_file_info(path)
    if info.type == pyarrow.fs.FileType.File:
        return [path]
    return [f.path for f in files.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True)) if f.type == pyarrow.fs.FileType.File and f.base_name.endswith(".parquet") and f.base_name[0] not in "_."]


class GeoParquet(DataSource):
    """Options: path; crs (writing); box, ``minx,miny,maxx,maxy``: files that miss it are not opened (reading)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        files, path = _store(self.options["path"].rstrip("/"))
        found = sorted(_parts(files, path))
        if not found:
            raise ValueError(f"no layer at {self.options['path']}")
        meta, schema = _footer(files, found[0])
        kept = from_arrow_schema(pa.schema([f for f in schema if f.name != meta["primary_column"]]))
        return T.StructType([*kept, T.StructField(SHAPE, _SHAPE)])

    def reader(self, schema: T.StructType) -> Reader:
        box = self.options.get("box")
        return Reader(schema, self.options["path"], [float(v) for v in box.split(",")] if box else None)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(schema, self.options["path"], self.options.get("crs", LONLAT), overwrite)


def write(units: DataFrame, path: str, crs: str = LONLAT, mode: str = "overwrite") -> None:
    """``units`` with their column ``shape`` as a layer (SNK2). mode: overwrite or append."""
    units.sparkSession.dataSource.register(GeoParquet)
    units.write.format(FORMAT).option("path", path).option("crs", crs).mode(mode).save()


def read(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A layer with its geometry as ``shape`` (SRC9). box: only rows of files that meet it come, so filter what is read by bounds too."""
    spark.dataSource.register(GeoParquet)
    reader = spark.read.format(FORMAT).option("path", path)
    return (reader.option("box", ",".join(map(repr, box))) if box else reader).load()


def described(path: str) -> dict:
    """Reference system, kinds, bounds and number of files of a layer, from its footers."""
    files, at = _store(path.rstrip("/"))
    metas = [_footer(files, f)[0] for f in _parts(files, at)]
    boxes = [b for m in metas if (b := m["columns"][m["primary_column"]].get("bbox"))]
    return {
        "crs": crs_name(metas[0]) if metas else None,
        "kinds": sorted({k for m in metas for k in m["columns"][m["primary_column"]]["geometry_types"]}),
        "bounds": [*(min(b[i] for b in boxes) for i in (0, 1)), *(max(b[i] for b in boxes) for i in (2, 3))] if boxes else None,
        "files": len(metas),
    }
