"""Settlement documents: one JSON file each, ``<root>/<county>/<county>-<settlement>.json``."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rings
from ..functions.keys import unit_id
from ..operators.shapes import repair
from ..operators.units import ContractError, first_by_key, ordered_columns, wide_votes

SCHEMA = """header struct<generated:string,vl_id:bigint,nvv_id:bigint>,
list array<struct<maz:string,taz:string,szk:string,centrum:string,poligon:string,name:string,oevk_id:string,oevk_id_full:string,voters:string,allowsReg:boolean,listVotes:map<string,bigint>>>"""


def documents(spark: SparkSession, root: str) -> DataFrame:
    """Every settlement file with its path (SRC1, SRC2). Files are read where Spark can reach them."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(f"{root.rstrip('/')}/*/*.json").withColumn("file", F.col("_metadata.file_path"))


def records(docs: DataFrame) -> DataFrame:
    """One row a unit record, with its place in the whole tree (file, pos)."""
    rows = docs.select("file", "header", F.posexplode("list").alias("pos", "r"))
    trimmed = {c: F.trim(F.col(f"r.{c}")) for c in ("maz", "taz", "szk")}
    empty = lambda c: F.nullif(F.trim(F.col(f"r.{c}")), F.lit(""))
    return rows.select(
        "file",
        "pos",
        *(c.alias(n) for n, c in trimmed.items()),
        unit_id(*trimmed.values()).alias("precinct_id"),
        F.col("r.name").alias("name"),
        F.col("r.centrum").alias("centrum"),
        F.col("r.poligon").alias("poligon"),
        empty("oevk_id").alias("oevk_id"),
        empty("oevk_id_full").alias("oevk_id_full"),
        F.nullif(F.trim("r.voters"), F.lit("")).cast("bigint").alias("voters"),
        F.col("r.listVotes").alias("list_votes"),
        F.col("header.generated").alias("header_generated"),
        F.col("header.vl_id").alias("header_vl_id"),
        F.col("header.nvv_id").alias("header_nvv_id"),
    )


def record_total(docs: DataFrame) -> DataFrame:
    """One row: records in all files (SRC6)."""
    return docs.agg(F.coalesce(F.sum(F.size("list")), F.lit(0)).cast("bigint").alias("n_records"))


def unit_layer(recs: DataFrame) -> DataFrame:
    """(codes, precinct_id, centrum, shape): parsed and repaired polygons, unrepairable ones gone,
    the first of repeated ids kept (SRC3, SRC4)."""
    ring = rings.ring_of(F.col("poligon"))
    parsed = recs.select("file", "pos", "maz", "taz", "szk", "precinct_id", rings.point_of(F.col("centrum")).alias("centrum"), F.when(ring.isNotNull(), rings.shape_of(ring)).alias("shape"))
    sound = repair(parsed.where("shape is not null")).where("not is_empty").drop("was_valid", "area_before", "area_after", "is_empty")
    return first_by_key(sound, "precinct_id", "file", "pos").drop("file", "pos").withColumn("unit_kind", F.lit("szvk"))


@dataclass(frozen=True)
class ListMap:
    """Vote column of each list, and its label."""

    columns: dict[str, str]
    labels: dict[str, str]
    election_year: int | None = None

    @staticmethod
    def parse(raw: dict) -> ListMap:
        """``{"lists": {id: "column" | {"column": …, "label_hu": …}}}`` (SRC7)."""
        lists = raw.get("lists")
        if not isinstance(lists, dict) or not lists:
            raise ContractError("list map holds no lists")
        columns, labels = {}, {}
        for key, spec in lists.items():
            column = spec if isinstance(spec, str) else (spec or {}).get("column")
            if not isinstance(column, str) or not column.strip():
                raise ContractError(f"list {key!r} has no column")
            columns[str(key)] = column.strip()
            if isinstance(spec, dict) and spec.get("label_hu"):
                labels[str(key)] = spec["label_hu"]
        year = raw.get("election_year")
        return ListMap(columns, labels, int(year) if year not in (None, "") else None)

    @staticmethod
    def load(path: str) -> ListMap:
        return ListMap.parse(json.loads(Path(path).read_text(encoding="utf-8")))


def list_votes(recs: DataFrame) -> DataFrame:
    """(precinct_id, list_id, votes) of the first record of every id."""
    return first_by_key(recs, "precinct_id", "file", "pos").select("precinct_id", F.explode("list_votes").alias("list_id", "votes"))


def electoral_tables(recs: DataFrame, lists: ListMap, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(votes, focal): wide votes of every unit and the enacted plan (SRC5). ``strict``: a list
    without a column is an error; otherwise it is left out (count it with unknown_lists)."""
    first = first_by_key(recs, "precinct_id", "file", "pos")
    votes = first.select("precinct_id", F.explode("list_votes").alias("list_id", "votes"))
    known = list(lists.columns)
    if strict:
        unknown = [r.list_id for r in votes.where(~F.col("list_id").isin(known)).select("list_id").distinct().orderBy("list_id").limit(20).collect()]
        if unknown:
            raise ContractError(f"lists without a column: {unknown}")
    wide = wide_votes(votes, lists.columns)
    head = first.select("precinct_id", "maz", "taz", "szk", "name", "oevk_id", "oevk_id_full", "voters", "header_generated", "header_vl_id", "header_nvv_id")
    focal = first.where("oevk_id_full is not null").select("precinct_id", "oevk_id_full", "oevk_id", "maz")
    return ordered_columns(head.join(wide, "precinct_id", "left")), focal


def repeated(recs: DataFrame) -> DataFrame:
    """One row: records dropped as repeats of an id (DED1)."""
    n = recs.withColumn("n", F.row_number().over(Window.partitionBy("precinct_id").orderBy("file", "pos")))
    return n.agg(F.count_if(F.col("n") > 1).alias("n_duplicates"))
