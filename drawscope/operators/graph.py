"""Contiguity graphs: edges (src < dst) keyed by unit ids."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tiles
from .components import components


def normal_edges(edges: DataFrame, src: str = "src", dst: str = "dst", keep: Sequence[str] = ()) -> DataFrame:
    """Undirected edges as src < dst, without loops and repeats (GR6, SRC15)."""
    return edges.where(F.col(src) != F.col(dst)).select(*keep, F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst")).distinct()


def _corners(units: DataFrame, scope: Sequence[str], unit: str, shape: str, snap: float) -> DataFrame:
    snapped = lambda p: F.struct(F.round(p["x"] / snap).cast("bigint").alias("x"), F.round(p["y"] / snap).cast("bigint").alias("y"))
    rings = units.select(*scope, F.col(unit).alias("u"), F.explode(F.flatten(F.col(shape))).alias("ring"))
    return rings.select(*scope, "u", F.transform("ring", snapped).alias("ring"))


def _sharing(places: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Pairs of units at one place: each unit of a place with those after it, a row a unit, so a
    place where many meet needs memory in proportion to its units and not to its pairs."""
    met = places.groupBy(*scope, "place").agg(F.sort_array(F.collect_set("u")).alias("us")).where("size(us) > 1")
    each = met.select(*scope, "us", F.posexplode("us").alias("i", "src"))
    return each.select(*scope, "src", F.explode(F.slice("us", F.col("i") + 2, F.size("us"))).alias("dst")).distinct()


def contiguity(units: DataFrame, rule: str = "queen", scope: Sequence[str] = (), unit: str = "precinct_id", shape: str = "shape", snap: float = 1e-6) -> DataFrame:
    """Units that share a corner (queen, GR1) or a whole segment (rook, GR2), by equi-join on
    coordinates snapped to a grid of ``snap``."""
    corners = _corners(units, scope, unit, shape, snap)
    if rule == "queen":
        places = corners.select(*scope, "u", F.explode("ring").alias("place")).distinct()
    elif rule == "rook":
        sides = F.transform(F.sequence(F.lit(1), F.size("ring") - 1), lambda i: F.sort_array(F.array(F.element_at("ring", i), F.element_at("ring", i + 1))))
        places = corners.where("size(ring) > 1").select(*scope, "u", F.explode(sides).alias("place")).distinct()
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return _sharing(places, scope)


def both_ways(edges: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return edges.select(*keep, F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(edges.select(*keep, F.col("dst").alias("node"), F.col("src").alias("other")))


def degrees(nodes: DataFrame, edges: DataFrame, unit: str = "precinct_id") -> DataFrame:
    """Neighbours of every node, 0 for islands (GR5)."""
    per = both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"))
    return nodes.select(F.col(unit).alias("node")).join(per.hint("merge"), "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def neighbour_lists(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("node").agg(F.sort_array(F.collect_set("other")).alias("neighbours"))


def summary(nodes: DataFrame, edges: DataFrame, unit: str = "precinct_id") -> DataFrame:
    """One row: nodes, edges, components, size of the largest, islands (GR4, GR5)."""
    d = degrees(nodes, edges, unit)
    parts = components(edges, nodes=nodes.select(unit)).groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_components"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_component"))
    return d.agg(F.count("*").alias("n_nodes"), F.coalesce(F.sum("degree") / 2, F.lit(0)).cast("bigint").alias("n_edges"), F.count_if(F.col("degree") == 0).alias("n_islands")).crossJoin(parts)


def health(nodes: DataFrame, edges: DataFrame, scope: str = "county", unit: str = "precinct_id", listed: int = 50) -> DataFrame:
    """Per scope: components, islands (the first ``listed`` by id), and whether it is one piece (GR8).
    ``edges`` within scopes; nodes: (scope, unit)."""
    parts = components(edges, nodes=nodes.select(unit))
    placed = nodes.select(scope, F.col(unit).alias("node")).join(parts.hint("merge"), "node").join(degrees(nodes, edges, unit).hint("merge"), "node")
    per = placed.groupBy(scope, "component").agg(F.count("*").alias("n")).groupBy(scope).agg(F.count("*").alias("n_components"), F.max("n").alias("largest_component"), F.sum("n").alias("n_nodes"))
    rank = Window.partitionBy(scope).orderBy("node")
    islands = placed.where("degree = 0").withColumn("r", F.row_number().over(rank)).groupBy(scope).agg(F.count("*").alias("n_islands"), F.array_sort(F.collect_list(F.when(F.col("r") <= listed, F.col("node")))).alias("islands"))
    out = per.join(islands, scope, "left").withColumns({"n_islands": F.coalesce("n_islands", F.lit(0)), "islands": F.coalesce("islands", F.array().cast("array<string>"))})
    return out.withColumn("ok", (F.col("n_components") == 1) & (F.col("n_islands") == 0))


def cross_pairs(edges: DataFrame, nodes: DataFrame, county: str = "county", unit: str = "precinct_id") -> DataFrame:
    """Counties that touch, from the edges between their units (JN7)."""
    a = nodes.select(F.col(unit).alias("src"), F.col(county).alias("ca"))
    b = nodes.select(F.col(unit).alias("dst"), F.col(county).alias("cb"))
    met = edges.join(a, "src").join(b, "dst").where("ca != cb")
    return met.select(F.least("ca", "cb").alias("county_a"), F.greatest("ca", "cb").alias("county_b")).distinct()


def national(edges: DataFrame, nodes: DataFrame, county: str = "county", unit: str = "precinct_id", touching: DataFrame | None = None) -> DataFrame:
    """Edges with ``intra``; those between counties only where the counties touch (GR7)."""
    a = nodes.select(F.col(unit).alias("src"), F.col(county).alias("ca"))
    b = nodes.select(F.col(unit).alias("dst"), F.col(county).alias("cb"))
    tagged = edges.join(a, "src").join(b, "dst").select("src", "dst", F.least("ca", "cb").alias("county_a"), F.greatest("ca", "cb").alias("county_b"), (F.col("ca") == F.col("cb")).alias("intra"))
    if touching is not None:
        tagged = tagged.where("intra").unionByName(tagged.where("not intra").join(touching, ["county_a", "county_b"], "left_semi").select(tagged.columns))
    return tagged


def patch(edges: DataFrame, add: DataFrame, remove: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with ``add`` put in and then ``remove`` taken out, one row of how many of each had an effect) (SET3)."""
    add, remove = normal_edges(add), normal_edges(remove)
    merged = edges.select("src", "dst").unionByName(add).distinct()
    out = merged.join(remove, ["src", "dst"], "left_anti")
    added = add.join(edges, ["src", "dst"], "left_anti").agg(F.count("*").alias("n_add_applied"))
    removed = remove.join(merged, ["src", "dst"], "left_semi").agg(F.count("*").alias("n_remove_applied"))
    return out, added.crossJoin(removed)


def bridges(nodes: DataFrame, edges: DataFrame, scope: str = "county", unit: str = "precinct_id", x: str = "cx", y: str = "cy") -> DataFrame:
    """An edge for each minor component: from its least node to the nearest node of the scope's
    largest component (ties: least component, least node) (GR9).

    Only tiles that may hold the nearest node are looked into (``tiles.nearest``), so the work is a few rows a minor component.
    """
    parts = components(edges, nodes=nodes.select(unit))
    placed = nodes.select(scope, F.col(unit).alias("node"), F.col(x).alias("x"), F.col(y).alias("y")).join(parts.hint("merge"), "node")
    sizes = placed.groupBy(scope, "component").agg(F.count("*").alias("n"), F.min(F.struct("node", "x", "y")).alias("first"))
    main = sizes.groupBy(scope).agg(F.max("n").alias("top"))
    largest = sizes.join(main, scope).where("n = top").groupBy(scope).agg(F.min("component").alias("main"))
    minor = sizes.join(largest, scope).where("component != main").select(scope, F.col("first.node").alias("u"), F.col("first.x").alias("ux"), F.col("first.y").alias("uy"))
    body = placed.join(largest, scope).where("component = main").select(scope, "node", "x", "y")
    return tiles.nearest(minor, body, [scope]).select(scope, F.least("u", "node").alias("src"), F.greatest("u", "node").alias("dst"), "d2")


def district_components(assigned: DataFrame, edges: DataFrame, scope: Sequence[str] = ("county",)) -> DataFrame:
    """Per (scope, draw, district): connected pieces of its units (GR10).

    Every unit carries its neighbours (a few), and the units of one plan of one scope, some
    thousands, meet in a task that joins neighbours of one district. The ensemble is shuffled once.
    """
    keys = [*scope, "draw"]
    sides = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = sides.groupBy(F.col("src").alias("precinct_id")).agg(F.collect_set("dst").alias("near"))
    rows = assigned.select(*keys, "precinct_id", "district").join(near, "precinct_id", "left")
    kinds = {f.name: f.dataType.simpleString() for f in assigned.schema.fields}

    def pieces(plan: pa.Table) -> pa.Table:
        names, district = plan.column("precinct_id").to_pylist(), plan.column("district").to_pylist()
        at = {u: i for i, u in enumerate(names)}
        root = list(range(len(names)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, others in enumerate(plan.column("near").to_pylist()):
            for j in (at[u] for u in others or () if u in at):
                if district[i] == district[j]:
                    root[find(i)] = find(j)
        n_units, n_pieces = Counter(district), Counter(d for i, d in enumerate(district) if find(i) == i)
        found = sorted(n_units, key=lambda d: (d is None, d or 0))
        one = {k: pa.array([plan.column(k)[0].as_py()] * len(found), plan.schema.field(k).type) for k in keys}
        return pa.table({**one, "district": pa.array(found, plan.schema.field("district").type), "n_pieces": pa.array([n_pieces[d] for d in found], pa.int64()), "n_units": pa.array([n_units[d] for d in found], pa.int64())})

    return rows.groupBy(*keys).applyInArrow(pieces, ", ".join(f"{k} {kinds[k]}" for k in [*keys, "district"]) + ", n_pieces bigint, n_units bigint")


def edge_lines(edges: DataFrame, centres: DataFrame, most: int | None = None, unit: str = "precinct_id") -> DataFrame:
    """Edges with the centres of both ends, the first ``most`` by id (MAP2)."""
    a = centres.select(F.col(unit).alias("src"), F.col("cx").alias("x1"), F.col("cy").alias("y1"))
    b = centres.select(F.col(unit).alias("dst"), F.col("cx").alias("x2"), F.col("cy").alias("y2"))
    out = edges.join(a, "src").join(b, "dst").select("src", "dst", "x1", "y1", "x2", "y2")
    return out.orderBy("src", "dst").limit(most) if most is not None else out
