"""Connected components by alternating star contraction.

Every round links each node's neighbours to the least label known there; the number of rounds
grows with the logarithm of the longest path, not with its length. Each round is written to
the shared folder, so a lost executor costs one round at most. No node's neighbours are ever
gathered in one task: a round is joins and a minimum by key, which combine map-side. The joins are by sorted
shuffles: their sides grow with the graph, and compressed sizes would have them sent through the driver.

Edges are counted once they are written. Up to ``one_task`` rows of them (a few tens of MB),
one task finds the same labels, since a round's jobs would cost more than its work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialise, release


#: Rows of edges, each in both directions, that one task takes.
ONE_TASK = 1 << 18


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (a, b): every root goes to the least root beside it, until none moves."""
    held = list(batches)
    if not sum(map(len, held)):
        return
    both = pa.Table.from_batches(held)
    names = pc.unique(both.column("a"))  # both directions are there
    names = names.take(pc.sort_indices(names))  # by bytes, as Spark orders strings
    a, b = (pc.index_in(both.column(c), names).to_numpy() for c in ("a", "b"))
    root = np.arange(len(names))
    while True:
        least = np.minimum(root[a], root[b])
        lower = root.copy()
        np.minimum.at(lower, root[a], least)
        while (lower[lower] != lower).any():
            lower = lower[lower]
        if (lower == root).all():
            break
        root = lower
    found = pa.table({"node": names, "component": names.take(pa.array(root))})
    yield from found.to_batches(max_chunksize=1 << 16)


def components(edges: DataFrame, src: str = "src", dst: str = "dst", nodes: DataFrame | None = None, max_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): ``component`` is the least node that can be reached.

    ``nodes`` (one column, any name) adds nodes without edges, each a component of its own.
    Edges are undirected; loops, repeats and edges with a null end have no effect.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a != b")
    both = materialise(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    kind = both.schema["a"].dataType
    if isinstance(kind, (T.StringType, T.LongType, T.IntegerType)) and kind == both.schema["b"].dataType and both.count() <= one_task:
        labels = materialise(both.coalesce(1).mapInArrow(_labelled, T.StructType([T.StructField("node", kind), T.StructField("component", kind)])), "labels")
    else:
        labels = _by_rounds(both, max_rounds)
    release(both)
    if nodes is None:
        return labels
    alone = nodes.select(F.col(nodes.columns[0]).alias("node")).where("node is not null").distinct().join(labels.select("node").hint("merge"), "node", "left_anti")
    return labels.unionByName(alone.select("node", F.col("node").alias("component")))


def _by_rounds(both: DataFrame, max_rounds: int) -> DataFrame:
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    for _ in range(max_rounds):
        # Hook: what a neighbour knows; applied to the node and to the node's present root.
        seen = both.join(labels.hint("merge"), both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m")).select(F.col("a").alias("node"), "m")
        better = labels.join(seen.hint("merge"), "node").where("m < component")
        hooked = better.select("node", F.col("m").alias("new")).unionByName(better.select(F.col("component").alias("node"), F.col("m").alias("new"))).groupBy("node").agg(F.min("new").alias("new"))
        lower = labels.join(hooked.hint("merge"), "node", "left").select("node", F.least("component", F.coalesce("new", "component")).alias("component"), (F.coalesce("new", "component") < F.col("component")).alias("moved"))
        # Jump: take the label of one's label, twice.
        for k in (1, 2):
            up = lower.select(F.col("node").alias(f"n{k}"), F.col("component").alias(f"c{k}"))
            lower = lower.join(up.hint("merge"), lower["component"] == up[f"n{k}"], "left").select("node", F.coalesce(f"c{k}", "component").alias("component"), "moved")
            if k == 1:
                lower = materialise(lower, "labels-half")
                half = lower
        following = materialise(lower, "labels")
        moved = following.where("moved").limit(1).count()
        release(labels, half)
        labels = following.drop("moved")
        labels.scratch_path = following.scratch_path
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
