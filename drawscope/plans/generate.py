"""A seeded plan generator by region growing.

Not a substitute for a sampler with known target distribution: plans are grown from random
seeds over the contiguity graph, smallest district first, so they are contiguous wherever the
graph is, and roughly balanced. Use it to exercise everything downstream of an ensemble.
"""

from __future__ import annotations

import heapq
import random
from bisect import bisect_left, insort
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import both_ways

_ROWS = "county string, draw int, chain int, precinct_id string, district int"


def grown(ids: list[str], population: dict[str, float], neighbours: dict[str, list[str]], n: int, seed: str) -> dict[str, int]:
    """Districts 1..n of the units: every step the least populous district takes a neighbour.

    A district's free neighbours are kept sorted and lose what any district takes, so a step costs what lies around one unit,
    not all that the district has ever touched."""
    rng = random.Random(seed)
    starts = rng.sample(sorted(ids), min(n, len(ids)))
    out: dict[str, int] = {}
    heap: list[tuple[float, int]] = []
    free: dict[int, list[str]] = {d: [] for d in range(1, len(starts) + 1)}
    beside: dict[str, set[int]] = defaultdict(set)  # whose free neighbour a unit is

    def reach(d: int, u: str) -> None:
        for v in neighbours[u]:
            if v not in out and d not in beside[v]:
                beside[v].add(d)
                insort(free[d], v)

    for d, s in enumerate(starts, 1):
        out[s] = d
        heap.append((population.get(s, 0.0), d))
    for d, s in enumerate(starts, 1):
        reach(d, s)
    heapq.heapify(heap)
    while heap:
        p, d = heapq.heappop(heap)
        if not free[d]:
            continue
        u = rng.choice(free[d])
        out[u] = d
        for other in beside.pop(u):
            del free[other][bisect_left(free[other], u)]
        reach(d, u)
        heapq.heappush(heap, (p + population.get(u, 0.0), d))
    for u in sorted(ids):  # pieces of the graph that hold no start
        out.setdefault(u, 1)
    return out


def generate(units: DataFrame, edges: DataFrame, districts: DataFrame, draws: int, seed: int = 0, per_chain: int | None = None) -> DataFrame:
    """(county, draw, chain, precinct_id, district). units: (county, precinct_id, population);
    edges within counties; districts: (county, ndists). A task grows one plan of one county."""
    around = both_ways(edges).groupBy(F.col("node").alias("precinct_id")).agg(F.sort_array(F.collect_set("other")).alias("around"))
    rows = units.select("county", "precinct_id", F.col("population").cast("double").alias("population")).join(around, "precinct_id", "left").join(F.broadcast(districts), "county")
    dealt = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))

    def plan(t: pa.Table) -> pa.Table:
        county, draw, n = (t.column(c)[0].as_py() for c in ("county", "draw", "ndists"))
        ids = t.column("precinct_id").to_pylist()
        near = defaultdict(list, {u: a or [] for u, a in zip(ids, t.column("around").to_pylist(), strict=True)})
        made = grown(ids, dict(zip(ids, t.column("population").to_pylist(), strict=True)), near, n, f"{seed}/{county}/{draw}")
        chain = 1 if not per_chain else (draw - 1) // per_chain + 1
        return pa.table({"county": pa.array([county] * len(ids)), "draw": pa.array([draw] * len(ids), pa.int32()), "chain": pa.array([chain] * len(ids), pa.int32()), "precinct_id": pa.array(ids), "district": pa.array([made[u] for u in ids], pa.int32())})

    return dealt.groupBy("county", "draw").applyInArrow(plan, _ROWS)
