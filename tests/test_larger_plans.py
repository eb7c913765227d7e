"""Plans and generators that must not grow with one task or with the driver."""

import heapq
import random
import time

import pytest

from drawscope.operators import components
from drawscope.plans import electorate, generate, registry

FOLDER = "/root/testdata/sf0.001"


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_indexes_of_units_are_not_broadcast(spark):
    assert "BroadcastHashJoin" not in planned(registry.QUERIES["csv_contract"](spark, FOLDER))
    assert "BroadcastHashJoin" not in planned(registry.QUERIES["csv_ensemble"](spark, FOLDER))


@pytest.mark.parametrize("draws", [20, 41])
def test_an_ensemble_is_dealt_to_tasks_before_it_is_spread(spark, monkeypatch, draws):
    whole = sorted(electorate.ensemble(spark, FOLDER, draws).collect())
    monkeypatch.setattr(electorate, "ROWS_A_TASK", 500)
    dealt = electorate.ensemble(spark, FOLDER, draws)
    n = electorate.units(spark, FOLDER).count() * draws
    assert dealt.rdd.getNumPartitions() == -(-n // 500)
    assert sorted(dealt.collect()) == whole


def plainly_grown(ids, population, neighbours, n, seed):
    rng = random.Random(seed)
    starts = rng.sample(sorted(ids), min(n, len(ids)))
    out = {s: d for d, s in enumerate(starts, 1)}
    frontier = {d: set(neighbours[s]) for d, s in enumerate(starts, 1)}
    heap = [(population.get(s, 0.0), d) for d, s in enumerate(starts, 1)]
    heapq.heapify(heap)
    while heap:
        p, d = heapq.heappop(heap)
        free = sorted(u for u in frontier[d] if u not in out)
        if not free:
            continue
        u = rng.choice(free)
        out[u] = d
        frontier[d] |= set(neighbours[u])
        heapq.heappush(heap, (p + population.get(u, 0.0), d))
    for u in sorted(ids):
        out.setdefault(u, 1)
    return out


def grid(wide, high):
    at = {(x, y): f"u{y:05}-{x}" for x in range(wide) for y in range(high)}
    near = {u: [at[q] for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)) if q in at] for (x, y), u in at.items()}
    return list(near), {u: float(len(u) + i % 7) for i, u in enumerate(near)}, near


@pytest.mark.parametrize("seed", ["1", "2", "3"])
def test_plans_are_those_of_plain_growth(seed):
    ids, people, near = grid(8, 25)
    near[ids[0]].append(ids[0])  # a loop has no effect
    assert generate.grown(ids, people, near, 4, seed) == plainly_grown(ids, people, near, 4, seed)


def test_growth_takes_time_in_proportion():
    ids, people, near = grid(8, 4000)
    begun = time.perf_counter()
    assert len(generate.grown(ids, people, near, 4, "x")) == len(ids)
    assert time.perf_counter() - begun < 10


def test_components_join_by_shuffle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "src string, dst string")
    found = components.components(edges, nodes=spark.createDataFrame([("a",), ("z",)], "u string"))
    assert "BroadcastHashJoin" not in planned(found)
    assert {r.node: r.component for r in found.collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}
