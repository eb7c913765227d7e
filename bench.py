"""Headline queries, warm: one JSON line with the median of five runs each, and the least and greatest of them.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 4) the cores, BENCH_ONLY (a comma-separated
list) the queries. Ensemble queries run over 20, 200 and 1000 draws, which are written first and scanned by every run. What
lies within the spread of another commit's runs of one sitting is no difference.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

from drawscope.operators import graph, quality  # noqa: E402
from drawscope.operators import units as ops  # noqa: E402
from drawscope.operators.components import components  # noqa: E402
from drawscope.plans import diagnostics, electorate, metrics, registry  # noqa: E402
from drawscope.scratch import new_path  # noqa: E402
from drawscope.session import build_session  # noqa: E402

RUNS = 5


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = build_session(f"local[{cpus}]", app="bench", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    written: dict[int, str] = {}

    def ensemble(draws: int):
        if draws not in written:
            written[draws] = new_path(spark, f"bench-{draws}")
            electorate.ensemble(spark, folder, draws).write.option("compression", "zstd").parquet(written[draws])
        return spark.read.parquet(written[draws])

    def assigned(draws: int):
        people = ops.population_of(electorate.units(spark, folder).select("precinct_id"), electorate.voters(spark, folder))
        return ops.on_units(ensemble(draws), people)

    def deviation(draws: int):
        return diagnostics.population_deviation(assigned(draws), electorate.districts(spark, folder), ["county", "draw"], ["county"])

    def rhat(draws: int):
        chains = ensemble(draws).select("county", "draw", "chain").distinct()
        return diagnostics.r_hat(deviation(draws).join(chains, ["county", "draw"]).withColumnRenamed("deviation", "value"), ["county"])

    def compared(draws: int):
        return metrics.compare(electorate.units(spark, folder).select("county", "precinct_id"), electorate.list_votes(spark, folder), electorate.coding(spark), electorate.focal(spark, folder), ensemble(draws), ["county"], registry.SKIP, strict=False)

    grid = electorate.grid(spark, folder)
    jobs = {
        **{f"focal_vs_ensemble_{n}": lambda n=n: compared(n) for n in (20, 200, 1000)},
        **{f"pop_deviation_by_draw_{n}": lambda n=n: deviation(n) for n in (20, 200, 1000)},
        **{f"plan_uniqueness_{n}": lambda n=n: diagnostics.uniqueness(ensemble(n), ["county"]) for n in (20, 200, 1000)},
        "rhat_200": lambda: rhat(200),
        "components": lambda: components(graph.contiguity(grid.where("k % 3 != 0"), "rook", ["county"]), nodes=grid.select("precinct_id")),
        "overlap_pairs": lambda: quality.overlap_pairs(quality.box_pairs(electorate.grid(spark, folder, enlarged=True), ["county"]), quality.rectangle_intersection(), ["county"], 0.1, 0.001),
        "edges_queen": lambda: graph.contiguity(grid, "queen", ["county"]),
    }
    wanted = set(filter(None, os.environ.get("BENCH_ONLY", "").split(",")))
    out, spread = {}, {}
    for name, job in jobs.items():
        if wanted and name not in wanted:
            continue
        took = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        out[name] = round(statistics.median(took[1:]), 3)
        spread[name] = [round(min(took[1:]), 3), round(max(took[1:]), 3)]
    print(json.dumps({"metric": "sum of warm medians", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "spread": spread, "sf": Path(folder).name.removeprefix("sf"), "cpus": cpus}))


if __name__ == "__main__":
    main()
