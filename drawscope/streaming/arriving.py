"""Draws that arrive as files, whole or in parts.

``measured_draws`` is for folders whose files are whole draws. ``measured_parts`` takes any cut: a stateful operator, keyed by (scope,
draw), holds each draw's bloc totals by district and the units it has seen until all of its scope's units have come; then the
draw is measured once, and its state shrinks to a mark. What comes for it later is reported, not measured. Progress
is the stream's checkpoint, so a restart goes on with the draws that were half there.

Quantiles over all draws come from KLL sketches by (scope, metric), a small row a batch each, merged when they are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.metrics import Policy, draw_metrics, long_metrics, plan_metrics

ENSEMBLE = "county string, draw int, chain int, precinct_id string, district int"
WHOLE, LATE = "whole", "late"
_STATE = "done boolean, chain int, units array<string>, districts array<int>, a array<double>, b array<double>, n array<bigint>"


def measured_draws(spark: SparkSession, folder: str, units: DataFrame, sink: str, checkpoint: str, scope: list[str] | None = None, policy: Policy | None = None, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Metrics of every draw in ``folder``, appended to Parquet in ``sink`` under one folder a
    batch, which a repeated batch overwrites. ``units`` hold balanced votes; every file is a set of whole draws."""
    scope = scope or ["county"]

    def batch(draws: DataFrame, number: int) -> None:
        out = draw_metrics(units, draws, scope, policy)
        out.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        if then:
            then(out, number)

    stream = spark.readStream.schema(ENSEMBLE).parquet(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _gathered(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows (key, chain, status, district, a, b, n_units) of a draw that is whole now, or of what came too late for it."""
    names = ["chain", "status", "district", "a", "b", "n_units"]
    keyed = lambda rows: pd.DataFrame([(*key, *r) for r in rows], columns=[*(f"k{i}" for i in range(len(key))), *names])
    done, chain, units, *held = state.get if state.exists else (False, None, [], [], [], [], [])
    seen, totals = set(units), {d: [a, b, n] for d, a, b, n in zip(*held, strict=True)}
    need, late = 0, 0
    for frame in frames:
        if done:
            late += len(frame)
            continue
        need = max(need, int(frame["__need"].max()))
        chains = [c for c in ([chain] if chain is not None else []) + frame["chain"].dropna().astype(int).tolist()]
        chain = min(chains) if chains else None
        fresh = frame[~frame["precinct_id"].isin(seen)].drop_duplicates("precinct_id")
        seen.update(fresh["precinct_id"])
        for district, part in fresh.groupby("district"):
            have = totals.setdefault(int(district), [0.0, 0.0, 0])
            have[0] += float(part["votes_a"].sum())
            have[1] += float(part["votes_b"].sum())
            have[2] += len(part)
    if done:
        yield keyed([(chain, LATE, None, None, None, late)])
    elif len(seen) >= need:
        state.update((True, chain, [], [], [], [], []))
        yield keyed([(chain, WHOLE, d, *t) for d, t in sorted(totals.items())])
    else:
        state.update((False, chain, sorted(seen), list(totals), *([t[i] for t in totals.values()] for i in range(3))))


def measured_parts(spark: SparkSession, folder: str, units: DataFrame, sink: str, checkpoint: str, scope: list[str] | None = None, policy: Policy | None = None, files_per_batch: int | None = None) -> StreamingQuery:
    """Metrics of every draw in ``folder`` once all its units are there, whatever files hold them.

    Writes ``<sink>/metrics``, ``<sink>/late`` (scope, draw, n_rows that came after a draw was measured) and ``<sink>/sketches``, one
    folder a batch, which a repeated batch overwrites. units: (scope, precinct_id, balanced votes); rows of other units, and
    a unit's second row, do not count. A unit without a district is not there yet.
    """
    scope = scope or ["county"]
    need = units.groupBy(*scope).agg(F.count("*").cast("int").alias("__need"))
    known = units.select(*scope, "precinct_id", "votes_a", "votes_b").join(need, scope)
    kinds = {f.name: f.dataType.simpleString() for f in known.schema}
    keys = [*scope, "draw"]
    named = ", ".join(f"k{i} {kinds.get(k, 'int')}" for i, k in enumerate(keys))
    raw = spark.readStream.schema(ENSEMBLE)
    if files_per_batch:
        raw = raw.option("maxFilesPerTrigger", files_per_batch)
    rows = raw.parquet(folder).where("district is not null").join(known, [*scope, "precinct_id"])
    totals = rows.groupBy(*keys).applyInPandasWithState(_gathered, f"{named}, chain int, status string, district int, a double, b double, n_units bigint", _STATE, "append", GroupStateTimeout.NoTimeout)
    back = totals.withColumnsRenamed({f"k{i}": k for i, k in enumerate(keys)})

    def batch(found: DataFrame, number: int) -> None:
        found.persist()  # the three writes read the batch once
        out = plan_metrics(found.where(F.col("status") == WHOLE), keys, policy)
        out.write.mode("overwrite").parquet(f"{sink}/metrics/batch={number}")
        found.where(F.col("status") == LATE).select(*keys, F.col("n_units").alias("n_rows")).write.mode("overwrite").parquet(f"{sink}/late/batch={number}")
        done = spark.read.parquet(f"{sink}/metrics/batch={number}")
        sketch = long_metrics(done, keys).where("value is not null").groupBy(*scope, "metric").agg(F.kll_sketch_agg_double("value").alias("sketch"), F.count("*").alias("n"))
        sketch.write.mode("overwrite").parquet(f"{sink}/sketches/batch={number}")
        found.unpersist()

    return back.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quantiles(spark: SparkSession, sink: str, at: tuple[float, ...] = (0.05, 0.5, 0.95), scope: list[str] | None = None) -> DataFrame:
    """(scope, metric, n_draws, p…) over all draws measured so far, from the merged sketches (rank error about 1.3 %)."""
    scope = scope or ["county"]
    merged = spark.read.parquet(f"{sink}/sketches").groupBy(*scope, "metric").agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n_draws"))
    return merged.select(*scope, "metric", "n_draws", *(F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(f"p{round(100 * q):02d}") for q in at))
