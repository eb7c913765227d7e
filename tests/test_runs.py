"""Stages by county that can be run again, and programs run beside tasks."""

import os
import sys

import pandas as pd
import pytest
from pyspark.sql import functions as F

from drawscope.plans import runs
from drawscope.sources import logs


def votes(spark, rows):
    return spark.createDataFrame(rows, "county string, unit string, votes int")


ROWS = [("01", "a", 1), ("01", "b", 2), ("02", "a", 3), ("03", "a", 4)]


def totals(frames):
    return frames["votes"].groupBy("county").agg(F.sum("votes").alias("total"))


def stamps(folder):
    return {d: {f: os.stat(f"{folder}/data/{d}/{f}").st_mtime_ns for f in os.listdir(f"{folder}/data/{d}") if f.endswith(".parquet")} for d in os.listdir(f"{folder}/data") if d.startswith("county=")}


def test_a_second_run_writes_nothing_and_a_change_one_county(spark, tmp_path):
    folder = f"{tmp_path}/stage"
    done = runs.run(spark, folder, {"votes": votes(spark, ROWS)}, totals)
    assert (done.run, done.written, done.skipped) == (1, ["01", "02", "03"], 0)
    before = stamps(folder)

    def never(frames):
        raise AssertionError("nothing is stale")

    done = runs.run(spark, folder, {"votes": votes(spark, ROWS[::-1]).repartition(3)}, never)
    assert (done.written, done.skipped) == ([], 3) and stamps(folder) == before
    changed = [("02", "a", 30) if r[0] == "02" else r for r in ROWS]
    seen = []
    done = runs.run(spark, folder, {"votes": votes(spark, changed)}, lambda f: seen.append({r.county for r in f["votes"].collect()}) or totals(f))
    after = stamps(folder)
    assert done.written == ["02"] and seen == [{"02"}] and {c for c in after if after[c] != before[c]} == {"county=02"}
    assert {r.county: r.total for r in runs.read(spark, folder).collect()} == {"01": 3, "02": 30, "03": 4}
    done = runs.run(spark, folder, {"votes": votes(spark, [*changed[:2], ("04", "n", None)])}, lambda f: totals(f).where("total is not null"))
    assert (done.written, done.dropped) == (["04"], ["02", "03"]) and set(stamps(folder)) == {"county=01"}
    assert runs.run(spark, folder, {"votes": votes(spark, ROWS[:2])}, totals, skip_existing=False).written == ["01"]


def test_failures_are_collected_or_stop_at_once(spark, tmp_path):
    def half(one: pd.DataFrame) -> pd.DataFrame:
        if one["county"].iloc[0] == "02":
            raise ValueError("no sense")
        return one.groupby("county", as_index=False).agg(total=("votes", "sum"))

    work = lambda frames: runs.by_county(frames["votes"], half, "county string, total long")
    for fast in (True, False):
        folder = f"{tmp_path}/{fast}"
        with pytest.raises(runs.RunFailed, match="02: ValueError: no sense") as caught:
            runs.run(spark, folder, {"votes": votes(spark, ROWS)}, work, fail_fast=fast)
        assert set(caught.value.failed) == {"02"} and os.path.exists(f"{folder}/data") is not fast
    assert set(stamps(f"{tmp_path}/False")) == {"county=01", "county=03"}
    done = runs.run(spark, f"{tmp_path}/False", {"votes": votes(spark, ROWS)}, totals)  # the failed one is still stale
    assert (done.written, done.skipped) == (["02"], 2)


STUB = """
import sys, time, pyarrow as pa, pyarrow.ipc
table = pa.ipc.open_stream(sys.stdin.buffer).read_all()
county = sys.argv[1]
print("Effective sample size: 7", file=sys.stderr, flush=True)
if county == "02":
    print("x" * 5000 + " out of luck", file=sys.stderr); sys.exit(3)
if county == "03":
    time.sleep(60)
if county == "04":
    print("not arrow"); sys.exit(0)
out = pa.table({"unit": table["unit"], "draw": pa.array([1] * len(table), pa.int32()), "district": pa.array([v % 2 + 1 for v in table["votes"].to_pylist()], pa.int32())})
with pa.ipc.new_stream(sys.stdout.buffer, out.schema) as s:
    s.write_table(out)
"""


def test_a_program_for_each_county(spark, tmp_path):
    (tmp_path / "stub.py").write_text(STUB)
    rows = votes(spark, [*ROWS, ("04", "a", 5)])
    found = runs.external(rows, [sys.executable, str(tmp_path / "stub.py"), "{county}"], "unit string, draw int, district int", f"{tmp_path}/logs", seconds=8).collect()
    assert sorted(tuple(r)[:4] for r in found if r.error is None) == [("01", "a", 1, 2), ("01", "b", 1, 1)]
    errors = {r.county: r.error for r in found if r.error is not None}
    assert set(errors) == {"02", "03", "04"}
    assert errors["02"].startswith("exit status 3: ") and errors["02"].endswith("out of luck\n") and len(errors["02"]) == 4000 + len("exit status 3: ")
    assert errors["03"].startswith("no end within 8 seconds") and "Arrow" in errors["04"]
    said = logs.files(spark, f"{tmp_path}/logs", "*.log").collect()
    assert len(said) == 4 and all(r.hits == 1 for r in said)
    none = runs.external(rows.where("county = '01'"), ["/no/such/program"], "unit string", f"{tmp_path}/logs").collect()
    assert len(none) == 1 and none[0].error.startswith("FileNotFoundError")
