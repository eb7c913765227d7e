"""Stages by county that can be run again: only counties whose inputs changed are worked on and written.

A stage's folder holds ``data`` (partitioned by county) and ``manifest`` (what each run did: county, fingerprint of its
inputs, run). A county is stale if its fingerprint is not that of its last entry. Fingerprints are sums of row hashes, so they
need no order and combine map-side. Stale counties go through one job; dynamic partition overwrite replaces their partitions
and leaves the others' files alone. What a stage does by group may fail for one county and not for others: ``by_county`` turns an
exception into a row with an ``error``; a county with one is not written and stays stale.
"""

from __future__ import annotations

import io
import subprocess
import traceback
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialise, release

COUNTY = "county"
ERROR = "error"
#: Characters of an error, and of a program's last words, that are kept.
ERROR_CHARS = 4000
_MANIFEST = "county string, fingerprint string, run int"


class RunFailed(RuntimeError):
    """Counties whose work failed, with their errors."""

    def __init__(self, stage: str, failed: dict[str, str], more: int = 0):
        self.failed = failed
        super().__init__(f"{stage}: {len(failed) + more} counties failed: " + "; ".join(f"{c}: {e.strip().splitlines()[-1] if e.strip() else e}" for c, e in failed.items()))


@dataclass(frozen=True)
class Done:
    """What a run did."""

    run: int
    written: list[str]
    skipped: int
    dropped: list[str]
    failed: dict[str, str]


def fingerprints(inputs: dict[str, DataFrame], county: str = COUNTY) -> DataFrame:
    """(county, fingerprint) over all rows of all inputs, in any order. Columns count by name; a repeated row counts each time."""
    per = []
    for name, df in sorted(inputs.items()):
        columns = sorted(c for c in df.columns if c != county)
        row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns)), {"ignoreNullFields": "false"}) if columns else F.lit("")
        halves = [F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(name), row), n).bitwiseAND(F.lit(0x7FFFFFFF)) for seed in (1, 2) for n in (0, 32)]
        sums = [F.sum(h).alias(f"s{i}") for i, h in enumerate(halves)]
        per.append(df.groupBy(F.col(county).cast("string").alias(COUNTY)).agg(F.count("*").alias("n"), *sums).select(COUNTY, F.concat_ws(":", F.lit(name), "n", "s0", "s1", "s2", "s3").alias("part")))
    whole = per[0]
    for one in per[1:]:
        whole = whole.unionByName(one)
    return whole.groupBy(COUNTY).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("part")), "\n"), 256).alias("fingerprint"))


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), hadoop


def _exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _fs(spark, path)
    return fs.exists(hadoop)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(county, fingerprint, run): each county's last entry. A null fingerprint: the county is gone."""
    if not _exists(spark, f"{folder}/manifest"):
        return spark.createDataFrame([], _MANIFEST)
    rows = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    return rows.groupBy(COUNTY).agg(F.max_by("fingerprint", "run").alias("fingerprint"), F.max("run").alias("run"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A stage's results, the county as text."""
    found = spark.read.parquet(f"{folder}/data").schema  # whose partition column would be a number
    kept = [T.StructField(f.name, T.StringType() if f.name == COUNTY else f.dataType) for f in found]
    return spark.read.schema(T.StructType(kept)).parquet(f"{folder}/data")


def run(spark: SparkSession, folder: str, inputs: dict[str, DataFrame], work: Callable[[dict[str, DataFrame]], DataFrame], county: str = COUNTY, skip_existing: bool = True, fail_fast: bool = False) -> Done:
    """Work on the stale counties (DOM6). ``work`` gets the inputs of those alone and returns rows with a county, and with an ``error``
    column if it has one (null: the row is a result).

    skip_existing: counties whose inputs are unchanged are left alone. Failed counties are written nowhere; the others are
    written and recorded, then the failure is raised, or, with ``fail_fast``, before anything is. A county that left the
    inputs loses its results. The run's number is one more than the last.
    """
    now, known = fingerprints(inputs, county), manifest(spark, folder)
    # A row a county.
    state = materialise(now.join(known.select(COUNTY, F.col("fingerprint").alias("before"), "run"), COUNTY, "full_outer"), "counties")
    number = (known.agg(F.max("run")).first()[0] or 0) + 1
    fresh = F.col("fingerprint").eqNullSafe(F.col("before")) if skip_existing else F.lit(False)
    stale = state.where(F.col("fingerprint").isNotNull() & ~fresh).select(COUNTY, "fingerprint")
    gone = [r[0] for r in state.where("fingerprint is null and before is not null").select(COUNTY).collect()]
    skipped = state.where(F.col("fingerprint").isNotNull() & fresh).count()
    wanted = {r[0] for r in stale.select(COUNTY).collect()}
    failed: dict[str, str] = {}
    written: list[str] = []
    if wanted:
        names = stale.select(F.col(COUNTY).alias("__county"))
        mine = {k: df.join(names, F.col(county).cast("string").eqNullSafe(F.col("__county")), "left_semi") for k, df in inputs.items()}
        made = materialise(work(mine), "stage")
        if ERROR in made.columns:
            bad = made.where(f"{ERROR} is not null").groupBy(F.col(COUNTY).cast("string").alias(COUNTY)).agg(F.min(ERROR).alias(ERROR))
            failed = {r[0]: r[1] for r in bad.collect()}
            if failed and fail_fast:
                raise RunFailed(folder, failed)
            made = made.where(f"{ERROR} is null").drop(ERROR).join(bad.select(F.col(COUNTY).alias("__county")), F.col(COUNTY).cast("string") == F.col("__county"), "left_anti")
        made.repartition(COUNTY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(COUNTY).parquet(f"{folder}/data")
        have = {str(r[0]) for r in made.select(F.col(COUNTY).cast("string")).distinct().collect()}
        written = sorted(str(c) for c in wanted if c not in failed)
        for c in written:
            if c not in have:
                _drop(spark, folder, c)
    for c in gone:
        _drop(spark, folder, c)
    entries = stale.where(~F.col(COUNTY).isin(sorted(failed))) if failed else stale
    rows = entries.unionByName(spark.createDataFrame([(c, None) for c in gone], f"{COUNTY} string, fingerprint string"))
    if written or gone:
        rows.withColumn("run", F.lit(number)).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    release(state)
    if failed:
        raise RunFailed(folder, failed)
    return Done(number, written, skipped, sorted(gone), failed)


def _drop(spark: SparkSession, folder: str, county: str) -> None:
    fs, hadoop = _fs(spark, f"{folder}/data/{COUNTY}={county}")
    fs.delete(hadoop, True)


def _outcome(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(ERROR, T.StringType())])


def by_county(rows: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, scope: Sequence[str] = (COUNTY,)) -> DataFrame:
    """``function`` on each county's rows, an exception as a row with its ``error``. For work that needs a county's rows
    together (some thousands); ``schema`` names the scope too."""
    kind = _outcome(T._parse_datatype_string(schema))

    def guarded(one: pd.DataFrame) -> pd.DataFrame:
        try:
            return function(one).assign(**{ERROR: None}).reindex(columns=kind.names)
        except Exception:
            row = {s: one[s].iloc[0] for s in scope} | {ERROR: traceback.format_exc()[-ERROR_CHARS:]}
            return pd.DataFrame([{c: row.get(c) for c in kind.names}])

    return rows.groupBy(*scope).applyInPandas(guarded, kind)


def external(rows: DataFrame, argv: Sequence[str], schema: str, stderr_folder: str, scope: Sequence[str] = (COUNTY,), seconds: float = 3600.0) -> DataFrame:
    """A program run once for each county, beside its task (DOM5): it gets the county's rows as an Arrow stream on its
    standard input and gives rows of ``schema`` (without the scope) as an Arrow stream on its standard output.

    What it says on standard error goes to ``<stderr_folder>/<scope values joined by ->.log`` in a store that executors share. A program that
    fails, gives no stream, or takes more than ``seconds`` (it is killed then) makes a row with an ``error``: the end of what it said. Words
    of ``argv`` may hold ``{county}`` and other names of the scope.
    """
    kinds = {f.name: f.dataType for f in rows.schema}
    out = _outcome(T.StructType([T.StructField(s, kinds[s]) for s in scope] + list(T._parse_datatype_string(schema).fields)))
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def ran(table: pa.Table) -> pa.Table:
        names = {s: table[s][0].as_py() for s in scope}
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        said, error, found = b"", None, None
        try:
            done = subprocess.run([a.format(**names) for a in argv], input=sink.getvalue(), capture_output=True, timeout=seconds)
            said = done.stderr
            if done.returncode:
                error = f"exit status {done.returncode}: "
            else:
                found = pa.ipc.open_stream(done.stdout).read_all()
        except subprocess.TimeoutExpired as late:
            said, error = late.stderr or b"", f"no end within {seconds:g} seconds: "
        except (OSError, pa.ArrowInvalid) as wrong:
            error = f"{type(wrong).__name__}: {wrong}: "
        text = said.decode("utf-8", "replace")
        files, folder = pyarrow.fs.FileSystem.from_uri(stderr_folder) if ":/" in stderr_folder else (pyarrow.fs.LocalFileSystem(), stderr_folder)
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(f"{folder}/{'-'.join(str(v) for v in names.values())}.log") as log:
            log.write(said)
        if error is not None:
            return pa.Table.from_pylist([names | {ERROR: error + text[-ERROR_CHARS:]}], arrow)
        columns = [pa.array([names[f.name]] * len(found), f.type) if f.name in names else pa.nulls(len(found), f.type) if f.name == ERROR else found[f.name].combine_chunks().cast(f.type) for f in arrow]
        return pa.Table.from_arrays(columns, schema=arrow)

    return rows.groupBy(*scope).applyInArrow(ran, out)

