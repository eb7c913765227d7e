"""Sampler logs: what is said of each county's run, read where the logs lie."""

from __future__ import annotations

from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import ESS_PATTERN

EXCERPT_CHARS = 4000
STREAMS = ("stderr", "stdout")


def _place(path: Column) -> Column:
    """A path as files are listed: local ones without their scheme."""
    return F.regexp_replace(path, r"^file:/+", "/")


def _empty(spark: SparkSession, folder: str, glob: str) -> list[tuple[str]]:
    """Empty files below ``folder``: Spark's readers pass over them. One listing; a run has two logs."""
    fs = spark._jvm.org.apache.hadoop.fs
    root = fs.Path(folder)
    walk = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listFiles(root, True)
    out = []
    while walk.hasNext():
        status = walk.next()
        if not status.getLen() and fnmatch(status.getPath().getName(), glob):
            out.append((status.getPath().toString(),))
    return out


def files(spark: SparkSession, folder: str, glob: str = "*", excerpt_chars: int = EXCERPT_CHARS) -> DataFrame:
    """(path, hits, chars, tail) of every log below ``folder``. A log is counted and cut to its end where it is read;
    bytes that are no UTF-8 are replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    kept = raw.select(
        _place(F.col("path")).alias("path"),
        F.regexp_count(text, F.lit(ESS_PATTERN)).cast("bigint").alias("hits"),
        F.length(text).cast("bigint").alias("chars"),
        F.right(text, F.lit(excerpt_chars)).alias("tail"),
    )
    none = F.lit(0).cast("bigint")
    empty = spark.createDataFrame(_empty(spark, folder, glob), "path string")
    return kept.unionByName(empty.select(_place(F.col("path")).alias("path"), none.alias("hits"), none.alias("chars"), F.lit("").alias("tail")))


def scanned(wanted: DataFrame, found: DataFrame, scope: list[str], excerpt_chars: int = EXCERPT_CHARS) -> DataFrame:
    """(scope, parse_status, stderr_path, stdout_path, ess_line_hits, log_excerpt_chars, excerpt_suffix) of each row of
    ``wanted`` (scope, stderr_path, stdout_path), with ``found`` as from ``files`` (FN15).

    The two logs follow each other, each under a line with its name; a file that isn't there is a line that says so. parse_status:
    ``no_log_paths`` where neither path is given (null or empty), else ``scanned``. The excerpt is the end of that text, which needs no
    more than the end of each log.
    """
    given = {s: F.nullif(F.col(f"{s}_path"), F.lit("")) for s in STREAMS}
    rows = wanted.select(*scope, *(given[s].alias(f"{s}_path") for s in STREAMS))
    for s in STREAMS:
        side = found.select(F.col("path").alias(f"{s}_at"), F.struct("hits", "chars", "tail").alias(s))
        rows = rows.join(side, _place(F.col(f"{s}_path")) == F.col(f"{s}_at"), "left").drop(f"{s}_at")

    def one(s: str) -> Column:
        path, log = F.col(f"{s}_path"), F.col(s)
        missing = F.concat(F.lit(f"[{s}: missing file "), path, F.lit("]\n"))
        head = F.lit(f"--- {s} ---\n")
        length = F.length(head) + log["chars"] + 1
        return F.when(path.isNull(), F.struct(F.lit(0).cast("bigint").alias("hits"), F.lit(0).cast("bigint").alias("chars"), F.lit("").alias("tail"))).when(
            log.isNull(), F.struct(F.regexp_count(missing, F.lit(ESS_PATTERN)).cast("bigint").alias("hits"), F.length(missing).cast("bigint").alias("chars"), missing.alias("tail"))
        ).otherwise(F.struct(log["hits"].alias("hits"), length.cast("bigint").alias("chars"), F.concat(F.when(log["chars"] <= excerpt_chars, head).otherwise(""), log["tail"], F.lit("\n")).alias("tail")))

    rows = rows.withColumns({f"__{s}": one(s) for s in STREAMS})
    both = F.right(F.concat("__stderr.tail", "__stdout.tail"), F.lit(excerpt_chars))
    given_any = F.col("stderr_path").isNotNull() | F.col("stdout_path").isNotNull()
    return rows.select(
        *scope,
        F.when(given_any, "scanned").otherwise("no_log_paths").alias("parse_status"),
        "stderr_path",
        "stdout_path",
        (F.col("__stderr.hits") + F.col("__stdout.hits")).alias("ess_line_hits"),
        F.when(given_any, F.least(F.lit(excerpt_chars).cast("bigint"), F.col("__stderr.chars") + F.col("__stdout.chars"))).otherwise(0).alias("log_excerpt_chars"),
        F.when(given_any, both).alias("excerpt_suffix"),
    )
