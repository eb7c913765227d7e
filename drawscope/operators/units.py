"""Units, votes and enacted plans: contracts, filters, joins and reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise

from ..functions.keys import county_code

HEADER = ("maz", "taz", "szk", "precinct_id", "name", "oevk_id", "oevk_id_full", "header_generated", "header_vl_id", "header_nvv_id")
CODES = ("maz", "taz", "szk")


class ContractError(ValueError):
    """All failures of a contract, in one message."""


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    gone = [n for n in names if n not in df.columns]
    if gone:
        raise ContractError(f"missing columns {gone}")


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, null keys, different keys, keys that occur more than once (DED2)."""
    per = df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("n_null"), F.count("k").alias("n_keys"), F.count_if(F.col("k").isNotNull() & (F.col("n") > 1)).alias("n_repeated"))


def validate(df: DataFrame, unit: str = "precinct_id", geometry: str | None = None, population: str | None = None, crs: str | None = None, expected_crs: str | None = None) -> None:
    """Raise one error that lists everything wrong with a unit table (DOM1)."""
    wrong = [f"missing column {c!r}" for c in (unit, geometry, population) if c and c not in df.columns]
    if expected_crs and crs != expected_crs:
        wrong.append(f"crs is {crs!r}, expected {expected_crs!r}")
    if unit in df.columns:
        counts = key_counts(df, unit).first()
        wrong += [text for ok, text in ((counts.n_rows, "no rows"), (not counts.n_null, f"{counts.n_null} rows without {unit}"), (not counts.n_repeated, f"{counts.n_repeated} repeated {unit} values")) if not ok]
    checks = [F.count_if(F.col(c).isNull()).alias(c) for c in (geometry, population) if c and c in df.columns]
    if population and population in df.columns and dict(df.dtypes)[population] == "string":
        wrong.append(f"{population!r} isn't numeric")
    if checks:
        wrong += [f"{n} rows without {c}" for c, n in df.agg(*checks).first().asDict().items() if n]
    if wrong:
        raise ContractError("; ".join(wrong))


def first_by_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of every key in the given order (DED1)."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("__n = 1").drop("__n")


def official(df: DataFrame) -> DataFrame:
    """Official units; all, if the table has no unit_kind (FLT2)."""
    return df.where(F.col("unit_kind") == "szvk") if "unit_kind" in df.columns else df


def without_voids(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(F.col("unit_kind") != "void", F.lit(True))) if "unit_kind" in df.columns else df


def of_county(df: DataFrame, code: str, column: str = "maz") -> DataFrame:
    return df.where(county_code(F.col(column)) == county_code(F.lit(code)))


def county_sequence(counts: DataFrame, only: str | None = None, exclude: Sequence[str] = (), column: str = "maz") -> DataFrame:
    """Counties to visit, ascending (FLT5): a wanted county that is excluded or absent is an error."""
    codes = counts.select(county_code(F.col(column)).alias(column)).distinct()
    if exclude:
        codes = codes.where(~F.col(column).isin([c.strip().zfill(2) for c in exclude]))
    if only is not None:
        only = only.strip().zfill(2)
        if only in [c.strip().zfill(2) for c in exclude]:
            raise ContractError(f"county {only} is both wanted and excluded")
        codes = codes.where(F.col(column) == only)
    if not codes.limit(1).count():
        raise ContractError("no county is left")
    return codes.orderBy(column)


def semi(df: DataFrame, units: DataFrame, key: str = "precinct_id") -> DataFrame:
    """Rows of the ensemble's units (FLT4)."""
    return df.join(units.select(key), key, "left_semi")


def ordered_columns(df: DataFrame) -> DataFrame:
    """Known columns first, then the others in order (PRJ1)."""
    head = [c for c in HEADER if c in df.columns]
    return df.select(*head, *sorted(c for c in df.columns if c not in head))


def vote_columns(df: DataFrame) -> list[str]:
    """voters and the vote columns: what a void has none of."""
    return [c for c in df.columns if c == "voters" or c.startswith("votes_")]


def join_votes(units: DataFrame, votes: DataFrame, key: str = "precinct_id", how: str = "left", mask_voids: bool = True) -> DataFrame:
    """Votes on units; the votes' own code columns are dropped, voids get none (JN1, PRJ2)."""
    slim = votes.drop(*[c for c in CODES if c in units.columns])
    out = units.join(slim, key, how)
    if mask_voids and "unit_kind" in units.columns:
        out = out.withColumns({c: F.when(F.coalesce(F.col("unit_kind") != "void", F.lit(True)), F.col(c)) for c in vote_columns(slim)})
    return out


def voters_filled(joined: DataFrame) -> DataFrame:
    return joined.withColumn("voters", F.coalesce("voters", F.lit(0)))


def population_of(units: DataFrame, votes: DataFrame, column: str = "voters", key: str = "precinct_id") -> DataFrame:
    """(unit, population), missing as 0 (PRJ4)."""
    return units.select(key).join(votes.select(key, F.col(column).cast("double").alias("population")), key, "left").withColumn("population", F.coalesce("population", F.lit(0.0)))


#: Units up to which their columns are sent to every task; more are joined by shuffle.
BROADCAST_UNITS = 1 << 20


def on_units(ensemble: DataFrame, units: DataFrame, keys: Sequence[str] = ("precinct_id",)) -> DataFrame:
    """The columns of ``units`` on a long ensemble (JN10). The ensemble is the large side, and is
    not shuffled for the join as long as the units are few; they are counted first."""
    few = units.select(*keys).limit(BROADCAST_UNITS + 1).count() <= BROADCAST_UNITS
    return ensemble.join(F.broadcast(units) if few else units, list(keys))


def with_draw(units: DataFrame, draw: DataFrame, key: str = "precinct_id") -> DataFrame:
    """One draw's districts on units; both must hold the same ids (JN2)."""
    report = key_differences(units, draw, key).first()
    if report.only_left or report.only_right:
        raise ContractError(f"{report.only_left} units have no district, {report.only_right} districts have no unit")
    return units.join(draw.select(key, "district"), key)


def with_enacted(units: DataFrame, focal: DataFrame, key: str = "precinct_id", district: str = "oevk_id_full") -> DataFrame:
    """Enacted ids on units: unique in the plan, required for all but voids (JN3)."""
    if key_counts(focal, key).first().n_repeated:
        raise ContractError(f"enacted plan repeats {key}")
    out = units.join(focal.select(key, district), key, "left")
    gone = without_voids(out).where(F.col(district).isNull()).limit(1).count()
    if gone:
        raise ContractError("units without an enacted district")
    return out


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys only in one of the two (JN11)."""
    a, b = left.select(key, F.lit(1).alias("l")).distinct(), right.select(key, F.lit(1).alias("r")).distinct()
    return a.join(b, key, "full_outer").agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"))


def with_voids(units: DataFrame, voids: DataFrame, key: str = "precinct_id", check: bool = True) -> DataFrame:
    """Units and voids in one table; ids must differ, unit_kind is filled (SET1, SET4)."""
    if check and units.join(voids.select(key), key, "left_semi").limit(1).count():
        raise ContractError("units and voids share ids")
    kind = lambda df, k: df.withColumn("unit_kind", F.coalesce(F.col("unit_kind"), F.lit(k)) if "unit_kind" in df.columns else F.lit(k))
    return kind(units, "szvk").unionByName(kind(voids, "void"), allowMissingColumns=True)


def numbered_voids(voids: DataFrame, county: str = "county", x: str = "cx", y: str = "cy", tiebreak: str = "void_key", prefix: str = "gap") -> DataFrame:
    """Voids numbered from 0 in each county by centroid: prefix-CC-0000 (WIN2)."""
    n = F.row_number().over(Window.partitionBy(county).orderBy(x, y, tiebreak)) - 1
    return voids.withColumn("precinct_id", F.concat_ws("-", F.lit(prefix), county_code(F.col(county)), F.when(n < 10_000, F.lpad(n.cast("string"), 4, "0")).otherwise(n.cast("string"))))


def unit_index(units: DataFrame, scope: Sequence[str] = ("county",), key: str = "precinct_id") -> DataFrame:
    """0-based place of each id in code-point order within its scope (WIN1, ORD1)."""
    return units.withColumn("unit_index", F.row_number().over(Window.partitionBy(*scope).orderBy(key)) - 1)


def unit_index_of_all(units: DataFrame, key: str = "precinct_id") -> DataFrame:
    """0-based place of each id among all, without one task that holds them: ids are dealt by range,
    numbered within each range, and the ranges (a row each) by their sizes."""
    ranges = materialise(units.repartitionByRange(key).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("__range").agg(F.count("*").alias("n"))
    before = sizes.select("__range", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1
    return ranges.withColumn("__at", within).join(F.broadcast(before), "__range").withColumn("unit_index", (F.col("before") + F.col("__at")).cast("int")).drop("__range", "__at", "before")


def unknown_lists(votes: DataFrame, known: DataFrame) -> DataFrame:
    """How often a list without a column occurs (AGG18)."""
    return votes.join(known.select("list_id"), "list_id", "left_anti").groupBy("list_id").agg(F.count("*").alias("n"))


def wide_votes(votes: DataFrame, columns: dict[str, str], key: str = "precinct_id", check: bool = True) -> DataFrame:
    """List votes as one column a list (PIV1). Two lists of a unit on one column are an error."""
    names = sorted(set(columns.values()))
    spark = votes.sparkSession
    mapping = spark.createDataFrame(sorted(columns.items()), "list_id string, column string")
    placed = votes.join(F.broadcast(mapping), "list_id")
    if check and len(names) < len(columns) and placed.groupBy(key, "column").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        raise ContractError("two lists of a unit share a column")
    return placed.groupBy(key).pivot("column", names).agg(F.sum("votes"))


def missing_enacted(rows: DataFrame, district: str = "oevk_id_full") -> tuple[DataFrame, DataFrame]:
    """(rows with an enacted district, one row with the number of those without) (FLT9)."""
    label = F.nullif(F.trim(F.col(district).cast("string")), F.lit(""))
    return rows.where(label.isNotNull()).withColumn(district, label), rows.agg(F.count_if(label.isNull()).alias("n_missing"))


def allocation(focal: DataFrame, expected_total: int | None = None, expected_counties: Sequence[str] | None = None, county: str = "maz", district: str = "oevk_id_full", unit: str = "precinct_id") -> DataFrame:
    """(county, n_oevk): enacted districts of each county (AGG6). With expectations given, they
    are checked in a fixed order, each failure an error of its own."""
    work = focal.withColumn(county, county_code(F.col(county)))
    counts = work.groupBy(county).agg(F.countDistinct(district).alias("n_oevk"))
    if expected_total is not None:
        keys = key_counts(work, unit).first()
        if not keys.n_rows:
            raise ContractError("enacted plan is empty")
        if keys.n_null or keys.n_repeated or work.where(F.col(district).isNull() | (F.trim(district) == "")).limit(1).count():
            raise ContractError("enacted plan has null or repeated ids")
        per = work.groupBy(district).agg(F.countDistinct(county).alias("n"))
        total = per.agg(F.count("*").alias("n"), F.count_if(F.col("n") > 1).alias("split")).first()
        if total.n != expected_total:
            raise ContractError(f"national number of districts is {total.n}, expected {expected_total}")
        if total.split:
            raise ContractError(f"{total.split} districts lie in more than one county")
        if expected_counties is not None:
            present = {r[0] for r in counts.select(county).collect()}
            gone, extra = sorted(set(expected_counties) - present), sorted(present - set(expected_counties))
            if gone:
                raise ContractError(f"missing counties {gone}")
            if extra:
                raise ContractError(f"unexpected counties {extra}")
    return counts
