"""A synthetic electorate over star-schema tables, in integer arithmetic only.

Customers are units, nations counties, orders votes, suppliers voids; plans and geometry are
made from the customer number. The same definitions stand in ``BASE_SQL`` as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import unit_id
from ..operators.units import numbered_voids, unit_index
from ..scratch import table

DRAWS = 20
#: Rows of an ensemble that one task makes from its units.
ROWS_A_TASK = 1 << 19
BLOCS = {"1": "a", "2": "a", "3": "b", "4": "b"}


def units(spark: SparkSession, folder: str) -> DataFrame:
    """(county, maz, taz, szk, precinct_id, k, nd, unit_kind)"""
    k = F.col("c_custkey")
    settlement, station = (k % 7).cast("string"), ((k - k % 7) / 7).cast("bigint").cast("string")
    maz = F.col("c_nationkey").cast("string")
    return table(spark, folder, "customer").select(F.lpad(maz, 2, "0").alias("county"), maz.alias("maz"), settlement.alias("taz"), station.alias("szk"), unit_id(maz, settlement, station).alias("precinct_id"), k.alias("k"), (F.lit(2) + F.col("c_nationkey") % 3).alias("nd"), F.lit("szvk").alias("unit_kind"))


def list_votes(spark: SparkSession, folder: str) -> DataFrame:
    """(precinct_id, list_id, votes): orders by leading digit of their priority."""
    orders = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("k"), F.substring("o_orderpriority", 1, 1).alias("list_id")).agg(F.count("*").alias("votes"))
    return orders.join(units(spark, folder).select("k", "precinct_id"), "k").select("precinct_id", "list_id", "votes")


def voters(spark: SparkSession, folder: str) -> DataFrame:
    return list_votes(spark, folder).groupBy("precinct_id").agg(F.sum("votes").alias("voters"))


def coding(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(BLOCS.items()), "list_id string, bloc string")


def focal(spark: SparkSession, folder: str) -> DataFrame:
    """The enacted plan; one unit in 97 lacks a district."""
    d = F.concat("county", F.lit("-"), (1 + F.col("k") % F.col("nd")).cast("string"))
    return units(spark, folder).select("county", "precinct_id", F.when(F.col("k") % 97 != 0, d).alias("district"))


def districts(spark: SparkSession, folder: str) -> DataFrame:
    return units(spark, folder).select("county", F.col("nd").alias("ndists")).distinct()


def ensemble(spark: SparkSession, folder: str, draws: int = DRAWS) -> DataFrame:
    """(county, draw, chain, precinct_id, district); the last draw repeats the first.

    A unit makes a row a draw, so units are dealt to tasks before that: files as small as theirs are read by one task,
    which would sort or group all rows of the ensemble."""
    k, e = F.col("k"), F.when(F.col("draw") == draws, 1).otherwise(F.col("draw"))
    few = units(spark, folder)
    tasks = -(-few.count() * draws // ROWS_A_TASK)
    dealt = few.repartition(tasks, "precinct_id") if tasks > 1 else few
    long = dealt.select("county", "precinct_id", "k", "nd", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    return long.select("county", "draw", (1 + (F.col("draw") - 1 - (F.col("draw") - 1) % 5) / 5).cast("int").alias("chain"), "precinct_id", (1 + (k * 31 + e * 17 + (k * e) % 7) % F.col("nd")).cast("int").alias("district"))


def voids(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as voids, numbered by (key % 13, key % 5)."""
    s = F.col("s_suppkey")
    rows = table(spark, folder, "supplier").select(F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("county"), (s % 13).alias("cx"), (s % 5).alias("cy"), s.alias("void_key"))
    return numbered_voids(rows).withColumn("unit_kind", F.lit("void"))


def grid(spark: SparkSession, folder: str, enlarged: bool = False) -> DataFrame:
    """Unit squares in rows of eight by place in the county; every eleventh is wider if ``enlarged``."""
    i = F.col("unit_index")
    x, y = (i % 8).cast("double"), ((i - i % 8) / 8).cast("double")
    side = F.when(F.lit(enlarged) & (F.col("k") % 11 == 0), 1.5).otherwise(1.0)
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.array(p(x, y), p(x + side, y), p(x + side, y + side), p(x, y + side), p(x, y))
    return unit_index(units(spark, folder)).select("county", "precinct_id", "k", "unit_kind", x.alias("x"), y.alias("y"), side.alias("side"), F.array(F.array(ring)).alias("shape"))


BASE_SQL = f"""
u AS (SELECT lpad(c_nationkey::VARCHAR, 2, '0') AS county, c_custkey AS k, 2 + c_nationkey % 3 AS nd,
  lpad(c_nationkey::VARCHAR, 2, '0') || '-' || lpad((c_custkey % 7)::VARCHAR, 3, '0') || '-' || CASE WHEN length((c_custkey // 7)::VARCHAR) < 3 THEN lpad((c_custkey // 7)::VARCHAR, 3, '0') ELSE (c_custkey // 7)::VARCHAR END AS precinct_id FROM customer),
lv AS (SELECT u.county, u.precinct_id, substr(o_orderpriority, 1, 1) AS list_id, count(*)::BIGINT AS votes FROM orders JOIN u ON o_custkey = k GROUP BY ALL),
bv AS (SELECT u.county, u.k, u.nd, u.precinct_id, coalesce(sum(CASE WHEN list_id IN ('1', '2') THEN votes END), 0)::DOUBLE AS a, coalesce(sum(CASE WHEN list_id IN ('3', '4') THEN votes END), 0)::DOUBLE AS b,
  coalesce(sum(votes), 0)::BIGINT AS voters, count(list_id) > 0 AS in_votes FROM u LEFT JOIN lv ON lv.precinct_id = u.precinct_id GROUP BY ALL),
fo AS (SELECT county, precinct_id, k, CASE WHEN k % 97 <> 0 THEN county || '-' || (1 + k % nd)::VARCHAR END AS district FROM u),
draws AS (SELECT unnest(range(1, {DRAWS} + 1)) AS draw),
ens AS (SELECT county, precinct_id, draw, 1 + (draw - 1) // 5 AS chain, (1 + (k * 31 + e * 17 + (k * e) % 7) % nd)::INTEGER AS district, nd FROM (SELECT *, CASE WHEN draw = {DRAWS} THEN 1 ELSE draw END AS e FROM u, draws)),
bal AS (SELECT county, sum(a) AS sa, sum(b) AS sb, CASE WHEN sum(a) > 1e-9 AND sum(b) > 1e-9 THEN sqrt(sum(b) / sum(a)) END AS x FROM bv GROUP BY county),
uv AS (SELECT bv.county, bv.precinct_id, bv.in_votes, a * coalesce(x, 1.0) AS a, b / coalesce(x, 1.0) AS b FROM bv JOIN bal USING (county)),
dt AS (SELECT ens.county, draw, district, sum(a) AS a, sum(b) AS b, count(*) AS n_units FROM ens JOIN uv USING (precinct_id) GROUP BY ALL),
ft AS (SELECT fo.county, district, sum(a) AS a, sum(b) AS b, count(*) AS n_units FROM fo JOIN uv USING (precinct_id) WHERE district IS NOT NULL GROUP BY ALL),
voids AS (SELECT lpad(s_nationkey::VARCHAR, 2, '0') AS county, s_suppkey, 'gap-' || lpad(s_nationkey::VARCHAR, 2, '0') || '-' || lpad((row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 13, s_suppkey % 5, s_suppkey) - 1)::VARCHAR, 4, '0') AS precinct_id FROM supplier),
grid AS (SELECT *, (i % 8)::DOUBLE AS x, (i // 8)::DOUBLE AS y, CASE WHEN k % 11 = 0 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS side FROM (SELECT *, row_number() OVER (PARTITION BY county ORDER BY precinct_id) - 1 AS i FROM u))
"""
