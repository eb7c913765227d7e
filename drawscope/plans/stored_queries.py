"""Registered queries over what is written first and read back: the settlement tree, ensembles,
edges, layers and reports. Trees and tables lie in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys, rings
from ..operators import ensembles
from ..operators import units as ops
from ..scratch import scoped_path, table
from ..sources import geoparquet, settlements, sinks, stored
from . import electorate, reports, runs
from .registry import _ALL, _EDGE, SCOPE, SKIP, edges_rook, q, r

#: Units a settlement file holds at most (repeats aside), so files grow in number and not in size.
FILE_UNITS = 500
#: The column of each list; list 5 has none.
LISTS = {"election_year": 2022, "lists": {"1": {"column": "votes_one", "label_hu": "first"}, "2": "votes_two", "3": "votes_three", "4": "votes_four"}}


# ---- the settlement tree --------------------------------------------------------------------


def _documents(spark, d) -> DataFrame:
    """The electorate as settlement files, one JSON document each, read again.

    Every 50th unit is listed once more without votes, every 41st has an outline of two points."""
    votes = electorate.list_votes(spark, d).groupBy("precinct_id").agg(F.sort_array(F.collect_list(F.struct("list_id", "votes"))).alias("entries"), F.sum("votes").alias("voters"))
    codes = electorate.units(spark, d).select("precinct_id", "maz", "taz", "szk")
    outlined = electorate.grid(spark, d).select("county", "precinct_id", "k", "x", "y")
    rows = outlined.join(codes, "precinct_id").join(electorate.focal(spark, d).select("precinct_id", "district"), "precinct_id").join(votes, "precinct_id", "left")
    at = lambda dx, dy: F.concat_ws(" ", F.col("y") + dy, F.col("x") + dx)
    corners = [at(0, 0), at(1, 0), at(1, 1), at(0, 1)]
    outline = F.concat_ws(",", F.when(F.col("k") % 41 == 0, F.array(*corners[:2])).otherwise(F.array(*corners)))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    copies = rows.withColumn("copy", F.explode(F.when(F.col("k") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    first = F.col("copy") == 0
    record = F.struct(
        F.concat(F.lit(" "), "maz").alias("maz"),
        "taz",
        "szk",
        at(0.5, 0.5).alias("centrum"),
        outline.alias("poligon"),
        F.concat(F.lit("unit "), F.col("k").cast("string")).alias("name"),
        text(F.split_part("district", F.lit("-"), F.lit(2))).alias("oevk_id"),
        text(F.col("district")).alias("oevk_id_full"),
        F.when(first, text(F.col("voters"))).otherwise("0").alias("voters"),
        F.when(first, F.col("entries")).alias("entries"),
    )
    filed = lambda z: z["record"].withField("listVotes", F.map_from_entries(z["record"]["entries"])).dropFields("entries")
    part = (F.col("szk").cast("bigint") / FILE_UNITS).cast("bigint")
    docs = copies.groupBy("county", "maz", "taz", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("precinct_id", "copy", record.alias("record")))).alias("all"))
    header = F.struct(F.lit("2022-04-03").alias("generated"), F.col("maz").cast("bigint").alias("vl_id"), F.col("taz").cast("bigint").alias("nvv_id"))
    root = scoped_path(spark, "settlements")
    docs.select("county", header.alias("header"), F.transform("all", filed).alias("list")).write.option("maxRecordsPerFile", 1).partitionBy("county").json(root)
    return settlements.documents(spark, root)


_TREE = ", tv AS (SELECT precinct_id, sum(votes)::BIGINT AS voters, count(*) AS n_lists FROM lv GROUP BY precinct_id), tu AS (SELECT u.*, k % 7 AS taz, k // 7 AS szk, c_nationkey AS maz, district FROM u JOIN customer ON c_custkey = k JOIN (SELECT precinct_id, district FROM fo) USING (precinct_id)), tr AS (SELECT tu.*, voters, coalesce(n_lists, 0) AS n_lists FROM tu LEFT JOIN tv USING (precinct_id))"


@q(f"{_TREE}, a AS (SELECT *, voters AS v, n_lists AS n FROM tr UNION ALL SELECT *, 0, 0 FROM tr WHERE k % 50 = 0) SELECT precinct_id, maz::VARCHAR AS maz, taz::VARCHAR AS taz, szk::VARCHAR AS szk, 'unit ' || k AS name, split_part(district, '-', 2) AS oevk_id, district AS oevk_id_full, v::BIGINT AS voters, n::BIGINT AS n_lists, maz::BIGINT AS header_vl_id, taz::BIGINT AS header_nvv_id FROM a")
def settlement_records(spark, d):  # SRC1, SRC2, SRC3
    found = settlements.records(_documents(spark, d))
    n_lists = F.coalesce(F.size(F.map_keys("list_votes")), F.lit(0))
    return found.select("precinct_id", "maz", "taz", "szk", "name", "oevk_id", "oevk_id_full", "voters", F.greatest(n_lists, F.lit(0)).cast("bigint").alias("n_lists"), "header_vl_id", "header_nvv_id")


@q(f"{_TREE} SELECT (SELECT count(*) FROM (SELECT DISTINCT maz, taz, szk // {FILE_UNITS} AS part FROM tr)) AS n_files, (SELECT count(*) + count(*) FILTER (k % 50 = 0) FROM tr) AS n_records, (SELECT count(*) FROM tr WHERE k % 50 = 0) AS n_duplicates")
def settlement_counts(spark, d):  # SRC1, SRC6, DED1
    docs = _documents(spark, d)
    files = docs.agg(F.countDistinct("file").alias("n_files"))
    return files.crossJoin(settlements.record_total(docs)).crossJoin(settlements.repeated(settlements.records(docs)))  # a row each


@q(" SELECT precinct_id, x + 0.5::DOUBLE AS centre_x, y + 0.5::DOUBLE AS centre_y, 1.0::DOUBLE AS area, 4.0::DOUBLE AS perimeter, 'szvk' AS unit_kind FROM grid WHERE k % 41 <> 0")
def settlement_layer(spark, d):  # SRC4, GEO1, GEO2
    layer = settlements.unit_layer(settlements.records(_documents(spark, d)))
    return layer.select("precinct_id", F.col("centrum.x").alias("centre_x"), F.col("centrum.y").alias("centre_y"), r(rings.area(F.col("shape"))).alias("area"), r(rings.exterior_length(F.col("shape"))).alias("perimeter"), "unit_kind")


def _tables(spark, d) -> tuple[DataFrame, DataFrame]:
    return settlements.electoral_tables(settlements.records(_documents(spark, d)), settlements.ListMap.parse(LISTS))


@q(f"{_TREE}, w AS (SELECT precinct_id, sum(votes) FILTER (list_id = '1')::BIGINT AS votes_one, sum(votes) FILTER (list_id = '2')::BIGINT AS votes_two, sum(votes) FILTER (list_id = '3')::BIGINT AS votes_three, sum(votes) FILTER (list_id = '4')::BIGINT AS votes_four FROM lv GROUP BY precinct_id) SELECT maz::VARCHAR AS maz, taz::VARCHAR AS taz, szk::VARCHAR AS szk, precinct_id, 'unit ' || k AS name, split_part(district, '-', 2) AS oevk_id, district AS oevk_id_full, '2022-04-03' AS header_generated, maz::BIGINT AS header_vl_id, taz::BIGINT AS header_nvv_id, voters, votes_four, votes_one, votes_three, votes_two FROM tr LEFT JOIN w USING (precinct_id)")
def electoral_votes(spark, d):  # SRC5, SRC7, SNK1, PRJ1, PIV1
    path = scoped_path(spark, "votes")
    sinks.write_table(_tables(spark, d)[0], path)
    return spark.read.parquet(path)


@q(f"{_TREE} SELECT precinct_id, district AS oevk_id_full, split_part(district, '-', 2) AS oevk_id, maz::VARCHAR AS maz FROM tr WHERE district IS NOT NULL")
def electoral_focal(spark, d):  # SRC5, SNK1
    return _tables(spark, d)[1]


# ---- ensembles, edges, layers, reports ------------------------------------------------------


@q(" SELECT precinct_id, draw::INTEGER AS draw, district FROM ens")
def stored_ensemble_wide(spark, d):  # SNK3, SRC13, PIV2, PIV4
    folder = scoped_path(spark, "ensemble-wide")
    sinks.write_ensemble(electorate.ensemble(spark, d), folder, "wide")
    return stored.ensemble(spark, folder).select("precinct_id", "draw", "district")


@q(" SELECT (SELECT count(*) FROM u) AS n_units, (SELECT count(*) FROM draws) AS n_draws, (SELECT string_agg((1 + (draw - 1) // 5)::VARCHAR, ',' ORDER BY draw) FROM draws) AS chains, 0::BIGINT AS n_differences, (SELECT count(*) FROM ens) AS n_rows")
def stored_ensemble_manifest(spark, d):  # SNK3, SRC12, AGG23: what is read is what the manifest says
    folder = scoped_path(spark, "ensemble-long")
    sinks.write_ensemble(electorate.ensemble(spark, d), folder)
    meta = stored.read_manifest(spark, folder)
    said = {"n_units": meta["n_units"], "n_draws": meta["n_draws"], "chains": ",".join(map(str, meta["chain_per_draw"])), "n_differences": len(stored.verify(spark, folder))}
    return stored.ensemble(spark, folder, check=True).agg(F.count("*").alias("n_rows")).select(*(F.lit(v).cast("string" if isinstance(v, str) else "bigint").alias(k) for k, v in said.items()), "n_rows")


@q(f", {_EDGE} SELECT src, dst FROM eq WHERE manhattan = 1")
def stored_edges(spark, d):  # SNK4, SRC15, GR6: reversed, repeated and looped rows are normalised
    rook = edges_rook(spark, d).select("src", "dst")
    raw = rook.select(F.col("dst").alias("src"), F.col("src").alias("dst")).unionByName(rook).unionByName(rook.select("src", F.col("src").alias("dst")))
    folder = scoped_path(spark, "edges")
    sinks.write_edges(raw, folder, {"rule": "rook"})
    return stored.edges(spark, f"{folder}/edges")


def _layer(spark, d) -> str:
    path = scoped_path(spark, "layer")
    geoparquet.write(electorate.grid(spark, d, enlarged=True).select("precinct_id", "county", "shape"), path, geoparquet.UTM_33N)
    return path


@q(" SELECT precinct_id, county, side * side AS area, x AS min_x, y + side AS max_y, 5 AS n_points, 'EPSG:32633' AS crs, (SELECT max(x + side) FROM grid) AS layer_max_x FROM grid")
def stored_layer(spark, d):  # SNK2, SRC9
    path = _layer(spark, d)
    about = geoparquet.described(path)
    shape, box = F.col("shape"), rings.bounds(F.col("shape"))
    return geoparquet.read(spark, path).select("precinct_id", "county", r(rings.area(shape)).alias("area"), box["minx"].alias("min_x"), box["maxy"].alias("max_y"), F.size(F.flatten(F.flatten(shape))).alias("n_points"), F.lit(about["crs"]).alias("crs"), F.lit(about["bounds"][2]).alias("layer_max_x"))


@q(" SELECT precinct_id, x AS min_x, y AS min_y FROM grid WHERE x <= 2.5 AND x + side >= 1.25 AND y <= 3 AND y + side >= 0.5")
def stored_layer_box(spark, d):  # SRC9: files whose bounds miss the box are not opened
    box = (1.25, 0.5, 2.5, 3.0)
    b = rings.bounds(F.col("shape"))
    rows = geoparquet.read(spark, _layer(spark, d), box).select("precinct_id", b.alias("b"))
    return rows.where((F.col("b.minx") <= box[2]) & (F.col("b.maxx") >= box[0]) & (F.col("b.miny") <= box[3]) & (F.col("b.maxy") >= box[1])).select("precinct_id", F.col("b.minx").alias("min_x"), F.col("b.miny").alias("min_y"))


@q(" SELECT precinct_id, 'Feature' AS kind, 'MultiPolygon' AS geometry, x + side AS corner_x, y + side AS corner_y FROM grid")
def geojson_features(spark, d):  # SNK2
    path = scoped_path(spark, "geojson")
    sinks.geojson_rows(electorate.grid(spark, d, enlarged=True).select("precinct_id", "shape")).write.text(path)
    read = spark.read.text(path).select(F.from_json("value", "type string, properties struct<precinct_id:string>, geometry struct<type:string,coordinates:array<array<array<array<double>>>>>").alias("f"))
    corner = F.col("f.geometry.coordinates")[0][0][2]
    return read.select("f.properties.precinct_id", F.col("f.type").alias("kind"), F.col("f.geometry.type").alias("geometry"), corner[0].alias("corner_x"), corner[1].alias("corner_y"))


@q(f"{_ALL} SELECT county AS maz, metric, round(focal_value, 6) + 0.0::DOUBLE AS focal_value, round(ensemble_mean, 6) + 0.0::DOUBLE AS ensemble_mean, round(ensemble_p05, 6) + 0.0::DOUBLE AS ensemble_p05, round(ensemble_p95, 6) + 0.0::DOUBLE AS ensemble_p95, round(percentile_rank, 6) AS percentile_rank FROM cmp")
def stored_reports(spark, d):  # SRC16, SNK6, PIV6
    made = reports.county_reports(electorate.units(spark, d).select("county", "precinct_id"), electorate.list_votes(spark, d), electorate.coding(spark), electorate.focal(spark, d), electorate.ensemble(spark, d), electorate.voters(spark, d), electorate.districts(spark, d), SCOPE, SKIP, 0.25)
    path = scoped_path(spark, "reports")
    reports.write_county_reports(made, path)
    read = spark.read.json(f"{path}/report=partisan/county=*").withColumn("maz", F.regexp_extract(F.col("_metadata.file_path"), r"/county=([^/]+)/", 1))
    names = [f.name for f in read.schema["metrics"].dataType.fields]
    flat = stored.metric_rows(read, names)
    return flat.select("maz", "metric", *(r(c).alias(c) for c in flat.columns[2:]))


@q(" SELECT county, sum(votes + CASE WHEN county = '07' THEN 1 ELSE 0 END)::BIGINT AS votes, CASE WHEN county = '07' THEN 2 ELSE 1 END AS run FROM lv GROUP BY county")
def resumed_stage(spark, d):  # DOM6: three calls; the second finds nothing stale and is no run, the third finds one county
    folder = scoped_path(spark, "stage")
    votes = electorate.list_votes(spark, d).join(electorate.units(spark, d).select("precinct_id", "county"), "precinct_id")
    more = votes.withColumn("votes", F.col("votes") + F.when(F.col("county") == "07", 1).otherwise(0))
    total = lambda frames: frames["votes"].groupBy("county").agg(F.sum("votes").alias("votes"))
    for given in (votes, votes, more):
        runs.run(spark, folder, {"votes": given}, total)
    last = runs.manifest(spark, folder).select("county", "run")
    return runs.read(spark, folder).join(last, "county").select("county", "votes", "run")


# ---- small operators ------------------------------------------------------------------------


@q(" SELECT DISTINCT u.precinct_id, u.county FROM u JOIN ens USING (precinct_id) WHERE draw = 3 AND district = 2")
def ensemble_units(spark, d):  # FLT4
    chosen = ensembles.single_draw(electorate.ensemble(spark, d), 3).where("district = 2")
    return ops.semi(electorate.units(spark, d).select("precinct_id", "county"), chosen)


@q(""" SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'd' ELSE '' END || concat_ws(',', a, b) AS kept FROM (SELECT event_id, event_id % 5 AS a, NULLIF(event_id % 7, event_id % 5) AS b FROM events)""", base=False)
def requested_draws(spark, d):  # ORD6: the first mention counts, what is no number is skipped
    e = F.col("event_id")
    text = F.concat_ws(",", (e % 5).cast("string"), F.lit("x"), F.concat(F.lit(" "), (e % 7).cast("string")), F.concat((e % 5).cast("string"), F.lit(" ")))
    kept = F.concat_ws(",", F.transform(keys.draw_list(text), lambda x: x.cast("string")))
    return table(spark, d, "events").select("event_id", F.concat(F.when(e % 3 == 0, "d").otherwise(""), kept).alias("kept"))


@q(" SELECT c_custkey::VARCHAR AS precinct_id, t.draw::INTEGER AS draw, t.chain::INTEGER AS chain, (1 + (c_custkey * t.draw) % (2 + c_nationkey % 3))::INTEGER AS district FROM customer, (VALUES (4, 1), (9, 2), (10, 2)) t(draw, chain)", base=False)
def column_ensemble(spark, d):  # PIV5: a label column a draw
    k, nd = F.col("c_custkey"), F.lit(2) + F.col("c_nationkey") % 3
    draws = [4, 9, 10]
    units = table(spark, d, "customer").select(k.cast("string").alias("precinct_id"), *((1 + (k * n) % nd).cast("int").alias(f"plan_{n}") for n in draws))
    return ensembles.from_label_columns(units, [f"plan_{n}" for n in draws], draws, [1, 2, 2])


@q(""" , el AS (SELECT 6378137.0::DOUBLE AS a, (1 / 298.257223563::DOUBLE) / (2 - 1 / 298.257223563::DOUBLE) AS n),
  co AS (SELECT 2 * sqrt(n) / (1 + n) AS ec, 0.9996::DOUBLE * a / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS rad, [n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440, 61 * n ** 3 / 240 - 103 * n ** 4 / 140, 49561 * n ** 4 / 161280] AS al FROM el),
  ll AS (SELECT precinct_id, radians(46 + i % 5 / 2.0::DOUBLE) AS lat, radians(1 + x / 2) AS lon FROM grid),
  t1 AS (SELECT *, sinh(atanh(sin(lat)) - ec * atanh(ec * sin(lat))) AS t FROM ll, co),
  t2 AS (SELECT *, atan2(t, cos(lon)) AS xi, atanh(sin(lon) / sqrt(1 + t * t)) AS eta FROM t1)
  SELECT precinct_id, round(500000 + rad * (eta + al[1] * cos(2 * xi) * sinh(2 * eta) + al[2] * cos(4 * xi) * sinh(4 * eta) + al[3] * cos(6 * xi) * sinh(6 * eta) + al[4] * cos(8 * xi) * sinh(8 * eta)), 3) AS east,
  round(rad * (xi + al[1] * sin(2 * xi) * cosh(2 * eta) + al[2] * sin(4 * xi) * cosh(4 * eta) + al[3] * sin(6 * xi) * cosh(6 * eta) + al[4] * sin(8 * xi) * cosh(8 * eta)), 3) AS north FROM t2""")
def projected_points(spark, d):  # GEO4
    at = F.struct((16 + F.col("x") / 2).alias("x"), (46 + F.col("i") % 5 / 2.0).alias("y"))
    g = electorate.grid(spark, d).withColumn("i", (F.col("y") * 8 + F.col("x")).cast("bigint"))
    p = rings.utm(at)
    return g.select("precinct_id", r(p["x"], 3).alias("east"), r(p["y"], 3).alias("north"))


@q(" SELECT precinct_id, round(16 + x / 2, 9) AS lon, round(46 + i % 5 / 2.0::DOUBLE, 9) AS lat FROM grid")
def unprojected_points(spark, d):  # GEO4: to metres and back
    at = F.struct((16 + F.col("x") / 2).alias("x"), (46 + F.col("i") % 5 / 2.0).alias("y"))
    g = electorate.grid(spark, d).withColumn("i", (F.col("y") * 8 + F.col("x")).cast("bigint"))
    p = rings.lonlat(rings.utm(at))
    return g.select("precinct_id", r(p["x"], 9).alias("lon"), r(p["y"], 9).alias("lat"))


@q(" SELECT n_name AS stem, CASE WHEN n_nationkey % 4 = 0 THEN 'N-' || n_nationkey ELSE n_name END AS new_stem, n_nationkey % 4 = 0 AS changed FROM nation", base=False)
def realigned_stems(spark, d):  # SNK13
    n = table(spark, d, "nation")
    mapping = n.where("n_nationkey % 4 = 0").select(F.col("n_name").alias("old"), F.concat(F.lit("N-"), F.col("n_nationkey").cast("string")).alias("new"))
    return sinks.realigned(n.select(F.col("n_name").alias("stem")), mapping)
