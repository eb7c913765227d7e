"""Units, sources, sinks, ensembles, graphs, geometry on tiny tables."""

import json
import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from drawscope.functions import keys, rings
from drawscope.operators import dissolve, ensembles, graph, quality, shapes
from drawscope.operators import units as ops
from drawscope.operators.components import components
from drawscope.operators.units import ContractError
from drawscope.plans import generate
from drawscope.sources import geoparquet, settlements, sinks, stored


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.fixture
def folder():
    return f"/tmp/checkpoints/test-{uuid.uuid4().hex}"


def test_codes(spark):
    f = lambda s, w: one(spark, keys.zero_filled(F.lit(s), w))
    assert [f("1", 2), f("12345", 3), f("x1", 4), f(" 7 ", 3)] == ["01", "12345", "x1", "007"]
    assert one(spark, keys.unit_id(F.lit("1"), F.lit("2"), F.lit("3"))) == "01-002-003"
    assert [one(spark, keys.optional_int(F.lit(s))) for s in ("5", " ", "x", None)] == [5, None, None, None]
    assert [one(spark, keys.safe_float(F.lit(s))) for s in ("1.5", "nan", "inf", "x", None)] == [1.5, None, None, None, None]
    assert one(spark, keys.compact_label(F.lit(" Bloc A (x) "))) == "Bloc A"
    assert [one(spark, keys.county_label(F.lit(s))) for s in ("1", "99")] == ["Budapest", "maz 99"]
    assert one(spark, keys.percentage_points(F.lit(0.0123))) == "+1.2 pp"
    assert one(spark, keys.column_draw(F.lit("d000012"))) == 12 and one(spark, keys.column_draw(F.lit("x"))) is None
    assert one(spark, keys.draw_list(F.lit("3, 1,3,x"))) == [3, 1]
    assert one(spark, keys.district_key(F.lit(None))) == keys.MISSING


def test_points_and_rings(spark):
    p = one(spark, rings.point_of(F.lit("47.5 19.0")))
    assert (p.x, p.y) == (19.0, 47.5) and one(spark, rings.point_of(F.lit("x y"))) is None
    ring = one(spark, rings.ring_of(F.lit("0 0,0 1,bad,1 1")))
    assert [(q.x, q.y) for q in ring] == [(0, 0), (1, 0), (1, 1), (0, 0)]
    assert one(spark, rings.ring_of(F.lit("0 0,1 1"))) is None


def square(x, y, w, h=None):
    return [[[{"x": a, "y": b} for a, b in ((x, y), (x + w, y), (x + w, y + (h or w)), (x, y + (h or w)), (x, y))]]]


def layer(spark, rows, county="c"):
    return spark.createDataFrame([(county, u, s) for u, s in rows], f"county string, precinct_id string, shape {rings.SHAPE}")


def test_measures(spark):
    holed = square(0.0, 0.0, 4.0)
    holed[0].append(square(1.0, 1.0, 1.0)[0][0])
    m = quality.measured(layer(spark, [("a", holed), ("b", None)])).orderBy("precinct_id").collect()
    assert (m[0].area_m2, m[0].perimeter_m, m[0].n_polygon_parts, m[0].n_holes) == (15.0, 16.0, 1, 1)
    assert m[0].polsby_popper == pytest.approx(4 * math.pi * 15 / 256) and m[1].area_m2 is None


def test_projection(spark):
    at = lambda lon, lat: one(spark, rings.utm(F.struct(F.lit(lon).alias("x"), F.lit(lat).alias("y"))))
    assert (at(15.0, 0.0).x, at(15.0, 0.0).y) == pytest.approx((500000.0, 0.0), abs=1e-6)
    assert at(15.0, 45.0).y == pytest.approx(4982950.400, abs=0.01)
    assert at(18.0, 47.0).x - 500000 == pytest.approx(500000 - at(12.0, 47.0).x, abs=1e-6)


def test_repair_and_overlay(spark):
    bow = [[[{"x": float(a), "y": float(b)} for a, b in ((0, 0), (2, 2), (2, 0), (0, 2), (0, 0))]]]
    line = [[[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 0.0}]]]
    rows = {r.precinct_id: r for r in shapes.repair(layer(spark, [("bow", bow), ("ok", square(0.0, 0.0, 3.0)), ("line", line), ("none", None)])).collect()}
    assert rows["bow"].area_after == pytest.approx(2.0) and not rows["bow"].was_valid and len(rows["bow"].shape) == 2
    assert rows["ok"].was_valid and rows["line"].is_empty and rows["none"].is_empty
    s = quality.repair_statistics(spark.createDataFrame(list(rows.values()))).first()
    assert (s.n_invalid, s.n_empty, s.empty_ids) == (3, 2, ["line", "none"])


def test_overlaps_flags_and_hubs(spark):
    units = layer(spark, [("a", square(0.0, 0.0, 1.0)), ("b", square(0.5, 0.0, 1.0)), ("c", square(1.5, 0.0, 1.0)), ("far", square(50.0, 50.0, 1.0))])
    pairs = quality.box_pairs(units, ["county"])
    found = quality.overlap_pairs(pairs, shapes.intersection_area(F.col("s_a"), F.col("s_b")), ["county"], 0.1).collect()
    assert [(r.precinct_id_a, r.precinct_id_b, r.intersection_area_m2) for r in found] == [("a", "b", pytest.approx(0.5))]
    rows = quality.merged(quality.measured(units), quality.overlap_units(units, spark.createDataFrame(found)), check=True)
    flags = {r.precinct_id: (r.qa_severity, r.qa_reasons) for r in quality.flagged(rows, ["county"]).collect()}
    assert flags["a"] == ("warn", "overlap_partners>=1") and flags["far"] == ("ok", "")
    severe = quality.flagged(rows, ["county"], quality.Flags(severe_if_overlap_partners_ge=1, warn_polsby_below=0.9)).where("precinct_id = 'a'").first()
    assert (severe.qa_severity, severe.qa_reasons) == ("severe", "overlap_partners>=1; polsby_popper<0.9")
    assert quality.dropped_hubs(rows, quality.HubDrop(1, None)).count() == 2
    assert quality.dropped_hubs(rows, quality.HubDrop(None, 1, 0.5)).first().reason == "soft"
    assert quality.dropped_hubs(rows, quality.HubDrop(None, 0)).count() == 0
    with pytest.raises(ContractError):
        quality.dropped_hubs(rows, quality.HubDrop(1, None, max_drop_rows=1))
    assert quality.without_hubs(units, quality.dropped_hubs(rows, quality.HubDrop(1, None))).count() == 2


def test_fences_need_twenty_units(spark):
    rows = spark.createDataFrame([("c", f"u{i}", 1e12 if i == 0 else 100.0 + i, 0) for i in range(22)], "county string, precinct_id string, area_m2 double, n_overlap_partners int")
    assert quality.flagged(rows, ["county"]).where("qa_severity != 'ok'").first().qa_reasons == "log_area_tukey_far"
    assert quality.flagged(rows.limit(19), ["county"]).where("qa_severity != 'ok'").count() == 0


def test_contiguity_of_a_two_by_two_grid(spark):
    grid = layer(spark, [(u, square(float(x), float(y), 1.0)) for u, x, y in (("d", 0, 0), ("c", 1, 0), ("b", 0, 1), ("a", 1, 1))])
    assert graph.contiguity(grid).count() == 6 and graph.contiguity(grid, "rook").count() == 4
    near = layer(spark, [("a", square(0.0, 0.0, 1.0)), ("b", square(1.05, 0.0, 1.0))])
    assert graph.contiguity(near).count() == 0
    assert shapes.fuzzy_contiguity(quality.box_pairs(near, ["county"], grow=0.03), 0.03, ["county"]).count() == 1


@pytest.mark.parametrize("name", [lambda i: i, lambda i: f"{'é' * (i % 3)}{i}"])
def test_components_in_one_task_and_by_rounds(spark, name):
    chance = random.Random(5)
    ends = [(name(chance.randrange(400)), name(chance.randrange(400))) for _ in range(260)] + [(name(7), name(7)), (name(7), None)]
    e = spark.createDataFrame(ends, "src long, dst long" if name(0) == 0 else "src string, dst string")
    reach = {}
    for x, y in ends:
        if y is not None and x != y:
            reach.setdefault(x, set()).add(y)
            reach.setdefault(y, set()).add(x)
    want = {}
    for start in sorted(reach, key=lambda v: v if isinstance(v, int) else v.encode()):
        todo = [start]
        while todo:
            node = todo.pop()
            if node not in want:
                want[node] = start
                todo += reach[node]
    for n in (0, 1 << 18):
        assert {r.node: r.component for r in components(e, one_task=n).collect()} == want
    assert components(e.where("src is null")).count() == 0


def test_components_patches_and_health(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("x", "y"), ("q", "q"), (None, "a")], "src string, dst string")
    n = spark.createDataFrame([("k", u) for u in "abcxyz"], "county string, precinct_id string")
    assert {r.node: r.component for r in components(e, nodes=n.select("precinct_id")).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}
    long = spark.createDataFrame([(i, i + 1) for i in range(200)], "src long, dst long")
    assert {r.component for r in components(long).collect()} == {0}
    clean = graph.normal_edges(e.where("src is not null"))
    h = graph.health(n, clean).first()
    assert (h.n_components, h.n_islands, h.islands, h.ok) == (3, 1, ["z"], False)
    s = graph.summary(n, clean).first()
    assert (s.n_nodes, s.n_edges, s.n_components, s.largest_component, s.n_islands) == (6, 3, 3, 3, 1)
    pair = lambda *p: spark.createDataFrame(list(p), "src string, dst string")
    out, counts = graph.patch(clean, pair(("z", "a"), ("a", "b")), pair(("y", "x"), ("k", "l")))
    assert {(r.src, r.dst) for r in out.collect()} == {("a", "b"), ("b", "c"), ("a", "z")} and tuple(counts.first()) == (1, 1)
    at = n.withColumns({"cx": F.ascii("precinct_id").cast("double"), "cy": F.lit(0.0)})
    assert {(r.src, r.dst) for r in graph.bridges(at, clean).collect()} == {("c", "x"), ("c", "z")}
    assert {r.node: r.neighbours for r in graph.neighbour_lists(clean).collect()}["b"] == ["a", "c"]


def test_national_graph(spark):
    n = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c")], "county string, precinct_id string")
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert [(r.county_a, r.county_b) for r in graph.cross_pairs(e, n).collect()] == [("1", "2")]
    assert graph.national(e, n, touching=graph.cross_pairs(e, n).limit(0)).count() == 1


def test_voids_link_blocks_and_hexagons_keep_area(spark):
    shell = spark.createDataFrame([("01", square(0.0, 0.0, 1000.0))], f"county string, shape {rings.SHAPE}")
    units = layer(spark, [("a", square(0.0, 0.0, 300.0, 1000.0)), ("b", square(700.0, 0.0, 300.0, 1000.0))], "01")
    v = dissolve.voids(units, shell).collect()
    assert [round(r.area_m2) for r in v] == [400000]
    named = ops.numbered_voids(spark.createDataFrame(v)).first()
    assert named.precinct_id == "gap-01-0000"
    cells = dissolve.voids(units, shell, hexagons=True, mean_factor=0.05, part_factor=0.5, least=100.0, width=1.0).collect()
    assert len(cells) > 10 and sum(r.area_m2 for r in cells) == pytest.approx(400000, rel=0.02)
    c = dissolve.shell_coverage(units, shell).first()
    assert c.void_ratio == pytest.approx(0.4) and c.union_area == pytest.approx(600000)
    thin = shapes.from_rows(square(0.0, 0.0, 2000.0, 5.0))
    assert shapes.parted_voids([thin], 10_000.0, 1.0, 1.0, width=30.0)[0] == []
    big = shapes.from_rows(square(0.0, 0.0, 3000.0, 2000.0))
    parts, left_out, _ = shapes.parted_voids([big], 100_000.0, 1.0, 1.0)
    assert sum(map(shapes.area, parts)) == pytest.approx(6e6, rel=0.02) and left_out == 0
    assert shapes.parted_voids([big], 100_000.0, 1.0, 1.0, most=5)[1] > 0


def test_hexagon_sizes(spark):
    assert one(spark, rings.hexagon_cell_area(F.lit(20_000.0))) == 30_000.0 and one(spark, rings.hexagon_cell_area(F.lit(1.0))) == 10_000.0
    assert one(spark, rings.hexagon_cell_area(F.lit(-1.0))) is None and one(spark, rings.hexagon_cell_area(F.lit(1.0), override=1e9)) == 5_000_000.0
    assert one(spark, rings.hexagon_area(rings.hexagon_radius(F.lit(123.0)))) == pytest.approx(123.0)
    assert one(spark, rings.least_void_to_part(F.lit(20_000.0))) == 80_000.0


def tree(path, spark):
    at = path.replace("file://", "")
    docs = {"02/02-001": [{"maz": "2", "taz": "1", "szk": "1", "centrum": "46.0 18.0", "poligon": "46 18,46 19,47 19,47 18", "oevk_id": "1", "oevk_id_full": "02-01", "voters": 50, "listVotes": {"10": 5, "20": 7}}, {"maz": "2", "taz": "1", "szk": "2", "poligon": "1 1,2 2", "oevk_id_full": "", "voters": None, "listVotes": {"30": 1}}], "02/02-002": [{"maz": "2", "taz": "1", "szk": "1", "poligon": "", "oevk_id_full": "02-09", "listVotes": {}}]}
    from pathlib import Path

    for name, records in docs.items():
        p = Path(f"{at}/{name}.json")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(json.dumps({"header": {"generated": "g", "vl_id": 1, "nvv_id": 2}, "list": records}))
    return settlements.documents(spark, at)


def test_settlement_documents(spark, folder):
    docs = tree(folder, spark)
    recs = settlements.records(docs)
    assert settlements.record_total(docs).first().n_records == 3 and settlements.repeated(recs).first().n_duplicates == 1
    lists = settlements.ListMap.parse({"election_year": "2022", "lists": {"10": {"column": "votes_list_10", "label_hu": "x"}, "20": "votes_list_20"}})
    votes, focal = settlements.electoral_tables(recs, lists)
    rows = {r.precinct_id: r for r in votes.collect()}
    assert rows["02-001-001"].votes_list_20 == 7 and rows["02-001-002"].voters is None and rows["02-001-002"].votes_list_10 is None
    assert votes.columns[-2:] == ["votes_list_20", "voters"] or votes.columns[-1] == "votes_list_20" or "votes_list_10" in votes.columns
    assert [tuple(r) for r in focal.collect()] == [("02-001-001", "02-01", "1", "2")]
    with pytest.raises(ContractError, match="30"):
        settlements.electoral_tables(recs, lists, strict=True)
    assert [r.precinct_id for r in settlements.unit_layer(recs).collect()] == ["02-001-001"]
    for wrong in ({}, {"lists": {}}, {"lists": {"1": {}}}, {"lists": {"1": " "}}):
        with pytest.raises(ContractError):
            settlements.ListMap.parse(wrong)
    clash = settlements.ListMap.parse({"lists": {"10": "v", "20": "v"}})
    with pytest.raises(ContractError, match="share a column"):
        settlements.electoral_tables(recs, clash)


def test_joins_and_contracts(spark):
    units = spark.createDataFrame([("a", "szvk", "1"), ("g", "void", "1")], "precinct_id string, unit_kind string, maz string")
    votes = spark.createDataFrame([("a", "9", 5, 3), ("g", "9", 6, 4)], "precinct_id string, maz string, voters bigint, votes_x bigint")
    rows = {r.precinct_id: r for r in ops.join_votes(units, votes).collect()}
    assert rows["a"].voters == 5 and rows["a"].maz == "1" and rows["g"].voters is None and rows["g"].votes_x is None
    assert {r.voters for r in ops.voters_filled(ops.join_votes(units, votes)).collect()} == {5, 0}
    with pytest.raises(ContractError):
        ops.with_voids(units, units)
    focal = spark.createDataFrame([("a", "x")], "precinct_id string, oevk_id_full string")
    assert ops.with_enacted(units, focal).count() == 2
    with pytest.raises(ContractError, match="without"):
        ops.with_enacted(units, focal.limit(0))
    with pytest.raises(ContractError, match="repeats"):
        ops.with_enacted(units, focal.unionByName(focal))
    with pytest.raises(ContractError):
        ops.with_draw(units, spark.createDataFrame([("a", 1)], "precinct_id string, district int"))
    with pytest.raises(ContractError, match="missing column.*crs"):
        ops.validate(units, geometry="shape", expected_crs="EPSG:4326")
    with pytest.raises(ContractError, match="repeated"):
        ops.validate(units.unionByName(units))
    ops.validate(units)
    with pytest.raises(ContractError):
        ops.county_sequence(units, only="1", exclude=["01"])
    assert ops.official(units.drop("unit_kind")).count() == 2 and ops.official(units).count() == 1


def test_ensemble_layouts_and_storage(spark, folder):
    e = ensembles.from_columns(spark, ["a", "b"], [[1, 2], [2, 1], [1, 1]], draw_ids=[5, 6, 7], chains=[1, 1, 2])
    assert e.count() == 6 and ensembles.completeness(e).first().complete
    sinks.write_ensemble(e, f"{folder}/long")
    sinks.write_ensemble(e.select("precinct_id", "draw", "district"), f"{folder}/wide", layout="wide")
    want = {(r.precinct_id, r.draw, r.district) for r in e.collect()}
    for layout in ("long", "wide"):
        assert {(r.precinct_id, r.draw, r.district) for r in stored.ensemble(spark, f"{folder}/{layout}", check=True).collect()} == want
        assert stored.verify(spark, f"{folder}/{layout}") == []
    meta = stored.read_manifest(spark, f"{folder}/long")
    assert (meta["n_units"], meta["n_draws"], meta["draw_ids"], meta["chain_per_draw"]) == (2, 3, [5, 6, 7], [1, 1, 2])
    e.where("draw > 5").write.mode("overwrite").parquet(f"{folder}/long/assignments")
    assert stored.verify(spark, f"{folder}/long") == ["n_draws", "sha256"]
    e.write.mode("overwrite").parquet(f"{folder}/long/assignments")
    assert ensembles.single_draw(stored.ensemble(spark, f"{folder}/long"), 6).count() == 2
    assert {(r.draw, r.chain) for r in ensembles.first_chain(e).collect()} == {(5, 1), (6, 1), (7, 2)}
    with pytest.raises(ContractError):
        ensembles.to_wide(e, list(range(1025)))
    with pytest.raises(ContractError):
        ensembles.from_columns(spark, ["a", "a"], [[1, 2]])
    with pytest.raises(ContractError):
        ensembles.from_columns(spark, ["a", "b"], [[1]])
    with pytest.raises(ContractError):
        ensembles.require_complete(e.where("not (draw = 5 and precinct_id = 'a')"))
    spark.createDataFrame([(0, 1, 1, 2), (1, 1, 1, 1), (0, 2, 2, 1), (2, 2, 2, 1)], "unit_index int, draw int, chain int, district int").coalesce(1).write.option("header", True).csv(f"{folder}/csv")
    rows = stored.sampler_csv(spark, f"{folder}/csv")
    assert {r.draw: r.ok for r in ensembles.index_contract(rows).collect()} == {1: True, 2: False}


def test_sinks(spark, folder):
    units = layer(spark, [("a", square(0.0, 0.0, 2.0)), ("b", None)])
    geoparquet.write(units, f"{folder}/geo")
    assert {r.precinct_id: r.shape for r in geoparquet.read(spark, f"{folder}/geo").collect()} == {r.precinct_id: r.shape for r in units.collect()}
    assert json.loads(sinks.geojson_rows(units.limit(1)).first().value)["geometry"]["coordinates"][0][0][1] == [2.0, 0.0]
    nested = spark.createDataFrame([(float("nan"), [1.0, float("inf")], {"k": float("-inf")}, "s")], "a double, b array<double>, c map<string,double>, d string")
    sinks.write_json_rows(nested, f"{folder}/json", ["d"])
    assert json.loads(spark.read.text(f"{folder}/json").first().value) == {"a": None, "b": [1.0, None], "c": {"k": None}}
    sinks.write_edges(spark.createDataFrame([("b", "a"), ("a", "b")], "src string, dst string"), f"{folder}/edges")
    assert [tuple(r) for r in stored.edges(spark, f"{folder}/edges/edges").collect()] == [("a", "b")]
    assert len(sinks.fingerprint(spark, f"{folder}/edges/edges", "*.parquet")) == 64
    assert sinks.run_manifest(["etl"], {"x": "y"}, ["a"])["stages"] == ["etl"]
    moved = sinks.realigned(spark.createDataFrame([("01",), ("02",)], "stem string"), spark.createDataFrame([("01", "05")], "old string, new string"))
    assert {(r.stem, r.new_stem, r.changed) for r in moved.collect()} == {("01", "05", True), ("02", "02", False)}


def test_shells_from_geojson(spark, folder):
    from pathlib import Path

    Path(folder).mkdir(parents=True)
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    for name, ksh, kind, coordinates in (("1", "01", "Polygon", [ring]), ("02", None, "MultiPolygon", [[ring]])):
        Path(f"{folder}/{name}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"ksh": ksh} if ksh else {}, "geometry": {"type": kind, "coordinates": coordinates}}]}))
    rows = {r.county: r.shape for r in stored.shells(spark, folder).collect()}
    assert set(rows) == {"01", "02"} and rows["01"] == rows["02"]


def test_generated_plans_are_whole_and_seeded(spark):
    grid = layer(spark, [(f"u{i:02d}", square(float(i % 4), float(i // 4), 1.0)) for i in range(16)]).withColumn("population", F.lit(1))
    edges = graph.contiguity(grid, "rook", ["county"])
    nd = spark.createDataFrame([("c", 3)], "county string, ndists int")
    plans = generate.generate(grid, edges, nd, 3, seed=1)
    first = sorted(map(tuple, plans.collect()))
    assert first == sorted(map(tuple, generate.generate(grid, edges, nd, 3, seed=1).collect()))
    assert graph.district_components(plans, edges.select("src", "dst")).where("n_pieces > 1").count() == 0
    assert plans.select("draw", "district").distinct().count() == 9


def test_streaming_draws(spark, folder):
    from drawscope.streaming.arriving import measured_draws

    units = spark.createDataFrame([("c", "a", 3.0, 1.0), ("c", "b", 1.0, 2.0)], "county string, precinct_id string, votes_a double, votes_b double")
    rows = spark.createDataFrame([("c", n, 1, u, d) for n in (1, 2) for u, d in (("a", 1), ("b", n))], "county string, draw int, chain int, precinct_id string, district int")
    for n in (1, 2):
        rows.where(F.col("draw") == n).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        measured_draws(spark, f"{folder}/in", units, f"{folder}/out", f"{folder}/check").awaitTermination(60)
    got = spark.read.parquet(f"{folder}/out")
    assert {(r.draw, r.batch) for r in got.collect()} == {(1, 0), (2, 1)}
