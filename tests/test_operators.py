"""Operators on a small hand-made world with known answers."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from waymark.functions.geometry import PARTS_TYPE
from waymark.operators import buildings, divisions, land_use, places, roads
from waymark.plans.radius import RadiusOptions
from waymark.sources import manifest
from waymark.sources.layers import (
    SCHEMAS, cluster, layer_path, normalise_geometry, scan_layer,
)
from waymark.sources.taxonomy import load_taxonomy
from workload.geometry_bytes import encode

LAT, LNG = 52.3676, 4.9041
POINTS = "query_id int, lat double, lng double, radius_m int"


def north(metres: float) -> float:
    return LAT + metres / 111_266


def raw(spark, name, rows, geometry):
    """A raw layer: ``rows`` are dicts, ``geometry`` gives type and parts of each."""
    shaped = []
    for row in rows:
        kind, parts = geometry(row)
        xs = [x for poly in parts for ring in poly for x, _ in ring]
        ys = [y for poly in parts for ring in poly for _, y in ring]
        box = {"xmin": min(xs), "xmax": max(xs), "ymin": min(ys), "ymax": max(ys)}
        nested = [[[{"x": x, "y": y} for x, y in r] for r in p] for p in parts]
        shaped.append({**row, "bbox": box, "geom_type": kind, "parts": nested})
    ddl = SCHEMAS[name].replace("geometry binary", f"geom_type string, parts {PARTS_TYPE}")
    names = spark.createDataFrame([], ddl).columns
    data = [tuple(row.get(n) for n in names) for row in shaped]
    return encode(spark.createDataFrame(data, ddl))


def place(i, metres, category="cafe", **extra):
    return {"id": f"p{i}", "metres": metres, "categories": {"primary": category, "alternate": None}, **extra}


@pytest.fixture(scope="module")
def cafes(spark):
    rows = [place(i, 95 + 45 * i) for i in range(9)]  # 95 .. 455
    rows += [
        place(9, 495, operating_status="permanently_closed"),
        place(10, 505),
        place(11, 60, "bank", names={"primary": "Bank"}, phones=["1", "2"], websites=[],
              brand={"names": {"primary": "B"}, "wikidata": ""},
              addresses=[{"freeform": "", "locality": "Town", "postcode": None, "region": "", "country": "NL"}]),
    ]
    rows[3]["operating_status"] = "temporarily_closed"
    return normalise_geometry(
        raw(spark, "place", rows, lambda r: ("POINT", [[[(LNG, north(r["metres"]))]]]))
    ).cache()


def test_known_places(spark, cafes):
    taxonomy = load_taxonomy(spark)
    points = spark.createDataFrame(
        [(1, LAT, LNG, 500, "cafe", None), (2, LAT, LNG, 500, "cafe", "yes"), (3, 0.0, 0.0, 500, "cafe", None),
         (4, LAT, LNG, 500, "bank", None), (5, LAT, LNG, 500, "cafe", None), (6, LAT, LNG, 500, "nonsense", None)],
        POINTS + ", category string, include_closed string",
    )
    counts = places.count_places_by_type_in_radius(points, cafes, taxonomy)
    got = {r.query_id: r for r in counts.collect()}
    assert {i: r["count"] for i, r in got.items()} == {1: 9, 2: 10, 3: 0, 4: 1, 5: 9}
    assert got[3].suggestion.startswith("Zero cafe found within 500m.")
    assert got[1].suggestion is None

    listed = places.places_in_radius(points.withColumn("limit", F.lit(3)), cafes, taxonomy)
    listed = listed.orderBy("query_id", "rank").collect()
    assert [r.distance_m for r in listed if r.query_id == 1] == [95, 140, 185]
    assert [r["rank"] for r in listed if r.query_id == 5] == [1, 2, 3]
    assert [r.suggestion is not None for r in listed if r.query_id == 3] == [True]

    best = places.nearest_place_of_type(points, cafes, taxonomy).collect()
    bank = next(r for r in best if r.query_id == 4)
    assert (bank.name, bank.phone, bank.website) == ("Bank", "1", None)
    assert bank.address == "Town, NL" and bank.brand.name == "B" and bank.brand.wikidata is None
    assert next(r for r in best if r.query_id == 1).distance_m == 95


def test_null_and_repeated_ids_keep_their_places(spark, cafes):
    taxonomy = load_taxonomy(spark)
    points = spark.createDataFrame([(1, LAT, LNG, 500, "cafe", 100)], POINTS + ", category string, limit int")
    twice = cafes.union(cafes.withColumn("id", F.lit(None).cast("string")))
    for layer in (cafes.union(cafes), twice):
        assert places.places_in_radius(points, layer, taxonomy).count() == 18


def test_many_sites_give_the_same_places(spark, cafes):
    taxonomy = load_taxonomy(spark)
    points = spark.createDataFrame([(i, LAT, LNG, 60 + i * 20, "cafe") for i in range(24)], POINTS + ", category string")
    many = RadiusOptions(broadcast_site_cells=0, rows_per_task=2)
    for operator in (places.places_in_radius, places.count_places_by_type_in_radius):
        few = operator(points, cafes, taxonomy)
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, operator(points, cafes, taxonomy, many).collect()))


def test_catalogue_takes_text_literally(spark):
    searches = spark.createDataFrame([(1, "COFFEE"), (2, "%"), (3, " "), (4, None)], "query_id int, query string")
    rows = places.category_catalog(searches, load_taxonomy(spark), limit=50).orderBy("query_id", "rank").collect()
    by_query = {i: [r.category for r in rows if r.query_id == i] for i in (1, 2, 3, 4)}
    assert by_query[1][:3] == ["cafe", "coffee_shop", "coffee_roaster"]
    assert by_query[2] == [None]
    assert len(by_query[3]) == len(by_query[4]) == 50 and by_query[3][0] == "restaurant"
    every = places.category_catalog(searches, load_taxonomy(spark)).filter("query_id = 3").count()
    assert every == load_taxonomy(spark).count()


def square(x, y, s):
    return [(x - s, y - s), (x + s, y - s), (x + s, y + s), (x - s, y + s), (x - s, y - s)]


def test_corner_prefilter_can_lose_a_building(spark):
    # centroid 40 m north; the corner of its large box lies south-west of the search box
    rows = [{"id": "big", "class": None}, {"id": "small", "class": "residential"}]
    sizes = {"big": 0.002, "small": 0.0001}
    layer = normalise_geometry(
        raw(spark, "building", rows, lambda r: ("POLYGON", [[square(LNG, north(40), sizes[r["id"]])]]))
    )
    points = spark.createDataFrame([(1, LAT, LNG, 50)], POINTS)
    assert buildings.building_count_in_radius(points, layer, RadiusOptions("corner")).first()["count"] == 1
    whole = RadiusOptions(prefilter="none")
    assert buildings.building_count_in_radius(points, layer, whole).first()["count"] == 2
    shares = buildings.building_class_composition(points, layer, whole).collect()
    assert {(r["class"], r.percentage, r.total_buildings) for r in shares} == {("unknown", 50.0, 2), ("residential", 50.0, 2)}


def test_divisions(spark):
    def area(i, subtype, size, kind="land"):
        return {"id": i, "names": {"primary": i.upper()}, "subtype": subtype, "class": kind, "s": size}

    rows = [area("c", "country", 3), area("l1", "locality", 0.1), area("r", "region", 1),
            area("l2", "locality", 0.2), area("m", "country", 2, "maritime"), area("q", "quarter", 0.3)]
    layer = normalise_geometry(raw(spark, "division_area", rows, lambda r: ("POLYGON", [[square(LNG, LAT, r["s"])]])))
    points = spark.createDataFrame([(1, LAT, LNG), (2, 0.0, 0.0), (3, LAT, LNG + 3), (4, LAT, 500.0)], "query_id int, lat double, lng double")
    got = {r.query_id: r for r in divisions.point_in_admin_boundary(points, layer).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].country, got[1].region, got[1].locality) == ("C", "R", "L2")
    assert [(d.level, d.name) for d in got[1].admin_levels] == [(2, "C"), (4, "R"), (8, "L1"), (8, "L2"), (99, "Q")]
    for i in (2, 3):  # at sea, and exactly on the border
        assert got[i].admin_levels is None and got[i].suggestion.startswith("No administrative")


def test_roads(spark):
    def road(i, metres, **extra):
        return {"id": f"r{i}", "metres": metres, "subtype": "road", "class": "primary", **extra}

    rows = [
        road(1, 10, subtype="rail"),
        road(2, 30, road_surface=[], road_flags=[{"values": None}, {"values": ["is_bridge"]}]),
        road(3, 30, road_surface=[{"value": "gravel"}, {"value": "sand"}]),
        road(4, 60, road_surface=[{"value": None}], **{"class": None}),
    ]
    for r in rows:
        r["road_flags"] = [{**f, "between": None} for f in r.get("road_flags", [])] or None
        if "road_surface" in r:
            r["road_surface"] = [{**s, "between": None} for s in r["road_surface"]]
    def line(r):
        return "LINESTRING", [[[(LNG - 0.001, LAT), (LNG, north(r["metres"])), (LNG + 0.0011, LAT)]]]
    layer = normalise_geometry(raw(spark, "segment", rows, line))
    points = spark.createDataFrame([(1, LAT, LNG, 500, " PRIMARY ", True)], POINTS + ", road_class string, include_geometry boolean")
    best = roads.nearest_road_of_class(points, layer).first()
    assert (best.id, best.distance_m, best.road_surface) == ("r2", 30, None)  # tie goes to the smaller id
    assert (best.is_bridge, best.is_tunnel, best.is_link) == (True, False, False)
    assert best.geometry.startswith("LINESTRING (4.90") and "52.3676, 4.9041 52.367" in best.geometry
    kinds = {r.road_class: r["count"] for r in roads.road_count_by_class(points, layer).collect()}
    assert kinds == {"primary": 2, "unknown": 1}
    surfaces = {r.surface: r["count"] for r in roads.road_surface_composition(points, layer).collect()}
    assert surfaces == {"unknown": 2, "gravel": 1}


def test_land_use_geometry_cap(spark):
    def ring(n, size):
        turns = [2 * math.pi * i / n for i in range(n)]
        pts = [(LNG + size * math.cos(t), LAT + size * math.sin(t)) for t in turns]
        return [*pts, pts[0]]
    rows = [{"id": "a", "subtype": "park", "n": 6}, {"id": "b", "subtype": "park", "n": 600}, {"id": "c", "subtype": None, "n": 6}]
    layer = normalise_geometry(raw(spark, "land_use", rows, lambda r: ("POLYGON", [[ring(r["n"], 0.001)]])))
    points = spark.createDataFrame([(1, LAT, LNG, 900, "Park", "1")], POINTS + ", subtype string, include_geometry string")
    found = {r.id: r for r in land_use.land_use_search(points, layer).collect()}
    assert found["a"].geometry and not found["a"].geometry_note
    assert not found["b"].geometry and found["b"].geometry_note
    assert {r.id for r in land_use.land_use_at_point(points, layer).collect()} == {"a", "b", "c"}
    shares = {r.subtype: (r["count"], r.percentage) for r in land_use.land_use_composition(points, layer).collect()}
    assert shares == {"park": (2, 66.7), None: (1, 33.3)}


def test_written_layer_is_pruned(spark, cafes, tmp_path):
    rows = [{"id": f"b{i}", "class": "x", "x": -170 + 0.5 * i} for i in range(640)]
    layer = raw(spark, "building", rows, lambda r: ("POLYGON", [[square(r["x"], 10.0, 0.001)]]))
    root = str(tmp_path)
    path = layer_path(root, "v1", "building")
    cluster(normalise_geometry(layer).join(layer.select("id", "geometry"), "id"), 16).write.parquet(path)
    stored = scan_layer(spark, "building", root=root, version="v1")
    assert {"theme", "type"} <= set(stored.columns) and stored.count() == 640
    files = manifest.build_manifest(stored, "building").cache()
    assert files.count() == 16
    points = spark.createDataFrame([(1, 10.0, 0.0, 20_000), (2, 10.0, 0.5, 20_000)], POINTS)
    near = manifest.prune_files_by_radius(files, points)
    assert 1 <= near.count() <= 2
    many = manifest.prune_files_by_radius(files, points, broadcast_file_cells=0)
    assert sorted(near.collect()) == sorted(many.collect())
    read = manifest.scan_pruned(spark, "building", near, stored)
    prepared, everything = normalise_geometry(read), normalise_geometry(stored)
    want = [r["count"] for r in buildings.building_count_in_radius(points, everything).orderBy("query_id").collect()]
    got = [r["count"] for r in buildings.building_count_in_radius(points, prepared).orderBy("query_id").collect()]
    assert got == want == [1, 1]
    nowhere = spark.createDataFrame([(1, -80.0, 0.0, 10)], POINTS)
    assert manifest.scan_pruned(spark, "building", manifest.prune_files_by_point(files, nowhere), stored) is stored


def test_envelope_reaches_the_scan(spark, cafes, tmp_path):
    cafes.write.parquet(f"{tmp_path}/p")
    points = spark.createDataFrame([(1, LAT, LNG, 500, "cafe")], POINTS + ", category string")
    spark.conf.set("spark.sql.maxMetadataStringLength", 100_000)
    for prefilter, x, y in (("corner", "bbox.xmin", "bbox.ymin"), ("none", "rep_x", "rep_y")):
        options = RadiusOptions(prefilter)
        df = places.count_places_by_type_in_radius(points, spark.read.parquet(f"{tmp_path}/p"), load_taxonomy(spark), options)
        plan = df._jdf.queryExecution().executedPlan().toString()
        scan = next(l for l in plan.splitlines() if "FileScan parquet" in l and "rep_ex" in l)
        assert f"GreaterThanOrEqual({x}" in scan and f"LessThanOrEqual({y}" in scan
    assert "BroadcastHashJoin" in plan and "parts" not in scan.split("ReadSchema")[1]


def test_float_boxes_and_missing_columns(spark, tmp_path):
    """Releases store boxes as floats and lack some columns."""
    raw_file = str(tmp_path / "b")
    point = bytes.fromhex("0101000000") + struct.pack("<dd", LNG, LAT)
    ddl = "id string, geometry binary, bbox struct<xmin:float,xmax:float,ymin:float,ymax:float>"
    box = {"xmin": LNG, "xmax": LNG, "ymin": LAT, "ymax": LAT}
    spark.createDataFrame([("b", point, box)], ddl).write.parquet(raw_file)
    layer = normalise_geometry(scan_layer(spark, "building", source=raw_file))
    points = spark.createDataFrame([(1, LAT, LNG, 5)], POINTS)
    answer = buildings.building_class_composition(points, layer).first()
    assert (answer["class"], answer["count"]) == ("unknown", 1)
