"""Manifests from footers, and operators that open only the files they need."""

import os

import pytest
from pyspark.sql import functions as F

from waymark.operators import buildings, divisions, land_use, places, roads
from waymark.plans.radius import RadiusOptions
from waymark.sources import manifest
from waymark.sources.layers import normalise_geometry
from waymark.sources.taxonomy import load_taxonomy
from workload.layers import derive, layer

SMALL = "/root/testdata/sf0.001"
CITIES = {"amsterdam": (52.37, 4.9), "lima": (-12.05, -77.04), "osaka": (34.69, 135.5), "suva": (-18.14, 178.44)}


def boxes(spark, lat, lng, n=50):
    """Squares around a place, prepared."""
    step = F.col("id") / 20_000
    x, y = F.lit(lng) + step, F.lit(lat) + step
    corner = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    ring = F.array(corner(0, 0), corner(1e-4, 0), corner(1e-4, 1e-4), corner(0, 1e-4), corner(0, 0))
    box = F.struct(x.alias("xmin"), (x + 1e-4).alias("xmax"), y.alias("ymin"), (y + 1e-4).alias("ymax"))
    from waymark.sources.layers import with_representative

    return with_representative(
        spark.range(n).select(
            F.concat(F.lit(f"{lat}-"), F.col("id")).alias("id"), F.lit("house").alias("class"), box.alias("bbox"),
            F.lit("POLYGON").alias("geom_type"), F.array(F.array(ring)).alias("parts"),
        )
    )


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("world"))
    for name, place in CITIES.items():
        boxes(spark, *place).coalesce(1).write.parquet(f"{root}/{name}")
    return root


def test_two_points_on_two_continents_open_two_files(spark, world):
    files = manifest.refresh_manifest(manifest.list_files(spark, world), "building")
    assert files.count() == 4
    pruned = manifest.PrunedLayer.of(files, "building")
    points = spark.createDataFrame([(1, *CITIES["lima"], 500), (2, *CITIES["osaka"], 500), (3, 0.0, 0.0, 500)], "query_id int, lat double, lng double, radius_m int")
    everything = spark.read.option("recursiveFileLookup", True).parquet(world)
    for prefilter in ("corner", "none"):
        opened = pruned.around(points, prefilter).inputFiles()
        assert sorted(f.split("/")[-2] for f in opened) == ["lima", "osaka"]
        options = RadiusOptions(prefilter)
        got = buildings.building_count_in_radius(points, pruned, options)
        want = buildings.building_count_in_radius(points, everything, options)
        assert sorted(got.collect()) == sorted(want.collect())
        assert {r.query_id: r["count"] for r in got.collect()}[1] > 10
    only_sea = points.where("query_id = 3")
    assert pruned.around(only_sea, "none").count() == 0
    assert [r["count"] for r in buildings.building_count_in_radius(only_sea, pruned).collect()] == [0]


def test_a_search_box_over_the_date_line_opens_files_on_both_sides(spark, tmp_path):
    for name, lng in (("east", 179.99), ("west", -179.999), ("far", 170.0)):
        boxes(spark, 10.0, lng, 5).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    pruned = manifest.PrunedLayer.of(manifest.refresh_manifest(manifest.list_files(spark, str(tmp_path)), "b"), "b")
    site = spark.createDataFrame([(10.0, 179.999, 2000)], "lat double, lng double, radius_m int")
    assert sorted(f.split("/")[-2] for f in pruned.around(site, "none").inputFiles()) == ["east", "west"]


def test_only_new_files_are_opened(spark, tmp_path):
    root = str(tmp_path / "layer")
    for name in ("lima", "osaka"):
        boxes(spark, *CITIES[name]).coalesce(1).write.parquet(f"{root}/{name}")
    first = manifest.refresh_manifest(manifest.list_files(spark, root), "b")
    first = spark.createDataFrame(first.collect(), first.schema)
    # spoil what was read, without a trace in the listing: opening it again would fail
    for folder, _, names in os.walk(root):
        for name in names:
            path = os.path.join(folder, name)
            stat = os.stat(path)
            if path.endswith(".parquet"):
                with open(path, "wb") as file:
                    file.write(b"\0" * stat.st_size)
                os.utime(path, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    boxes(spark, *CITIES["suva"]).coalesce(1).write.parquet(f"{root}/suva")
    again = manifest.refresh_manifest(manifest.list_files(spark, root), "b", first)
    rows = {r.path.split("/")[-2]: r for r in again.collect()}
    assert set(rows) == {"lima", "osaka", "suva"} and all(r.features == 50 for r in rows.values())
    assert rows["suva"].xmin == pytest.approx(178.44) and rows["lima"].ymin == pytest.approx(-12.05)
    fewer = manifest.list_files(spark, root).where("path not like '%osaka%'")
    assert manifest.refresh_manifest(fewer, "b", again).count() == 2


def test_footers_say_what_a_scan_says(spark, world):
    by_footer = manifest.refresh_manifest(manifest.list_files(spark, world), "b").collect()
    read = spark.read.option("recursiveFileLookup", True).parquet(world)
    by_scan = {r.path: r for r in manifest.build_manifest(read, "b").collect()}
    for row in by_footer:
        other = by_scan[row.path.replace("file:///", "file:/")] if row.path not in by_scan else by_scan[row.path]
        assert (row.xmin, row.xmax, row.ymin, row.ymax, row.features) == (other.xmin, other.xmax, other.ymin, other.ymax, other.features)


def test_files_without_statistics_are_never_skipped(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    table = boxes(spark, *CITIES["lima"]).toArrow()
    os.makedirs(tmp_path / "a")
    pq.write_table(table, str(tmp_path / "a" / "x.parquet"), write_statistics=False)
    pq.write_table(table.slice(0, 0), str(tmp_path / "a" / "none.parquet"))
    files = manifest.refresh_manifest(manifest.list_files(spark, str(tmp_path)), "b")
    assert {r.path.split("/")[-1]: r.xmin for r in files.collect()} == {"x.parquet": None, "none.parquet": None}
    assert pa.__version__
    site = spark.createDataFrame([(50.0, 8.0, 10)], "lat double, lng double, radius_m int")
    assert len(manifest.PrunedLayer.of(files, "b").around(site, "corner").inputFiles()) == 2


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """All derived layers in files of a few hundred metres, pruned."""
    root = str(tmp_path_factory.mktemp("written"))
    found = {}
    for name in ("places", "buildings", "divisions", "roads", "land_use"):
        table = layer(spark, SMALL, name).withColumn("tile", F.floor(F.col("bbox.ymin") * 500))
        table.repartition(8, "tile").write.partitionBy("tile").parquet(f"{root}/{name}")
        files = manifest.refresh_manifest(manifest.list_files(spark, f"{root}/{name}"), name).cache()
        found[name] = manifest.PrunedLayer.of(files, name)
    return found


def test_answers_stay_the_same(spark, written):
    options = RadiusOptions()
    points = derive(spark, SMALL, "query_points").withColumn("include_geometry", F.lit(True)).cache()
    one = points.where("query_id = 1")
    taxonomy = load_taxonomy(spark)
    calls = {
        "places": [lambda p, x: places.places_in_radius(p, x, taxonomy, options), lambda p, x: places.nearest_place_of_type(p, x, taxonomy, options),
                   lambda p, x: places.count_places_by_type_in_radius(p, x, taxonomy, options)],
        "buildings": [lambda p, x: buildings.building_count_in_radius(p, x, options), lambda p, x: buildings.building_class_composition(p, x, options)],
        "roads": [lambda p, x: roads.road_count_by_class(p, x, options), lambda p, x: roads.road_surface_composition(p, x, options),
                  lambda p, x: roads.nearest_road_of_class(p, x, options)],
        "land_use": [lambda p, x: land_use.land_use_composition(p, x, options), lambda p, x: land_use.land_use_search(p, x, options),
                     lambda p, x: land_use.land_use_at_point(p, x)],
        "divisions": [lambda p, x: divisions.point_in_admin_boundary(p, x)],
    }
    for name, operators in calls.items():
        plain = layer(spark, SMALL, name).cache()
        for operator in operators:
            assert sorted(map(str, operator(points, written[name]).collect())) == sorted(map(str, operator(points, plain).collect()))
        files = written[name].manifest.count()
        near = written[name].around(one, "corner") if name != "divisions" else written[name].under(one)
        assert 0 < len(near.inputFiles()) < files


def test_normalised_layers_can_be_pruned_too(spark):
    raw = derive(spark, SMALL, "places").select("id", "bbox", "geom_type", "parts")
    from workload.geometry_bytes import encode

    assert "geometry_error" in normalise_geometry(encode(raw)).columns
