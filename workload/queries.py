"""One Spark query per operator, over layers derived from the driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geometry
from waymark.operators import buildings, divisions, land_use, places, profile, roads
from waymark.operators.screening import screen_points
from waymark.plans.contains import ContainsOptions
from waymark.plans.radius import RadiusOptions
from waymark.plans.saved import shared_folder
from waymark.sources import manifest
from waymark.sources.layers import layer_path, normalise_geometry, scan_layer
from waymark.sources.taxonomy import load_taxonomy
from workload.geometry_bytes import encode
from workload.layers import COLLECTIONS, VERSION, derive, layer, manifest_of, outlined_parcels, pruned, written

Query = Callable[[SparkSession, str], DataFrame]

#: The search as the answered calls make it, the release noted in every answer.
AS_ANSWERED = RadiusOptions(prefilter="corner", data_version=VERSION)
INSIDE = ContainsOptions(data_version=VERSION)


def _points(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    return derive(spark, sf, "query_points").select("query_id", "lat", "lng", *extra)


def places_in_radius(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf, "radius_m", "category", "limit", "include_closed")
    points = points.withColumn("include_geometry", F.lit("true"))
    answers = places.places_in_radius(
        points, layer(spark, sf, "places"), load_taxonomy(spark), AS_ANSWERED
    )
    return _flat_brand(answers)


def _flat_brand(answers: DataFrame) -> DataFrame:
    return answers.withColumns(
        {"brand_name": F.col("brand.name"), "brand_wikidata": F.col("brand.wikidata")}
    ).drop("brand")


def nearest_place_of_type(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf, "category")
    return _flat_brand(
        places.nearest_place_of_type(
            points, layer(spark, sf, "places"), load_taxonomy(spark), AS_ANSWERED
        )
    )


def count_places_by_type_in_radius(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf, "radius_m", "category", "include_closed")
    return places.count_places_by_type_in_radius(
        points, layer(spark, sf, "places"), load_taxonomy(spark), AS_ANSWERED
    )


def category_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return places.category_catalog(
        derive(spark, sf, "searches"),
        load_taxonomy(spark),
        derive(spark, sf, "places"),
        limit=50,
    )


def building_count_in_radius(spark: SparkSession, sf: str) -> DataFrame:
    return buildings.building_count_in_radius(
        _points(spark, sf, "radius_m"), layer(spark, sf, "buildings"), AS_ANSWERED
    )


def building_class_composition(spark: SparkSession, sf: str) -> DataFrame:
    return buildings.building_class_composition(
        _points(spark, sf, "radius_m"), layer(spark, sf, "buildings"), AS_ANSWERED
    )


def point_in_admin_boundary(spark: SparkSession, sf: str) -> DataFrame:
    answers = divisions.point_in_admin_boundary(
        _points(spark, sf), layer(spark, sf, "divisions"), INSIDE
    )
    chain = F.transform(
        "admin_levels",
        lambda d: F.concat_ws(":", d["level"].cast("string"), d["name"], d["type"]),
    )
    return answers.withColumn("admin_levels", F.array_join(chain, " > "))


def road_count_by_class(spark: SparkSession, sf: str) -> DataFrame:
    return roads.road_count_by_class(
        _points(spark, sf, "radius_m"), layer(spark, sf, "roads"), AS_ANSWERED
    )


def road_surface_composition(spark: SparkSession, sf: str) -> DataFrame:
    return roads.road_surface_composition(
        _points(spark, sf, "radius_m"), layer(spark, sf, "roads"), AS_ANSWERED
    )


def nearest_road_of_class(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf, "road_class").withColumn("include_geometry", F.lit(True))
    return roads.nearest_road_of_class(points, layer(spark, sf, "roads"), AS_ANSWERED)


def land_use_at_point(spark: SparkSession, sf: str) -> DataFrame:
    return land_use.land_use_at_point(
        _points(spark, sf), layer(spark, sf, "land_use"), INSIDE
    )


def land_use_composition(spark: SparkSession, sf: str) -> DataFrame:
    return land_use.land_use_composition(
        _points(spark, sf, "radius_m"), layer(spark, sf, "land_use"), AS_ANSWERED
    )


def land_use_search(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf, "radius_m", "subtype", "limit").withColumn(
        "include_geometry", F.lit("yes")
    )
    return land_use.land_use_search(points, layer(spark, sf, "land_use"), AS_ANSWERED)


def screening(spark: SparkSession, sf: str) -> DataFrame:
    return screen_points(
        derive(spark, sf, "raw_points"), "places_in_radius", load_taxonomy(spark)
    )


def _labelled(files: DataFrame) -> DataFrame:
    """Files by the tile they hold: their own names are new in every session."""
    tile = F.regexp_extract("path", "tile=(-?[0-9]+)", 1)
    return files.withColumn("path", F.concat_ws("/", "collection", tile))


def build_manifest(spark: SparkSession, sf: str) -> DataFrame:
    made = manifest_of(spark, sf, tuple(COLLECTIONS))
    return _labelled(made).drop("bytes", "modified")


def prune_files_by_radius(spark: SparkSession, sf: str) -> DataFrame:
    files = manifest_of(spark, sf, tuple(COLLECTIONS))
    return _labelled(manifest.prune_files_by_radius(files, _points(spark, sf, "radius_m")))


def prune_files_by_point(spark: SparkSession, sf: str) -> DataFrame:
    files = manifest_of(spark, sf, tuple(COLLECTIONS))
    return _labelled(manifest.prune_files_by_point(files, _points(spark, sf)))


def pruned_building_count(spark: SparkSession, sf: str) -> DataFrame:
    return buildings.building_count_in_radius(
        _points(spark, sf, "radius_m"), pruned(spark, sf, "building"), AS_ANSWERED
    )


def pruned_places_in_radius(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf, "radius_m", "category", "limit", "include_closed")
    points = points.withColumn("include_geometry", F.lit("true"))
    answers = places.places_in_radius(
        points, pruned(spark, sf, "place"), load_taxonomy(spark), AS_ANSWERED
    )
    return _flat_brand(answers)


def pruned_land_use_at_point(spark: SparkSession, sf: str) -> DataFrame:
    return land_use.land_use_at_point(
        _points(spark, sf), pruned(spark, sf, "land_use"), INSIDE
    )


def many_sites_building_count(spark: SparkSession, sf: str) -> DataFrame:
    """The plan for sites that are too many to broadcast."""
    options = RadiusOptions(prefilter="corner", broadcast_site_cells=0)
    return buildings.building_count_in_radius(
        _points(spark, sf, "radius_m"), layer(spark, sf, "buildings"), options
    )


def many_sites_nearest_road(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf, "road_class").withColumn("include_geometry", F.lit(True))
    options = RadiusOptions(prefilter="corner", broadcast_site_cells=0, data_version=VERSION)
    return roads.nearest_road_of_class(points, layer(spark, sf, "roads"), options)


def _across_the_date_line(spark: SparkSession, sf: str, prefilter: str) -> DataFrame:
    return buildings.building_count_in_radius(
        derive(spark, sf, "dateline_points"),
        layer(spark, sf, "dateline_buildings"),
        RadiusOptions(prefilter=prefilter),
    )


def dateline_building_count(spark: SparkSession, sf: str) -> DataFrame:
    """Distance alone decides."""
    return _across_the_date_line(spark, sf, "none")


def dateline_building_count_by_corner(spark: SparkSession, sf: str) -> DataFrame:
    """The corner of a box must lie in the search box, which ends at the date line."""
    return _across_the_date_line(spark, sf, "corner")


def land_use_of_large_parcels(spark: SparkSession, sf: str) -> DataFrame:
    return land_use.land_use_at_point(
        _points(spark, sf), outlined_parcels(spark, sf), INSIDE
    )


def _release(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """All written layers, read as a release."""
    return {
        c: scan_layer(spark, c, root=written(spark, sf, c), version=VERSION) for c in COLLECTIONS
    }


def _union(frames: list[DataFrame]) -> DataFrame:
    made = frames[0]
    for frame in frames[1:]:
        made = made.unionByName(frame)
    return made


def scan_release(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of a release with its partition columns and its geometry's size."""
    return _union(
        [
            raw.select("theme", "type", "id", "bbox.xmin", "bbox.ymax", F.octet_length("geometry").alias("bytes"))
            for raw in _release(spark, sf).values()
        ]
    )


def scan_sources(spark: SparkSession, sf: str) -> DataFrame:
    """One layer after the other from a path, a list of files, a view and a DataFrame."""
    frames = []
    for c, raw in _release(spark, sf).items():
        view = f"waymark_{c}_{uuid.uuid4().hex}"
        raw.createOrReplaceTempView(view)
        path = layer_path(written(spark, sf, c), VERSION, c)
        for kind, source in (("path", path), ("files", raw.inputFiles()), ("view", view), ("frame", raw)):
            rows = scan_layer(spark, c, source=source)
            frames.append(
                rows.agg(F.count("geometry").alias("features"), F.max("id").alias("last")).select(
                    F.lit(c).alias("layer"), F.lit(kind).alias("source"), "features", "last"
                )
            )
    return _union(frames)


def taxonomy_from_json(spark: SparkSession, sf: str) -> DataFrame:
    """A taxonomy written as one JSON array and read again."""
    kinds = derive(spark, sf, "kinds")
    entry = F.struct("category", "description")
    array = kinds.agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("value"))
    path = f"{shared_folder(spark)}/waymark-{uuid.uuid4().hex}"
    array.coalesce(1).write.text(path)
    return load_taxonomy(spark, path)


def _screened(operator: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return screen_points(derive(spark, sf, "raw_calls"), operator)

    return query


def broken_geometry(spark: SparkSession, sf: str) -> DataFrame:
    """Layers of which some rows have lost a byte, or gained one, or changed one."""
    k = F.expr("cast(substring(id, 2) as bigint)")
    size, data = F.octet_length("geometry"), F.col("geometry")
    cut = lambda at, n: F.substring(data, at, n)
    spoilt = (
        F.when(k % 7 == 0, F.substring(data, F.lit(1), size - 1))
        .when(k % 11 == 0, F.concat(cut(1, 1), F.unhex(F.lit("07")), F.substring(data, F.lit(3), size)))
        .when(k % 13 == 0, F.concat(F.unhex(F.lit("09")), F.substring(data, F.lit(2), size)))
        .when(k % 17 == 0, F.concat(data, F.unhex(F.lit("00"))))
        .when(k % 19 == 0, F.unhex(F.lit("")))
        .otherwise(data)
    )
    frames = []
    for name in COLLECTIONS.values():
        raw = encode(derive(spark, sf, name).select("id", "geom_type", "parts"))
        prepared = normalise_geometry(raw.withColumn("geometry", spoilt))
        frames.append(
            prepared.select(
                F.lit(name).alias("layer"), "id", "geometry_error", "geom_type", "n_edges",
                F.bround("rep_x", 7).alias("rep_x"), F.bround("rep_y", 7).alias("rep_y"),
            )
        )
    return _union(frames)


def normalised_geometry(spark: SparkSession, sf: str) -> DataFrame:
    frames = []
    for name in ("places", "buildings", "divisions", "roads", "land_use"):
        raw = encode(derive(spark, sf, name).select("id", "geom_type", "parts"))
        prepared = normalise_geometry(raw)
        frames.append(
            prepared.select(
                F.lit(name).alias("layer"),
                "id",
                "geom_type",
                "n_edges",
                F.bround("rep_x", 7).alias("rep_x"),
                F.bround("rep_y", 7).alias("rep_y"),
                geometry.as_text("geom_type", "parts").alias("wkt"),
            )
        )
    return _union(frames)


def area_profile(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf, "radius_m", "category", "include_closed")
    layers = {
        "places": "places",
        "buildings": "buildings",
        "divisions": "divisions",
        "segments": "roads",
        "land_use": "land_use",
    }
    answers = profile.area_profile(
        points,
        taxonomy=load_taxonomy(spark),
        options=AS_ANSWERED,
        **{arg: layer(spark, sf, name) for arg, name in layers.items()},
    )
    groups = {"building_classes": "class", "road_classes": "road_class", "land_use_subtypes": "subtype"}

    def line(group: str) -> Callable[[Column], Column]:
        return lambda s: F.concat_ws(
            ":", F.coalesce(s[group], F.lit("null")), s["count"].cast("string"), s["percentage"].cast("string")
        )

    flat = {c: F.array_join(F.transform(c, line(g)), " ") for c, g in groups.items()}
    return answers.withColumns(flat)


QUERIES: dict[str, Query] = {
    "places_in_radius": places_in_radius,
    "nearest_place_of_type": nearest_place_of_type,
    "count_places_by_type_in_radius": count_places_by_type_in_radius,
    "category_catalog": category_catalog,
    "building_count_in_radius": building_count_in_radius,
    "building_class_composition": building_class_composition,
    "point_in_admin_boundary": point_in_admin_boundary,
    "road_count_by_class": road_count_by_class,
    "nearest_road_of_class": nearest_road_of_class,
    "road_surface_composition": road_surface_composition,
    "land_use_at_point": land_use_at_point,
    "land_use_composition": land_use_composition,
    "land_use_search": land_use_search,
    "screen_points": screening,
    "build_manifest": build_manifest,
    "prune_files_by_radius": prune_files_by_radius,
    "prune_files_by_point": prune_files_by_point,
    "normalise_geometry": normalised_geometry,
    "area_profile": area_profile,
    "pruned_building_count": pruned_building_count,
    "pruned_places_in_radius": pruned_places_in_radius,
    "pruned_land_use_at_point": pruned_land_use_at_point,
    "many_sites_building_count": many_sites_building_count,
    "many_sites_nearest_road": many_sites_nearest_road,
    "dateline_building_count": dateline_building_count,
    "dateline_building_count_by_corner": dateline_building_count_by_corner,
    "land_use_of_large_parcels": land_use_of_large_parcels,
    "scan_release": scan_release,
    "scan_sources": scan_sources,
    "taxonomy_from_json": taxonomy_from_json,
    "screen_road_points": _screened("nearest_road_of_class"),
    "screen_land_use_points": _screened("land_use_search"),
    "screen_searches": _screened("category_catalog"),
    "broken_geometry": broken_geometry,
}
