"""Map layers: their schemas, where they live, and their preparation for spatial joins.

A *raw* layer has WKB geometry as delivered.  A *prepared* layer has vertex arrays
(``geom_type``, ``parts``, ``n_edges``), a representative point (``rep_x``, ``rep_y``)
and its earth-centred position; all operators work on prepared layers.  Preparation is
a narrow job, done once per release and written back clustered by location.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geodesy, geometry, wkb
from waymark.plans import grid

_NAMES = "names struct<primary:string>"
_BBOX = "bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>"
_SOURCES = "sources array<struct<property:string,dataset:string,record_id:string>>"

#: Columns read from each layer, by layer name, as DDL.
SCHEMAS = {
    "place": (
        f"id string, {_NAMES}, "
        "categories struct<primary:string,alternate:array<string>>, "
        f"geometry binary, {_BBOX}, confidence double, websites array<string>, "
        "phones array<string>, addresses array<struct<freeform:string,locality:string,"
        "postcode:string,region:string,country:string>>, "
        "brand struct<names:struct<primary:string>,wikidata:string>, "
        f"operating_status string, {_SOURCES}"
    ),
    "building": (
        f"id string, {_NAMES}, class string, height double, num_floors int, "
        f"geometry binary, {_BBOX}, {_SOURCES}"
    ),
    "division_area": (
        f"id string, {_NAMES}, subtype string, class string, geometry binary, {_BBOX}"
    ),
    "segment": (
        f"id string, {_NAMES}, subtype string, class string, "
        "road_surface array<struct<value:string,between:array<double>>>, "
        "road_flags array<struct<values:array<string>,between:array<double>>>, "
        f"geometry binary, {_BBOX}, {_SOURCES}"
    ),
    "land_use": (
        f"id string, {_NAMES}, subtype string, class string, "
        f"geometry binary, {_BBOX}, {_SOURCES}"
    ),
}

# Theme directory of each layer in a release.
THEMES = {
    "place": "places",
    "building": "buildings",
    "division_area": "divisions",
    "segment": "transportation",
    "land_use": "base",
}


def layer_path(root: str, version: str, layer: str) -> str:
    """Directory of one layer: ``{root}/release/{version}/theme=…/type=…``."""
    return f"{root.rstrip('/')}/release/{version}/theme={THEMES[layer]}/type={layer}"


def scan_layer(
    spark: SparkSession,
    layer: str,
    *,
    root: str | None = None,
    version: str | None = None,
    source: str | DataFrame | list[str] | None = None,
) -> DataFrame:
    """Read one raw layer.

    From a release (``root`` and ``version``; ``theme`` and ``type`` become partition
    columns), or from ``source``: a DataFrame, a list of files, the name of a table or
    view, or a path.
    """
    if isinstance(source, DataFrame):
        return source
    reader = spark.read.schema(SCHEMAS[layer])
    if isinstance(source, list):
        return reader.parquet(*source)
    if isinstance(source, str):
        if "/" not in source and spark.catalog.tableExists(source):
            return spark.table(source)
        return reader.parquet(source)
    if root is None or version is None:
        raise ValueError("scan_layer needs either a source or both root and version")
    # the layer's directory itself is listed, other themes are never touched
    base = f"{root.rstrip('/')}/release/{version}"
    return reader.option("basePath", base).parquet(layer_path(root, version, layer))


def normalise_geometry(layer: DataFrame, column: str = "geometry") -> DataFrame:
    """Decode WKB and add everything the joins need.  Raw layer in, prepared one out.

    A row whose bytes are no geometry stays, with null geometry and the reason in
    ``geometry_error``; no operator finds it."""
    return with_representative(wkb.decode(layer, column, "geometry_error"))


def with_representative(decoded: DataFrame) -> DataFrame:
    """Add ``n_edges``, ``rep_x``, ``rep_y`` and the position to decoded geometry."""
    point = geometry.representative_point("geom_type", "parts")
    placed = (
        decoded.withColumns(
            {"n_edges": geometry.edge_count("parts"), "_rep": point}
        )
        .withColumns({"rep_x": F.col("_rep.x"), "rep_y": F.col("_rep.y")})
        .drop("_rep")
    )
    return geodesy.with_position(placed, "rep_x", "rep_y", "rep")


#: Rung of the cells that written layers are clustered by (4^-2 degrees, about 7 km).
CLUSTER_RUNG = -2


def cluster(prepared: DataFrame, partitions: int | None = None) -> DataFrame:
    """Order a prepared layer by location for writing.

    Range partitioning on cell, position and id keeps neighbours in one file, so that
    row-group statistics on ``bbox`` are tight, and cuts dense cells across files.
    """
    pair = grid.join_pair(CLUSTER_RUNG, CLUSTER_RUNG)
    cell = grid.cell_at(pair, "bbox.xmin", "bbox.ymin")
    keyed = prepared.withColumn("cell", cell)
    by = ["cell", "rep_y", "rep_x", "id"]
    ranged = (
        keyed.repartitionByRange(partitions, *by)
        if partitions
        else keyed.repartitionByRange(*by)
    )
    return ranged.sortWithinPartitions(*by).drop("cell")
