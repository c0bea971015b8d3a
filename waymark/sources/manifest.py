"""File manifests: which files of a layer can hold anything for a set of points."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.plans import grid
from waymark.plans.outlines import OutlinedLayer
from waymark.plans.radius import BOX, with_search_box
from waymark.plans.skew import balanced_join
from waymark.plans.tiles import ROW_KEY
from waymark.sources.layers import scan_layer

#: Manifest rows (one per file and cell) sent to every executor.
BROADCAST_FILE_CELLS = 500_000

_FILE_BOX = ("xmin", "xmax", "ymin", "ymax")


def build_manifest(
    layer: DataFrame, collection: str, path: Column | None = None
) -> DataFrame:
    """Footprint of every file of a scanned layer.

    One row per file with its name and the bounds of its features' boxes, aggregated
    from the ``bbox`` leaves alone.  ``path`` defaults to the file a row was read from.
    """
    return (
        layer.select(
            (F.col("_metadata.file_path") if path is None else path).alias("path"), "bbox"
        )
        .groupBy("path")
        .agg(
            F.min("bbox.xmin").alias("xmin"),
            F.max("bbox.xmax").alias("xmax"),
            F.min("bbox.ymin").alias("ymin"),
            F.max("bbox.ymax").alias("ymax"),
            F.count(F.lit(1)).alias("features"),
        )
        .select(F.lit(collection).alias("collection"), "*")
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Read a written manifest; entries without a file are ignored."""
    return spark.read.parquet(path).where(F.col("path").isNotNull())


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """The data files below a folder, without opening them: path, bytes, modified."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .load(root)
        .select(
            "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")
        )
    )


# File systems that Arrow opens, by the scheme Spark knows them by.
_ARROW_SCHEMES = {"file": "file", "s3": "s3", "s3a": "s3", "gs": "gs", "hdfs": "hdfs"}


def _footer(uri: str) -> tuple[float | None, float | None, float | None, float | None, int]:
    """Bounds of a file's boxes and its number of rows, from the Parquet footer alone.

    Bounds are unknown where a row group has values but no statistics."""
    scheme, _, rest = uri.partition(":")
    system, path = pyarrow.fs.FileSystem.from_uri(f"{_ARROW_SCHEMES[scheme]}://{unquote(rest.lstrip('/') if scheme != 'file' else '/' + rest.lstrip('/'))}")
    with system.open_input_file(path) as file:
        footer = pq.read_metadata(file)
    columns = {footer.schema.column(i).path: i for i in range(footer.num_columns)}
    bounds: dict[str, list[float]] = {}
    for leaf, end in (("xmin", "min"), ("xmax", "max"), ("ymin", "min"), ("ymax", "max")):
        at = columns.get(f"bbox.{leaf}")
        for group in range(footer.num_row_groups):
            chunk = footer.row_group(group).column(at) if at is not None else None
            stats = chunk.statistics if chunk is not None and chunk.is_stats_set else None
            if stats is not None and stats.has_min_max:
                bounds.setdefault(leaf, []).append(float(getattr(stats, end)))
            elif stats is None or stats.null_count != chunk.num_values:
                bounds.setdefault(leaf, []).append(float("-inf" if end == "min" else "inf"))
    made = [
        (min if leaf.endswith("min") else max)(bounds[leaf]) if bounds.get(leaf) else None
        for leaf in _FILE_BOX
    ]
    return (*(v if v is None or math.isfinite(v) else None for v in made), footer.num_rows)


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_footer(uri) for uri in batch.column("path").to_pylist()]
        columns = list(zip(*found)) or [()] * 5
        made = [pa.array(c, pa.float64()) for c in columns[:4]] + [pa.array(columns[4], pa.int64())]
        kept = {n: batch.column(n) for n in ("path", "bytes", "modified")}
        yield pa.RecordBatch.from_arrays(
            [*kept.values(), *made], [*kept, *_FILE_BOX, "features"]
        )


def refresh_manifest(
    files: DataFrame, collection: str, known: DataFrame | None = None
) -> DataFrame:
    """Footprint of every listed file of a layer; only files that are new are opened.

    ``files`` comes from :func:`list_files`, ``known`` is the manifest of an earlier state.
    A file counts as known while its size and time of change are the same; files no longer
    listed leave the manifest.  Tasks read the footers of new files, no rows.  Where a
    footer has no statistics the bounds are null, and such a file is never skipped; nor is
    one whose file system Arrow cannot open.
    """
    identity = ["path", "bytes", "modified"]
    same = None if known is None else known.where(F.col("collection") == collection)
    new = files if same is None else files.join(same, identity, "left_anti")
    scheme = F.substring_index("path", ":", 1)
    open_ = scheme.isin(*_ARROW_SCHEMES)
    schema = (
        "path string, bytes long, modified timestamp, xmin double, xmax double, "
        "ymin double, ymax double, features long"
    )
    read = new.where(open_).mapInArrow(_footers, schema)
    nothing = [F.lit(None).cast("double").alias(c) for c in _FILE_BOX]
    closed = new.where(~open_).select(*identity, *nothing, F.lit(None).cast("long").alias("features"))
    made = read.unionByName(closed).select(F.lit(collection).alias("collection"), "*")
    if same is None:
        return made
    return made.unionByName(same.join(files, identity, "left_semi").select(*made.columns))


def _ladder(df: DataFrame, box: tuple[str, str, str, str]) -> DataFrame:
    """Key boxes by the cells they touch on the square rung of their size and on every
    coarser one.  Two boxes that intersect share a cell on the larger one's rung."""
    xmin, xmax, ymin, ymax = box
    cells = (
        f"transform(sequence(floor({xmin} * pow(4D, -k)), floor({xmax} * pow(4D, -k))), cx -> "
        f"transform(sequence(floor({ymin} * pow(4D, -k)), floor({ymax} * pow(4D, -k))), cy -> "
        "named_struct('k', k, 'cx', cx, 'cy', cy)))"
    )
    rungs = f"sequence(_own, {grid.MAX_RUNG})"
    own = grid.rung(f"greatest({xmax} - {xmin}, {ymax} - {ymin})", finer=0)
    return df.withColumn("_own", own).select(
        "*", F.expr(f"inline(flatten(flatten(transform({rungs}, k -> {cells}))))")
    )


def _anywhere(manifest: DataFrame) -> DataFrame:
    """Files whose bounds are unknown reach everywhere."""
    world = {"xmin": -360.0, "xmax": 360.0, "ymin": -90.0, "ymax": 90.0}
    return manifest.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in world.items()})


def _prune(
    manifest: DataFrame,
    boxes: DataFrame,
    strict: bool,
    broadcast_file_cells: int,
) -> DataFrame:
    files = _ladder(_anywhere(manifest), _FILE_BOX).withColumnRenamed("_own", "_file_rung")
    wanted = _ladder(boxes.distinct(), BOX)
    keys = ["k", "cx", "cy"]
    if files.limit(broadcast_file_cells + 1).count() > broadcast_file_cells:
        joined = balanced_join(wanted, files, keys, list(BOX), ["path"])
    else:
        joined = wanted.join(F.broadcast(files), keys)
    c = F.col
    if strict:
        meets = (
            (c("xmin") < c("lng_max"))
            & (c("xmax") > c("lng_min"))
            & (c("ymin") < c("lat_max"))
            & (c("ymax") > c("lat_min"))
        )
    else:
        meets = (
            (c("xmin") <= c("lng_max"))
            & (c("xmax") >= c("lng_min"))
            & (c("ymin") <= c("lat_max"))
            & (c("ymax") >= c("lat_min"))
        )
    at_larger = c("k") == F.greatest("_own", "_file_rung")
    return (
        joined.where(at_larger & meets).select("collection", "path").distinct()
    )


def _point_boxes(points: DataFrame) -> DataFrame:
    return points.select(
        F.col("lng").alias("lng_min"),
        F.col("lng").alias("lng_max"),
        F.col("lat").alias("lat_min"),
        F.col("lat").alias("lat_max"),
    )


def prune_files_by_radius(
    manifest: DataFrame,
    points: DataFrame,
    broadcast_file_cells: int = BROADCAST_FILE_CELLS,
) -> DataFrame:
    """Files whose bounds overlap the search box of any point (touching is not enough).

    ``points`` needs ``lat``, ``lng`` and ``radius_m``.
    """
    boxes = with_search_box(points.select("lat", "lng", "radius_m"), "corner")
    return _prune(manifest, boxes.select(*BOX), True, broadcast_file_cells)


def prune_files_by_point(
    manifest: DataFrame,
    points: DataFrame,
    broadcast_file_cells: int = BROADCAST_FILE_CELLS,
) -> DataFrame:
    """Files whose bounds include any point, border included."""
    return _prune(manifest, _point_boxes(points), False, broadcast_file_cells)


def scan_pruned(
    spark: SparkSession, layer: str, files: DataFrame, everything: DataFrame
) -> DataFrame:
    """Read a layer from the given files; from all of them when the list is empty.

    The list holds one short row per data file of one layer, which a scan has to list
    on the driver in any case.
    """
    paths = [r["path"] for r in files.where(F.col("collection") == layer).collect()]
    return scan_layer(spark, layer, source=sorted(paths)) if paths else everything


@dataclass(frozen=True)
class PrunedLayer:
    """A prepared layer in many files; a search opens the files its points can touch.

    Operators take it in place of a DataFrame.  ``manifest`` is the layer's part of a
    manifest (collection, path and bounds), ``read`` turns paths into the layer.  The list
    of paths passes through the driver, which lists a scan's files in any case.
    """

    manifest: DataFrame
    read: Callable[[list[str]], DataFrame]
    broadcast_file_cells: int = BROADCAST_FILE_CELLS

    @classmethod
    def of(cls, manifest: DataFrame, collection: str, schema: T.StructType | str | None = None):
        """The files of one collection, read as plain Parquet."""

        def read(paths: list[str]) -> DataFrame:
            reader = manifest.sparkSession.read
            files = (reader.schema(schema) if schema is not None else reader).parquet(*paths)
            place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
            return files.select("*", *[c.alias(n) for c, n in zip(place, ROW_KEY)])

        return cls(manifest.where(F.col("collection") == collection), read)

    def _only(self, files: DataFrame) -> DataFrame:
        paths = sorted(row["path"] for row in files.select("path").collect())
        if paths:
            return self.read(paths)
        some = self.manifest.agg(F.min("path")).first()[0]
        if some is None:
            raise ValueError("the manifest lists no file of the layer")
        return self.read([some]).where(F.lit(False))

    def around(self, sites: DataFrame, prefilter: str) -> DataFrame:
        """The files that a radius search from the sites can find something in."""
        boxes = with_search_box(sites.select("lat", "lng", "radius_m").distinct(), prefilter)
        return self._only(_prune(self.manifest, boxes.select(*BOX), False, self.broadcast_file_cells))

    def under(self, sites: DataFrame) -> DataFrame:
        """The files that can hold a polygon around any of the sites."""
        return self._only(_prune(self.manifest, _point_boxes(sites), False, self.broadcast_file_cells))


Layer = DataFrame | PrunedLayer


def around(layer: Layer, sites: DataFrame, prefilter: str) -> DataFrame:
    """What a radius search needs of a layer: all of a DataFrame, some files of others."""
    return layer.around(sites, prefilter) if isinstance(layer, PrunedLayer) else layer


def under(layer: Layer | OutlinedLayer, sites: DataFrame) -> DataFrame | OutlinedLayer:
    """What a containment search needs of a layer."""
    return layer.under(sites) if isinstance(layer, PrunedLayer) else layer
