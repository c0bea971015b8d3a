"""Centroid clustering with exact integer distances that are kept up to date.

Every vector is stored with its dot products with all centroids. When centroids move, the
products change by the moved components alone, so a round adds those and takes the smallest
distance again; a vector's squared length and the centroids' give the rest. Sums per cluster
change by the vectors that moved. All arithmetic is on integers: results do not depend on
the order in which tasks end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.blocks import one_array
from waymark.llm.tables import shared_folder, stored

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
SEED = "3"
#: Squared lengths from here on are left out: their distances might not fit a long.
_MAX_SQUARE = 2.0**60
_STATE = "vec_id long, vector binary, square long, dots binary, was int, cluster int, distance long"


def _quantised(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """Usable vectors as integers: vec_id, x array<bigint>."""
    number = F.col(f"`{vector_col}`").cast("array<double>")
    frame = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), number.alias("x"))
    # a null anywhere makes the sum null; infinite and not-a-number ones fail the comparison
    square = f"aggregate(x, 0D, (s, v) -> s + v * v * {float(scale) ** 2!r}D)"
    frame = frame.filter(f"size(x) = {dims}").filter(f"{square} < {_MAX_SQUARE!r}D")
    return frame.select("vec_id", F.expr(f"transform(x, v -> floor(v * {float(scale)!r}D))").alias("x"))


def _first_centroids(kept: DataFrame, clusters: int, seed: str) -> np.ndarray:
    """The vectors whose ids hash lowest, in that order; rows without id start no cluster."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.filter("vec_id is not null").orderBy(hashed, "x").limit(clusters).collect()
    return np.array([row["x"] for row in first], np.int64)


def _product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T in integers; by floats where every sum is small enough to be exact."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * max(x.shape[1], 1)
    if most < 1 << 53:
        return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    return x @ y.T


def _moved(before: np.ndarray, after: np.ndarray, dims: int):
    """Brings stored rows from one set of centroids to the next."""
    delta = after - before
    changed = [np.flatnonzero(row) for row in delta]
    squares = (after * after).sum(axis=1)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _numbers(batch.column("vector"), np.int32, dims).astype(np.int64)
            dots = _numbers(batch.column("dots"), np.int64, len(after)).copy()
            for k, at in enumerate(changed):
                if len(at):
                    dots[:, k] += _product(x[:, at], delta[k : k + 1, at])[:, 0]
            square = one_array(batch.column("square")).to_numpy()
            distance = squares - 2 * dots + square[:, None]
            cluster = distance.argmin(axis=1)
            least = distance[np.arange(n), cluster]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"), batch.column("vector"), batch.column("square"), _rows(dots),
                    batch.column("cluster"), pa.array(cluster.astype(np.int32)), pa.array(least),
                ],
                ["vec_id", "vector", "square", "dots", "was", "cluster", "distance"],
            )

    return move


def _numbers(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Rows of equally long binaries as a matrix."""
    column = one_array(column).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), kind).reshape(-1, width)


def _rows(matrix: np.ndarray) -> pa.Array:
    matrix = np.ascontiguousarray(matrix)
    width = matrix.shape[1] * matrix.itemsize
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix)])


def _packed(dims: int, clusters: int):
    """Rows without any distance yet: products with centroids at the origin."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = one_array(batch.column("x")).flatten().to_numpy().reshape(n, dims)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"), _rows(x.astype(np.int32)), pa.array((x * x).sum(axis=1)),
                    _rows(np.zeros((n, clusters), np.int64)), pa.array(np.full(n, -1, np.int32)),
                    pa.array(np.full(n, -1, np.int32)), pa.array(np.zeros(n, np.int64)),
                ],
                ["vec_id", "vector", "square", "dots", "was", "cluster", "distance"],
            )

    return pack


def _changes(state: DataFrame, dims: int, clusters: int) -> tuple[np.ndarray, np.ndarray]:
    """How sums and sizes of the clusters change by the vectors that moved."""

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = np.zeros((clusters, dims), np.int64), np.zeros(clusters, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _numbers(batch.column("vector"), np.int32, dims).astype(np.int64)
            for column, sign in (("was", -1), ("cluster", 1)):
                at = one_array(batch.column(column)).to_numpy()
                for k in np.unique(at[at >= 0]):
                    sums[k] += sign * x[at == k].sum(axis=0)
                    sizes[k] += sign * int((at == k).sum())
        each = np.column_stack([sizes, sums]).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(each), dtype=np.int32)), pa.array(each)], ["at", "change"])

    moved = state.filter("was <> cluster").select("vector", "was", "cluster")
    total = np.zeros(clusters * (dims + 1), np.int64)
    # one row per cluster and component, whatever the input
    for row in moved.mapInArrow(change, "at int, change long").groupBy("at").agg(F.sum("change")).collect():
        total[row[0]] = row[1]
    total = total.reshape(clusters, dims + 1)
    return total[:, 1:], total[:, 0]


def _forget(frame: DataFrame) -> None:
    """Delete the stored files of a frame that nothing will read again."""
    spark = frame.sparkSession
    own = shared_folder(spark)
    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in {name.rsplit("/", 1)[0] for name in frame.inputFiles()}:
        if "/llm-" in folder and own.rstrip("/").rsplit("/", 1)[-1] in folder:
            path = java(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clusters(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    count: int = CLUSTERS,
    rounds: int = ROUNDS,
    dims: int = DIMENSIONS,
    scale: int = SCALE,
    seed: str = SEED,
) -> DataFrame:
    """The cluster of every usable vector after ``rounds`` updates of the centroids.

    Usable are vectors of exactly ``dims`` components, none null, infinite or not a number;
    a component ``x`` counts as the integer floor(scale * x). Vectors whose squared length in
    such integers reaches 2**60 are left out, for a long may not hold their distances. Result:
    vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 (of the final
    components in decimal, joined by commas).

    Centroids start as the vectors whose ``seed:vec_id`` has the smallest SHA-256; of rows with
    one id, the smaller vector first. Every row counts, repeated ones as often as they stand
    there; rows with a null id take part but start no cluster. With fewer rows than clusters
    there are fewer clusters; without usable rows (or ids) the result is empty. An inertia
    beyond a long is null.
    """
    spark = vectors.sparkSession
    kept = _quantised(vectors, id_col, vector_col, dims, scale)
    now = _first_centroids(kept, count, seed)
    columns = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(now):
        return spark.createDataFrame([], columns)
    count = len(now)
    state = stored(kept.mapInArrow(_packed(dims, count), _STATE))
    before = np.zeros_like(now)
    sums, sizes = np.zeros((count, dims), np.int64), np.zeros(count, np.int64)
    for turn in range(rounds + 1):
        last, state = state, stored(state.mapInArrow(_moved(before, now, dims), _STATE))
        _forget(last)
        if turn < rounds:
            more, larger = _changes(state, dims, count)
            sums, sizes, before = sums + more, sizes + larger, now
            filled = np.maximum(sizes, 1)[:, None]
            now = np.where(sizes[:, None] > 0, sums // filled, before)
    digest = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in now]
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    facts = state.groupBy("cluster").agg(exact.alias("sum")).collect()  # one row per cluster
    fits = lambda value: int(value) if value < 1 << 63 else None
    whole = fits(sum(row["sum"] for row in facts))
    made = [(row["cluster"], fits(row["sum"]), whole, digest[row["cluster"]]) for row in facts]
    table = spark.createDataFrame(made, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(table), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
