"""Polygons whose outlines are rows of a table, and the large parcels in that form."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from waymark.operators.land_use import land_use_at_point
from waymark.plans import outlines
from waymark.plans.contains import ContainsOptions, contains_join
from waymark.plans.outlines import OutlinedLayer
from workload import shapes
from workload.layers import derive, outlined_parcels

BOX = "struct<xmin:double,xmax:double,ymin:double,ymax:double>"


def _box(points):
    x, y = np.array(points).T
    return {"xmin": float(x.min()), "xmax": float(x.max()), "ymin": float(y.min()), "ymax": float(y.max())}


def _inside(ring, x, y):
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        side = (x1 - x) * (y2 - y) - (x2 - x) * (y1 - y)
        if side == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return False
        hit ^= ((y1 > y) != (y2 > y)) and ((side > 0) == (y2 > y1))
    return hit


def _outlined(spark, shapes, rows, size):
    pieces = [
        (key, at, _box(ring[first : first + size + 1]), [{"x": x, "y": y} for x, y in ring[first : first + size + 1]])
        for key, ring in shapes.items()
        for at, first in enumerate(range(0, len(ring) - 1, size))
    ]
    boxes = {key: _box(ring) for key, ring in shapes.items()} | {None: _box([(-9, -9), (9, 9)])}
    return OutlinedLayer(
        spark.createDataFrame([(i, key, boxes[key]) for i, key in rows], f"id string, outline int, bbox {BOX}"),
        spark.createDataFrame(pieces, f"outline int, at long, bbox {BOX}, line array<struct<x:double,y:double>>"),
    )


@pytest.mark.parametrize("extra", [{}, {"broadcast_site_cells": 0, "rows_per_task": 7}], ids=["plain", "cut"])
def test_pieces_decide_as_whole_outlines_do(spark, monkeypatch, extra):
    monkeypatch.setattr(outlines, "PIECES_PER_SLICE", 3)
    rng = np.random.default_rng(5)
    shapes = {}
    for key in range(6):
        turn = np.sort(rng.uniform(0, 2 * np.pi, 90))
        reach, (x, y) = rng.integers(2, 9, 90), rng.integers(-6, 6, 2)
        # whole numbers, so that sites lie on vertices and edges too
        ring = [(float(round(x + r * np.cos(t))), float(round(y + r * np.sin(t)))) for r, t in zip(reach, turn)]
        shapes[key] = [*ring, ring[0]]
    rows = [(f"s{k}", k) for k in shapes] + [("again", 0), ("again", 0), (None, 1), ("none", None)]
    sites = [(float(y), float(x)) for y in range(-9, 10) for x in range(-9, 10)]
    sites += [tuple(p) for p in rng.uniform(-9, 9, (60, 2)).tolist()]
    layer = _outlined(spark, shapes, rows, 4)
    points = spark.createDataFrame(sites, "lat double, lng double")
    got = contains_join(points, layer, {"id": F.col("id")}, ContainsOptions(**extra)).collect()
    want = Counter(
        (y, x, i) for y, x in sites for i, key in rows if key is not None and _inside(shapes[key], x, y)
    )
    assert Counter(map(tuple, got)) == want and len(want) > 300


def test_blocks_of_edges_decide_as_each_edge_does(monkeypatch):
    monkeypatch.setattr(outlines, "BLOCK", 8)
    monkeypatch.setattr(outlines, "PAIRS_AT_ONCE", 16)
    rng = np.random.default_rng(6)
    edges = [c.astype(float) for c in rng.integers(0, 12, (4, 300))]
    x, y = rng.integers(-1, 13, (2, 200)).astype(float)
    crossed, touched = outlines.met(edges, x, y)
    for i in range(len(x)):
        x1, y1, x2, y2 = edges
        side = (x1 - x[i]) * (y2 - y[i]) - (x2 - x[i]) * (y1 - y[i])
        across = ((y1 > y[i]) != (y2 > y[i])) & ((side > 0) == (y2 > y1))
        on = (side == 0) & (np.minimum(x1, x2) <= x[i]) & (x[i] <= np.maximum(x1, x2))
        on &= (np.minimum(y1, y2) <= y[i]) & (y[i] <= np.maximum(y1, y2))
        assert (crossed[i], touched[i]) == (across.sum(), on.any())


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Orders enough for borders whose pieces are shorter than a step; a region that comes twice."""
    folder = tmp_path_factory.mktemp("regions")
    pq.write_table(pa.table({"o_orderkey": np.arange(9_000)}), folder / "orders.parquet")
    regions = pa.table({"r_regionkey": pa.array([0, 1, 1, None], pa.int32()), "r_name": ["A", "B", "C", "D"]})
    pq.write_table(regions, folder / "region.parquet")
    return str(folder)


def test_large_parcels_come_in_pieces_with_the_same_vertices(spark, tables):
    layer = outlined_parcels(spark, tables)
    whole = {r.id: r for r in derive(spark, tables, "large_parcels").where("id IS NOT NULL").collect()}
    found = {}
    for piece in layer.pieces.orderBy("outline", "at").collect():
        line = [(p.x, p.y) for p in piece.line]
        assert len(line) <= shapes.PIECE + 1
        for x, y in line:
            assert piece.bbox.xmin <= x <= piece.bbox.xmax and piece.bbox.ymin <= y <= piece.bbox.ymax
        before = found.setdefault(f"z{piece.outline}", line[:1])
        assert before[-1] == line[0]
        before += line[1:]
    assert found == {i: [(p.x, p.y) for p in r.parts[0][0]] for i, r in whole.items()}
    rows = [(r.id, r.names.primary, f"z{r.outline}") for r in layer.rows.where("id IS NOT NULL").collect()]
    assert sorted(rows) == [("z0", "A", "z0"), ("z1", "B", "z1"), ("z1", "C", "z1")]


def test_large_parcels_answer_points(spark, tables):
    whole = {r.id: [(p.x, p.y) for p in r.parts[0][0]] for r in derive(spark, tables, "large_parcels").where("id IS NOT NULL").collect()}
    rng = np.random.default_rng(7)
    west, south = (shapes.CENTRE_X - 12_000) / 1e6, (shapes.CENTRE_Y - 12_000) / 1e6
    sites = [(i, south + float(y), west + float(x)) for i, (x, y) in enumerate(rng.uniform(0, 0.026, (12, 2)))]
    points = spark.createDataFrame(sites, "query_id int, lat double, lng double")
    got = Counter((r.query_id, r.names_primary) for r in land_use_at_point(points, outlined_parcels(spark, tables)).where("id IS NOT NULL").collect())
    names = {"z0": "A", "z1": "BC"}
    want = Counter((i, name) for i, y, x in sites for key, ring in whole.items() if _inside(ring, x, y) for name in names[key])
    assert got == want and 0 < len(want)
