"""Matches in crowded cells, kept as lists: the rows of a direct join."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions.geometry import PARTS_TYPE, edge_count
from waymark.operators import land_use
from waymark.plans.contains import ContainsOptions, Lists, contained, contains_join

CROWDED = {"few_pairs": 0, "pairs_per_row": 0}
LAYER = (
    "id string, names struct<primary:string>, subtype string, class string, sources array<struct<dataset:string>>, "
    f"bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>, parts {PARTS_TYPE}"
)


def _ring(rng, n):
    """A closed ring on whole numbers, so that sites lie on edges and vertices."""
    x, y = rng.integers(0, 12, 2)
    turns = np.sort(rng.uniform(0, 2 * np.pi, n))
    size = int(rng.integers(1, 7))
    ring = [(float(round(x + size * np.cos(t))), float(round(y + size * np.sin(t)))) for t in turns]
    return [*ring, ring[0]]


def _layer(spark, odd=True):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(150):
        parts = [[_ring(rng, int(rng.choice([3, 4, 9, 20]))) for _ in range(1 + i % 3)]]
        if i % 5 == 0:
            parts.append([_ring(rng, 5)])
        x, y = np.array([p for poly in parts for r in poly for p in r]).T
        box = [float(v) for v in (x.min(), x.max(), y.min(), y.max())]
        if odd and i % 4 == 0:  # coordinates that are missing or no numbers, and missing vertices
            ring = parts[0][0]
            value = [None, float("nan"), float("inf"), None][i // 4 % 4]
            at = int(rng.integers(1, len(ring) - 1))
            ring[at] = (value, ring[at][1]) if i % 8 else (ring[at][0], value)
            if i % 16 == 0:
                ring[-2] = None
        if odd and i % 40 == 3:
            parts[0].append(None)
        made = [[r and [p and {"x": p[0], "y": p[1]} for p in r] for r in poly] for poly in parts]
        rows.append((f"s{i}", (f"n{i}",), "park", None, [("d",)], tuple(box), made))
    rows += rows[:20] + [(None, None, None, None, None, *rows[30][5:])]
    rows.append(("empty", None, None, None, None, (0.0, 9.0, 0.0, 9.0), [[[]]]))
    return spark.createDataFrame(rows, LAYER).withColumn("n_edges", edge_count("parts"))


def _sites(spark):
    rng = np.random.default_rng(5)
    whole = [(float(y), float(x)) for y in range(13) for x in range(0, 13, 2)]
    between = [(float(y), float(x)) for y, x in rng.uniform(0, 12, (60, 2))]
    return spark.createDataFrame(whole + between, "lat double, lng double")


@pytest.mark.parametrize(
    "extra",
    [{}, {"rows_at_once": 7}, {"edges_per_band": 6}, {"edges_per_band": 6, "broadcast_site_cells": 0, "rows_per_task": 20, "rows_at_once": 20}],
    ids=["whole", "sliced", "banded", "shuffled"],
)
def test_lists_are_the_rows_of_a_direct_join(spark, extra):
    layer, sites = _layer(spark).cache(), _sites(spark)
    keep = {"id": F.col("id"), "name": F.col("names.primary"), "found": F.lit(True)}
    lists = contained(sites, layer, keep, ContainsOptions(**CROWDED, **extra))
    assert isinstance(lists, Lists) and lists.rows.count() < lists.exploded().count()
    got = contains_join(sites, layer, keep, ContainsOptions(**CROWDED, **extra))
    direct = {k: v for k, v in extra.items() if k == "edges_per_band"}
    want = contains_join(sites, layer, keep, ContainsOptions(**direct))
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert Counter(got.collect()) == Counter(want.collect()) and want.count() > 1000


@pytest.mark.parametrize("extra", [{}, {"broadcast_site_cells": 3, "rows_per_task": 20}], ids=["sent", "shuffled"])
def test_land_use_in_crowded_cells(spark, extra):
    points = _sites(spark).withColumn("query_id", F.expr("if(lat = 3, NULL, cast(lat * 7 AS int))"))
    popular = spark.range(60).selectExpr("5.0D lat", "4.0D lng", "cast(id AS int) query_id")
    nowhere = spark.sql("SELECT -40.0D lat, 100.0D lng, 1 query_id UNION ALL SELECT 95.0D, 1.0D, 2")
    points = points.unionByName(points.limit(9)).unionByName(popular).unionByName(nowhere)
    layer = _layer(spark, odd=False).cache()
    got = land_use.land_use_at_point(points, layer, ContainsOptions(**CROWDED, **extra, data_version="v"))
    want = land_use.land_use_at_point(points, layer, ContainsOptions(data_version="v"))
    assert got.dtypes == want.dtypes and Counter(got.collect()) == Counter(want.collect())
    assert want.where("suggestion IS NOT NULL").count() > 0 and want.where("query_id = 50 AND query_lng = 4").count() > 1
    if not extra:  # matches are counted as numbers: no row of an answer is sorted or sent
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Exchange hashpartitioning" not in plan and "Sort" not in plan


def test_few_pairs_are_joined_directly(spark):
    layer, sites = _layer(spark), _sites(spark)
    assert not isinstance(contained(sites, layer, {"id": F.col("id")}), Lists)
    assert not isinstance(contained(sites, layer, {"id": F.col("id")}, ContainsOptions(few_pairs=0, pairs_per_row=10**6)), Lists)
    assert not isinstance(contained(sites.limit(0), layer, {"id": F.col("id")}, ContainsOptions(**CROWDED)), Lists)
