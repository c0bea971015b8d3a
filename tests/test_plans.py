from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.brute import as_layer, geodesic, radius_pairs, random_features, random_sites
from waymark.functions.geometry import PARTS_TYPE
from waymark.plans import contains, opening, skew, tiles
from waymark.plans.contains import ContainsOptions, contains_join
from waymark.plans.radius import Criteria, RadiusOptions, radius_join
from waymark.plans.results import composition
from waymark.plans.skew import balanced_join
from waymark.plans.tiles import radius_counts, radius_nearest

SITE = ["lat", "lng", "radius_m"]
MANY = {"broadcast_site_cells": 0, "rows_per_task": 40, "pairs_per_row": 0}
DIRECT = MANY | {"pairs_per_row": 10**9}


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(7)
    features = random_features(rng, 1500, hot=True)
    sites = random_sites(rng, 60)
    return features, sites, as_layer(spark, features).cache(), spark.createDataFrame(sites)


@pytest.mark.parametrize("prefilter", ["corner", "none"])
@pytest.mark.parametrize("extra", [{}, MANY], ids=["broadcast", "shuffled"])
def test_radius_join_is_the_nested_loop(world, prefilter, extra):
    features, sites, layer, site_df = world
    want = radius_pairs(sites, features, prefilter == "corner")
    options = RadiusOptions(prefilter, **extra)
    got = radius_join(site_df.select(*SITE), layer, {"id": F.col("id")}, options=options)
    rows = [tuple(r) for r in got.select(*SITE, "id").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 1000


@pytest.mark.parametrize("prefilter", ["corner", "none"])
@pytest.mark.parametrize("extra", [{}, MANY, DIRECT], ids=["broadcast", "tiles", "shuffled"])
def test_counts_per_group(world, prefilter, extra):
    features, sites, layer, site_df = world
    kind = dict(zip(features.id, features.kind))
    want = Counter(
        (*key, kind[fid]) for *key, fid in radius_pairs(sites, features, prefilter == "corner")
    )
    options = RadiusOptions(prefilter, **extra)
    got = radius_counts(site_df.select(*SITE), layer, F.col("kind"), options=options)
    rows = {(r.lat, r.lng, r.radius_m, r.key): r["count"] for r in got.collect()}
    assert rows == dict(want)


@pytest.mark.parametrize("extra", [{}, MANY, DIRECT], ids=["broadcast", "tiles", "shuffled"])
def test_nearest_of_a_kind(world, extra):
    features, sites, layer, site_df = world
    pairs = radius_pairs(sites, features, True)
    place = features.set_index("id")
    want = set()
    for row in sites.itertuples():
        found = sorted(
            (float(geodesic(place.x[f], place.y[f], row.lng, row.lat)), f)
            for *key, f in pairs
            if tuple(key) == (row.lat, row.lng, row.radius_m) and place.kind[f] == row.kind
        )
        # copies of one place share a distance up to rounding, so compare distances
        for rank, (distance, _) in enumerate(found[: row.k], 1):
            want.add((row.lat, row.lng, row.radius_m, rank, round(distance, 3)))
    got = radius_nearest(
        site_df,
        layer,
        {"x": F.col("rep_x")},
        F.col("k"),
        7,
        Criteria(match={"kind": F.col("kind")}),
        RadiusOptions("corner", **extra),
    )
    rows = {(r.lat, r.lng, r.radius_m, r["rank"], round(r.distance, 3)) for r in got.collect()}
    assert rows == want and len(want) > 100


def test_no_sites(world):
    _, _, layer, site_df = world
    none = site_df.select(*SITE).where("lat > 1000")
    assert radius_counts(none, layer).count() == 0


def test_balanced_join_meets_every_pair_once(spark):
    left = spark.range(300).select((F.col("id") % 3 * (F.col("id") % 2)).alias("key"), F.col("id").alias("l"))
    right = spark.range(200).select((F.col("id") % 2).alias("key"), F.col("id").alias("r"))
    want = sorted(map(tuple, left.join(right, "key").collect()))
    got = balanced_join(left, right, ["key"], ["l"], ["r"], rows_per_task=20)
    assert sorted(map(tuple, got.select("key", "l", "r").collect())) == want


def _ring(rng, n, x, y, size):
    turn = np.sort(rng.uniform(0, 2 * np.pi, n))
    reach = size * rng.uniform(0.3, 1, n)
    ring = [(x + r * np.cos(t), y + r * np.sin(t)) for r, t in zip(reach, turn)]
    return [*ring, ring[0]]


def _inside(ring, x, y):
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            hit = not hit
    return hit


@pytest.mark.parametrize(
    "options",
    [
        ContainsOptions(),
        ContainsOptions(edges_per_band=3),
        ContainsOptions(broadcast_site_cells=0, rows_per_task=20, edges_per_band=5),
    ],
    ids=["broadcast", "banded", "shuffled"],
)
def test_contains_join_is_the_nested_loop(spark, options):
    rng = np.random.default_rng(3)
    shapes = {}
    for i in range(80):
        n = int(rng.choice([4, 9, 150]))
        size = float(rng.choice([0.001, 0.02, 3, 40]))
        rings = [_ring(rng, n, *rng.uniform(-2, 2, 2), size)]
        if i % 4 == 0:  # a second ring, hole or island, only parity counts
            rings.append(_ring(rng, 6, *rng.uniform(-2, 2, 2), size / 2))
        shapes[f"s{i}"] = rings
    rows = []
    for i, rings in shapes.items():
        x, y = np.array([p for r in rings for p in r]).T
        parts = [[[{"x": float(a), "y": float(b)} for a, b in r] for r in rings]]
        box = {"xmin": float(x.min()), "xmax": float(x.max()), "ymin": float(y.min()), "ymax": float(y.max())}
        rows.append((i, box, parts, sum(len(r) - 1 for r in rings)))
    box_type = "struct<xmin:double,xmax:double,ymin:double,ymax:double>"
    layer = spark.createDataFrame(rows, f"id string, bbox {box_type}, parts {PARTS_TYPE}, n_edges int")
    points = pd.DataFrame(rng.uniform(-2.5, 2.5, (120, 2)), columns=["lat", "lng"])
    want = {
        (p.lat, p.lng, i)
        for p in points.itertuples()
        for i, rings in shapes.items()
        if sum(_inside(r, p.lng, p.lat) for r in rings) % 2
    }
    got = contains_join(spark.createDataFrame(points), layer, {"id": F.col("id")}, options)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 500


def test_shares_round_like_exact_binary_values(spark):
    cases = [(c, t) for t in (3, 7, 8, 16, 40, 80, 200, 400, 2000, 4000, 6000) for c in range(1, t, max(1, t // 97))]
    cases += [(49, 2000), (1, 16), (3, 16), (1, 2000), (3, 2000)]
    rows = [(i, "a", c) for i, (c, t) in enumerate(cases)]
    rows += [(i, "b", t - c) for i, (c, t) in enumerate(cases)]
    counts = spark.createDataFrame(rows, "site int, key string, count long")
    got = composition(counts, ["site"]).where("key = 'a'").collect()
    for row in got:
        c, t = cases[row.site]
        assert row.percentage == round(c / t * 100, 1), (c, t)


def _polygons(spark, shapes):
    """A prepared layer of (id, rings) rows."""
    rows = []
    for i, rings in shapes:
        x, y = np.array([p for r in rings for p in r]).T
        parts = [[[{"x": float(a), "y": float(b)} for a, b in r] for r in rings]]
        box = {"xmin": float(x.min()), "xmax": float(x.max()), "ymin": float(y.min()), "ymax": float(y.max())}
        rows.append((i, box, parts, sum(len(r) - 1 for r in rings)))
    box_type = "struct<xmin:double,xmax:double,ymin:double,ymax:double>"
    return spark.createDataFrame(rows, f"id string, bbox {box_type}, parts {PARTS_TYPE}, n_edges int")


def test_edges_are_stored_once_whatever_their_length(spark):
    zigzag = [(i / 20_000, float(i % 2)) for i in range(20_000)]
    layer = _polygons(spark, [("z", [[*zigzag, (1.0, 2.0), (0.0, 2.0), zigzag[0]]])])
    large = contains._with_bands(layer.withColumn("_row", F.lit(0).cast("long")), 64)
    found = contains.slabs(large).selectExpr("sum(size(_edges)) n", "max(size(_edges)) most").first()
    assert (found.n, found.most) == (layer.first().n_edges, contains.EDGES_PER_ROW)


@pytest.mark.parametrize("extra", [{}, {"broadcast_site_cells": 0, "rows_per_task": 5}])
def test_rows_with_one_id_are_polygons_of_their_own(spark, extra):
    near = [(np.cos(t) * 2, np.sin(t) * 2) for t in np.linspace(0, 2 * np.pi, 200)]
    far = [(x + 3, y) for x, y in near]
    layer = _polygons(spark, [("same", [near]), ("same", [far]), ("same", [far]), (None, [near])])
    sites = spark.createDataFrame([(0.0, 0.0), (0.0, 1.5), (0.0, 4.0), (0.0, 9.0)], "lat double, lng double")
    found = contains_join(sites, layer, {"id": F.col("id")}, ContainsOptions(**extra))
    got = Counter((r.lng, r.id) for r in found.collect())
    assert got == {(0.0, "same"): 1, (0.0, None): 1, (1.5, "same"): 3, (1.5, None): 1, (4.0, "same"): 2}


@pytest.mark.parametrize("broadcast_keys", [skew.BROADCAST_KEYS, 10])
def test_all_large_keys_are_cut(spark, monkeypatch, broadcast_keys):
    monkeypatch.setattr(skew, "BROADCAST_KEYS", broadcast_keys)
    left = spark.range(60_000).select((F.col("id") % 20_000).alias("key"), F.col("id").alias("l"))
    right = spark.range(20_000).select(F.col("id").alias("key"), F.col("id").alias("r"))
    got = balanced_join(left, right, ["key"], ["l"], ["r"], rows_per_task=2)
    assert got.count() == 60_000 and got.distinct().count() == 60_000


def test_a_popular_site_is_dealt_over_tasks(spark):
    points = spark.range(4000).select("id", F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("site"))
    matches = spark.range(1000).select(F.col("id").alias("site"), F.lit("x").alias("found"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = skew.balanced_attach(points, matches, ["site"], ["id"], rows_per_task=100)
        rows = got.groupBy(F.spark_partition_id()).count().collect()
        want = points.join(matches, "site", "left")
        assert sorted(map(str, got.select("id", "found").collect())) == sorted(map(str, want.select("id", "found").collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r["count"] for r in rows) == 4000 and max(r["count"] for r in rows) < 1200


def test_the_tiles_tell_dense_layers_from_sparse_ones(world):
    features, sites, layer, site_df = world
    options = RadiusOptions(**MANY)
    ranged = tiles.ranged_sites(site_df.select(*SITE), options)
    facts = tiles.site_facts(ranged)
    keyed = tiles._with_tiles(tiles.feature_rows(layer, [], facts, options), facts.pairs)
    table, spread = tiles._tile_table(keyed, []), tiles.spread_sites(ranged)
    pairs = keyed.join(spread, "cell").count()
    rows = keyed.count() + spread.count()
    for factor, dense in ((0.9, True), (1.1, False)):
        given = RadiusOptions(pairs_per_row=factor * pairs / rows)
        assert tiles._dense(spread, table, ["cell"], given) is dense


def test_ranking_carries_no_geometry_of_files(spark, tmp_path, world):
    features, sites, layer, site_df = world
    shaped = layer.withColumn("parts", F.array(F.array(F.array(F.struct(F.col("rep_x").alias("x"), F.col("rep_y").alias("y"))))))
    shaped.repartition(6).write.parquet(str(tmp_path / "layer"))
    read = spark.read.parquet(str(tmp_path / "layer"))
    keyed = read.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    keep, criteria = {"kind": F.col("kind"), "parts": F.col("parts")}, Criteria(match={"kind": F.col("kind")})
    keep.pop("kind")
    for extra in ({}, MANY, DIRECT):
        options = RadiusOptions(**extra)
        bare = tiles.ranked(site_df, keyed, {c: F.col(c) for c in tiles.ROW_KEY}, F.col("k"), 7, criteria, options)
        plan = bare._jdf.queryExecution().executedPlan().toString()
        read_columns = [line.split("FileScan parquet [")[1].split("]")[0] for line in plan.splitlines() if "FileScan parquet [" in line]
        assert read_columns and not any("parts#" in columns for columns in read_columns)
        got, want = (radius_nearest(site_df, some, keep, F.col("k"), 7, criteria, options) for some in (keyed, read))
        shown = lambda df: sorted((r.lat, r.lng, r.radius_m, r["rank"], round(r.distance, 6), r["count"]) for r in df.collect())
        assert shown(got) == shown(want)
        near = got.where("abs(parts[0][0][0].y - lat) > 1").count()
        assert near == want.where("abs(parts[0][0][0].y - lat) > 1").count()


LEVELS = {"few_pairs": 0, "pairs_per_row": 0, "features_per_tile": 2}


@pytest.mark.parametrize("prefilter", ["corner", "none"])
def test_sites_that_fit_are_not_paired_with_a_crowded_layer(world, monkeypatch, prefilter):
    features, sites, layer, site_df = world
    kind = dict(zip(features.id, features.kind))
    pairs = radius_pairs(sites, features, prefilter == "corner")
    opened, levels = [], []
    plain_open, plain_levels = tiles._opened, tiles._levels
    monkeypatch.setattr(tiles, "ROOT_TILES", 40)
    monkeypatch.setattr(tiles, "_opened", lambda *a: opened.append(plain_open(*a)) or opened[-1])
    monkeypatch.setattr(tiles, "_levels", lambda *a: levels.extend(plain_levels(*a)) or levels)
    monkeypatch.setattr(tiles, "radius_join", None)
    for small in (tiles.BROADCAST_TILES, 0):
        monkeypatch.setattr(tiles, "BROADCAST_TILES", small)
        levels.clear()
        options = RadiusOptions(prefilter, **LEVELS)
        got = radius_counts(site_df.select(*SITE), layer, F.col("kind"), options=options)
        rows = {(r.lat, r.lng, r.radius_m, r.key): r["count"] for r in got.collect()}
        assert rows == dict(Counter((*key, kind[fid]) for *key, fid in pairs))
        assert len(levels) > 3
    # whole tiles are counted without opening them
    assert opened[-1].count() < len(pairs)


@pytest.mark.parametrize("winners", [1_000_000, 0])
def test_ranking_by_levels_gives_the_rows_of_a_direct_join(spark, world, monkeypatch, winners):
    features, sites, layer, site_df = world
    monkeypatch.setattr(tiles, "ROOT_TILES", 4)
    monkeypatch.setattr(tiles, "BROADCAST_WINNERS", winners)
    # rows that come twice, rows without id, and rows without position
    odd = layer.unionByName(layer.limit(300)).withColumns(
        {
            "id": F.when(F.abs(F.hash("rep_x", "kind")) % 5 > 0, F.col("id")),
            "rep_ex": F.when(F.abs(F.hash("rep_y", "kind")) % 7 > 0, F.col("rep_ex")),
        }
    ).cache()
    keep = {"x": F.col("rep_x"), "at": F.array("rep_y")}
    criteria = Criteria(match={"kind": F.col("kind")})
    found = []
    for options in (RadiusOptions("corner"), RadiusOptions("corner", **LEVELS)):
        got = radius_nearest(site_df, odd, keep, F.col("k"), 7, criteria, options)
        found.append(Counter(str(r.asDict()) for r in got.select(*sorted(got.columns)).collect()))
    assert found[0] == found[1] and found[0].total() > 100


@pytest.mark.parametrize("prefilter", ["corner", "none"])
def test_opened_tiles_are_tested_as_arrays(spark, world, monkeypatch, prefilter):
    """Counts and ranks of opened tiles are those of a direct join, and no pair becomes a row."""
    _, _, layer, site_df = world
    # places that share a position, and a group that is missing in some rows
    layer = layer.withColumn("kind", F.when(F.col("kind") != "a", F.col("kind")))
    layer = layer.unionByName(layer.limit(300).withColumn("id", F.concat(F.lit("copy of "), "id")))
    sites = site_df.select(*SITE).unionByName(
        # beyond the radius up to which a chord alone decides
        site_df.limit(3).select("lat", "lng", F.lit(70_000).cast(site_df.schema["radius_m"].dataType).alias("radius_m"))
    ).distinct()
    keep, k = {"kind": F.col("kind")}, F.lit(3)
    direct = RadiusOptions(prefilter, **DIRECT)
    counts = set(radius_counts(sites, layer, F.col("kind"), options=direct).collect())
    ranks = set(radius_nearest(sites, layer, keep, k, 5, options=direct).collect())
    monkeypatch.setattr(tiles, "within_reach", None)
    # tiles of several blocks
    options = RadiusOptions(prefilter, **{**MANY, "rows_per_task": 500, "features_per_tile": 1000})
    assert set(radius_counts(sites, layer, F.col("kind"), options=options).collect()) == counts
    assert set(radius_nearest(sites, layer, keep, k, 5, options=options).collect()) == ranks
    assert len(counts) > 50 and len(ranks) > 50


def test_blocks_are_counted_whole_or_skipped():
    """Only blocks that the rim cuts are opened; a wide circle opens none."""
    rng = np.random.default_rng(3)
    n = 5000
    place = rng.random((n, 2)) * 0.02
    frame = pd.DataFrame(
        {"_px": place[:, 0], "_py": place[:, 1], "rep_ex": place[:, 0] * 1e5, "rep_ey": place[:, 1] * 1e5,
         "rep_ez": 0.0, "rep_sin": 0.0, "_g": "", "_g0": False}
    )
    sites = pd.DataFrame(
        {"_site": [0, 1, 2], "radius_m": [50_000, 500, 10], "lng_min": -1.0, "lng_max": 1.0, "lat_min": -1.0,
         "lat_max": 1.0, "site_ex": [1000.0, 1000.0, 9e5], "site_ey": 1000.0, "site_ez": 0.0, "site_sin": 0.0}
    )
    tables = pa.Table.from_pandas(frame), pa.Table.from_pandas(sites)
    block = opening._in_space(place[:, 0], place[:, 1], 128)
    order = np.argsort(block, kind="stable")
    layer = opening._Features.of(tables[0].take(pa.array(order)), block[order])
    meets, whole, _, _ = layer.met(opening._Sites.of(tables[1]))
    assert whole[0].all() and not meets[2].any()
    assert 0 < (meets & ~whole)[1].sum() < 0.6 * meets.shape[1]
    within = np.hypot(place[:, 0] * 1e5 - 1000, place[:, 1] * 1e5 - 1000) < 500
    found = opening._counter(*tables).to_pydict()
    assert found["_site"] == [0, 1] and found["n"] == [n, within.sum()]
