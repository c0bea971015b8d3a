"""Reference answers by brute force, and small random layers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

A, FLAT = 6378137.0, 1 / 298.257223563
B = A * (1 - FLAT)


def geodesic(x1, y1, x2, y2):
    """Vincenty's inverse, iterated far past convergence."""
    x1, y1, x2, y2 = (np.asarray(v, float) for v in (x1, y1, x2, y2))
    ep2 = (A * A - B * B) / (B * B)
    u1 = np.arctan((1 - FLAT) * np.tan(np.radians(y1)))
    u2 = np.arctan((1 - FLAT) * np.tan(np.radians(y2)))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    dl = lam = np.radians(x2 - x1)
    for _ in range(30):
        p, q = c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam)
        ss, cs = np.hypot(p, q), s1 * s2 + c1 * c2 * np.cos(lam)
        sig = np.arctan2(ss, cs)
        sa = np.where(ss == 0, 0, c1 * c2 * np.sin(lam) / np.where(ss == 0, 1, ss))
        ca = 1 - sa * sa
        cm = np.where(ca <= 0, 0, cs - 2 * s1 * s2 / np.where(ca <= 0, 1, ca))
        k = FLAT / 16 * ca * (4 + FLAT * (4 - 3 * ca))
        lam = dl + (1 - k) * FLAT * sa * (
            sig + k * ss * (cm + k * cs * (2 * cm * cm - 1))
        )
    w = ca * ep2
    ka = 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w)))
    kb = w / 1024 * (256 + w * (-128 + w * (74 - 47 * w)))
    ds = kb * ss * (
        cm
        + kb / 4 * (cs * (2 * cm * cm - 1) - kb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3))
    )
    return B * ka * (sig - ds)


def corner_box(lat, lng, radius):
    d_lat = radius / 111320
    cosine = math.cos(math.radians(lat))
    d_lng = 180.0 if cosine < 0.01 else radius / (111320 * cosine)
    return lng - d_lng, lng + d_lng, lat - d_lat, lat + d_lat


def radius_pairs(sites: pd.DataFrame, features: pd.DataFrame, corner: bool) -> set:
    """(site row, feature id) pairs; features have x, y and corner px, py."""
    found = set()
    for row in sites.itertuples():
        d = geodesic(features.x, features.y, row.lng, row.lat)
        ok = d < row.radius_m
        if corner:
            west, east, south, north = corner_box(row.lat, row.lng, row.radius_m)
            ok &= features.px.between(west, east) & features.py.between(south, north)
        for fid in features.id[ok]:
            found.add((row.lat, row.lng, row.radius_m, fid))
    return found


def random_features(rng, n: int, hot: bool = False) -> pd.DataFrame:
    """Points in a few places: a city, the date line, a pole; boxes around them."""
    place = rng.integers(0, 3, n)
    x = np.where(place == 0, rng.uniform(4.85, 4.95, n), rng.uniform(-180, 180, n))
    x = np.where(place == 1, (rng.uniform(179.9, 180.1, n) + 180) % 360 - 180, x)
    y = np.select(
        [place == 0, place == 1],
        [rng.uniform(52.33, 52.4, n), rng.uniform(-0.1, 0.1, n)],
        rng.uniform(89.7, 90, n),
    )
    if hot:
        third = n // 3
        x[:third] = 4.9 + rng.uniform(-1e-4, 1e-4, third)
        y[:third] = 52.36 + rng.uniform(-1e-4, 1e-4, third)
        x[: third // 2], y[: third // 2] = 4.9, 52.36
    size = rng.uniform(0, 0.002, n)
    return pd.DataFrame(
        {
            "id": [f"f{i}" for i in range(n)],
            "x": x,
            "y": y,
            "px": x - size,
            "py": y - size,
            "kind": rng.choice(["a", "b", None], n),
        }
    )


def random_sites(rng, n: int) -> pd.DataFrame:
    place = rng.integers(0, 4, n)
    lng = np.select(
        [place == 0, place == 1, place == 3],
        [rng.uniform(4.85, 4.95, n), rng.choice([180.0, -180.0, 179.99, -179.95], n), 4.9],
        rng.uniform(-180, 180, n),
    )
    lat = np.select(
        [place == 0, place == 1, place == 3],
        [rng.uniform(52.33, 52.4, n), rng.uniform(-0.1, 0.1, n), 52.36],
        rng.choice([90.0, 89.99, 89.8], n),
    )
    return pd.DataFrame(
        {
            "lat": lat,
            "lng": lng,
            "radius_m": rng.choice([5, 300, 2000, 12000, 50000], n),
            "kind": rng.choice(["a", "b"], n),
            "k": rng.integers(1, 8, n),
        }
    ).drop_duplicates(["lat", "lng", "radius_m"])


def as_layer(spark, features: pd.DataFrame):
    """A prepared layer from random features (geometry columns left out)."""
    from pyspark.sql import functions as F

    from waymark.functions.geodesy import with_position

    df = spark.createDataFrame(features.drop(columns="kind").assign(kind=features.kind))
    df = df.select(
        "id",
        "kind",
        F.col("x").alias("rep_x"),
        F.col("y").alias("rep_y"),
        F.struct(
            F.col("px").alias("xmin"),
            F.lit(None).cast("double").alias("xmax"),
            F.col("py").alias("ymin"),
            F.lit(None).cast("double").alias("ymax"),
        ).alias("bbox"),
    )
    return with_position(df, "rep_x", "rep_y", "rep")
