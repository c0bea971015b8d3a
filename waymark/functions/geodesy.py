"""Distances on the WGS84 ellipsoid as plain Spark columns.

Each point is placed once, per row, in earth-centred coordinates (metres).  For a
pair, the straight chord between the two positions is stretched to the length of
the surface path with the curvature of the ellipsoid along that direction:

    path = chord * (1 + w / 24 + 3 * w^2 / 640 + ...),   w = (chord * curvature)^2

By Euler's formula the curvature along a direction with northward share ``cos a`` is
``(1 + e'^2 * cos^2(lat) * cos^2(a)) / N``; the product of the two cosines is simply
the polar component of the chord's direction.  Up to 50 km, the longest radius the
operators accept, the result stays within 1e-6 m of the converged geodesic (checked in
``tests/test_geodesy.py``).  Beyond that it may drift, but never below the chord, so a
pair outside the radius is never taken for one inside.

No trigonometry is left per pair, and the whole expression fits into one projection
inside whole-stage codegen.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The WGS84 ellipsoid.
SEMI_MAJOR_M = 6378137.0
FLATTENING = 1 / 298.257223563

_E2 = FLATTENING * (2 - FLATTENING)
_EP2 = _E2 / (1 - _E2)

_PARTS = ("ex", "ey", "ez", "sin")


def position_columns(prefix: str) -> list[str]:
    """Names of the columns added by :func:`with_position`."""
    return [f"{prefix}_{p}" for p in _PARTS]


def with_position(df: DataFrame, lng: str, lat: str, prefix: str) -> DataFrame:
    """Add earth-centred coordinates and the sine of the latitude of one point."""
    sin, cos = f"sin(radians({lat}))", f"cos(radians({lat}))"
    # repeated terms are computed once: they share one projection
    n = f"{SEMI_MAJOR_M}D / sqrt(1 - {_E2}D * {sin} * {sin})"
    terms = {
        "ex": f"{n} * {cos} * cos(radians({lng}))",
        "ey": f"{n} * {cos} * sin(radians({lng}))",
        "ez": f"{n} * {1 - _E2}D * {sin}",
        "sin": sin,
    }
    return df.withColumns({f"{prefix}_{t}": F.expr(text) for t, text in terms.items()})


def _pair_terms(a: str, b: str) -> dict[str, str]:
    """Squared chord, its squared polar component, and the squared sine of the latitude
    in between, as SQL text."""
    gap = {c: f"({a}_e{c} - {b}_e{c})" for c in "xyz"}
    squares = {c: f"{g} * {g}" for c, g in gap.items()}
    return {
        "chord2": f"({squares['x']} + {squares['y']} + {squares['z']})",
        "dz2": squares["z"],
        "sin2": f"({a}_sin + {b}_sin) * ({a}_sin + {b}_sin) * 0.25D",
    }


def _squared_path(chord2: str, dz2: str, sin2: str) -> str:
    """Squared length of the surface path over a chord, as SQL text.

    The square of the series in the module's description, multiplied out so that no
    division is left: with ``u = chord^2 * (1 + e'^2 * polar share)`` and
    ``c = (1 - e^2 sin^2) / a^2`` it is ``chord^2 + c u^2 (1/12 + c u / 90)``.
    """
    u = f"({chord2} + {_EP2}D * {dz2})"
    c = f"({1 / SEMI_MAJOR_M**2}D - {_E2 / SEMI_MAJOR_M**2}D * {sin2})"
    return f"{chord2} + {c} * {u} * {u} * ({1 / 12}D + {c} * {u} * {1 / 90}D)"


#: A path of up to 60 km exceeds its chord by less than this share.
_MAX_STRETCH, _STRETCH_VALID_M = 4e-6, 60_000


def within_distance(df: DataFrame, a: str, b: str, radius: str) -> DataFrame:
    """Keep pairs less than ``radius`` metres apart and add their ``distance``.

    Almost all pairs are decided by their squared chord; the path itself is only
    measured for those within a few millionths of the radius, and for the result.  The
    condition carries no computed column, so it can become part of a join condition.
    """
    terms = _pair_terms(a, b)
    square = f"cast({radius} AS double) * {radius}"
    surely = (
        f"{terms['chord2']} < {square} * {1 - 2 * _MAX_STRETCH}D "
        f"AND {radius} <= {_STRETCH_VALID_M}"
    )
    near = df.where(f"({surely}) OR {_squared_path(**terms)} < {square}")
    named = {f"_{t}": F.expr(text) for t, text in terms.items()}
    path = F.expr(f"sqrt({_squared_path(*named)})")
    return near.withColumns(named).withColumn("distance", path).drop(*named)


def _array_path(chord2: np.ndarray, u: np.ndarray, c: np.ndarray) -> np.ndarray:
    return chord2 + c * u * u * (1 / 12 + c * u * (1 / 90))


def arrays_within(
    a: list[np.ndarray], b: list[np.ndarray], radius: np.ndarray, scratch: np.ndarray
) -> np.ndarray:
    """The test of :func:`within_distance` on arrays of positions, rounded as there: every
    place of ``a``, a row, with every one of ``b``, a column like ``radius``.  ``scratch``
    holds two numbers per pair."""
    chord2, term = scratch
    np.subtract(a[0], b[0], out=chord2)
    chord2 *= chord2
    for i in (1, 2):
        np.subtract(a[i], b[i], out=term)
        term *= term
        chord2 += term
    square = radius * radius
    surely = np.where(radius <= _STRETCH_VALID_M, square * (1 - 2 * _MAX_STRETCH), -1.0)
    near = chord2 < surely
    # no path is shorter than its chord
    rows, columns = np.nonzero((chord2 < square) ^ near)
    if len(rows):
        chord2, square = chord2[rows, columns], square[rows, 0]
        gap, sines = a[2][columns] - b[2][rows, 0], a[3][columns] + b[3][rows, 0]
        u = chord2 + _EP2 * gap * gap
        c = 1 / SEMI_MAJOR_M**2 - _E2 / SEMI_MAJOR_M**2 * sines * sines * 0.25
        near[rows, columns] = _array_path(chord2, u, c) < square
    return near


def array_distance(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """``distance`` as :func:`within_distance` adds it."""
    x, y, z = (a[i] - b[i] for i in range(3))
    chord2 = x * x + y * y + z * z
    sines = a[3] + b[3]
    u = chord2 + _EP2 * (z * z)
    c = 1 / SEMI_MAJOR_M**2 - _E2 / SEMI_MAJOR_M**2 * (sines * sines * 0.25)
    return np.sqrt(_array_path(chord2, u, c))


def whole_metres(distance: Column) -> Column:
    """Round to the nearest integer metre, halves to even."""
    return F.rint(distance).cast("int")
