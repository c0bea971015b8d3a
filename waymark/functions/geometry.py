"""Planar geometry on vertex arrays.

``parts`` is ``array<polygon>``, a polygon an ``array<ring>`` (shell first), a ring an
``array<struct<x, y>>``.  Lines and points use the same nesting: one part, one "ring".
Everything is a Spark SQL expression evaluated in the JVM; functions starting with an
underscore build its text, the others return a ``Column``.  Arguments are names or SQL
text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS_TYPE = "array<array<array<struct<x:double,y:double>>>>"

_ZERO3 = "named_struct('w', 0D, 'x', 0D, 'y', 0D)"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _segments(ring: str) -> str:
    """Consecutive vertex pairs of one ring or line."""
    count = f"greatest(size({ring}) - 1, 0)"
    return (
        f"zip_with(slice({ring}, 1, {count}), slice({ring}, 2, {count}), (a, b) -> "
        "named_struct('x1', a.x, 'y1', a.y, 'x2', b.x, 'y2', b.y))"
    )


def _all_segments(parts: str) -> str:
    return f"flatten(transform(flatten({parts}), ring -> {_segments('ring')}))"


def _vertices(parts: str) -> str:
    return f"flatten(flatten({parts}))"


def _sums(items: str, item: str, w: str, x: str, y: str) -> str:
    """Sums of three expressions over ``items``."""
    return (
        f"aggregate({items}, {_ZERO3}, (acc, {item}) -> named_struct("
        f"'w', acc.w + ({w}), 'x', acc.x + ({x}), 'y', acc.y + ({y})))"
    )


def _ring_area_sums(ring: str, x0: str, y0: str) -> str:
    """Twice the signed area and the matching first moments (times six)."""
    crossed = (
        f"transform({_segments(ring)}, s -> named_struct("
        f"'c', (s.x1 - {x0}) * (s.y2 - {y0}) - (s.x2 - {x0}) * (s.y1 - {y0}), "
        f"'x', s.x1 - {x0} + s.x2 - {x0}, 'y', s.y1 - {y0} + s.y2 - {y0}))"
    )
    return _sums(crossed, "t", "t.c", "t.c * t.x", "t.c * t.y")


def _area_sums(parts: str, x0: str, y0: str) -> str:
    """Sums over all rings; shells count positive and holes negative, whatever
    direction they are drawn in."""
    oriented = _let(
        "t",
        _ring_area_sums("ring", x0, y0),
        _let(
            "g",
            "CASE WHEN at = 0 THEN signum(t.w) ELSE -signum(t.w) END",
            "named_struct('w', t.w * g, 'x', t.x * g, 'y', t.y * g)",
        ),
    )
    rings = f"flatten(transform({parts}, poly -> transform(poly, (ring, at) -> {oriented})))"
    return _sums(rings, "t", "t.w", "t.x", "t.y")


def _line_centroid(parts: str) -> str:
    """Length-weighted centroid; the mean vertex when there is no length."""
    measured = (
        f"transform({_all_segments(parts)}, s -> named_struct("
        "'l', sqrt((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1)), "
        "'x', (s.x1 + s.x2) / 2, 'y', (s.y1 + s.y2) / 2))"
    )
    by_length = _sums(measured, "t", "t.l", "t.l * t.x", "t.l * t.y")
    by_vertex = _sums(_vertices(parts), "t", "1D", "t.x", "t.y")
    mean = "named_struct('x', t.x / t.w, 'y', t.y / t.w)"
    fallback = _let("t", by_vertex, f"CASE WHEN t.w > 0 THEN {mean} END")
    return _let("t", by_length, f"CASE WHEN t.w > 0 THEN {mean} ELSE {fallback} END")


def _polygon_centroid(parts: str) -> str:
    """Area-weighted centroid in degrees, computed relative to the first vertex to
    avoid cancellation.  Polygons without area fall back to their outline."""
    first = f"get(get(get({parts}, 0), 0), 0)"
    weighted = (
        "named_struct('x', o.x + u.x / (3 * u.w), 'y', o.y + u.y / (3 * u.w))"
    )
    return _let(
        "o",
        first,
        _let(
            "u",
            _area_sums(parts, "o.x", "o.y"),
            f"CASE WHEN u.w > 0 THEN {weighted} ELSE {_line_centroid(parts)} END",
        ),
    )


def _point_on_line(parts: str) -> str:
    """The interior vertex nearest to the line's centroid, the first one on ties;
    the nearer end point when no line has interior vertices."""
    interior = (
        f"flatten(transform(flatten({parts}), "
        "l -> slice(l, 2, greatest(size(l) - 2, 0))))"
    )
    ends = (
        f"flatten(transform(filter(flatten({parts}), l -> size(l) > 0), "
        "l -> array(l[0], l[size(l) - 1])))"
    )
    ranked = (
        "array_min(transform(v, (p, i) -> named_struct("
        "'d', sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)), "
        "'i', i, 'x', p.x, 'y', p.y)))"
    )
    nearest = _let("best", ranked, "named_struct('x', best.x, 'y', best.y)")
    candidates = f"CASE WHEN size({interior}) > 0 THEN {interior} ELSE {ends} END"
    return _let("c", _line_centroid(parts), _let("v", candidates, nearest))


def all_segments(parts: str) -> Column:
    """Every edge of every ring, in storage order: ``x1, y1, x2, y2``."""
    return F.expr(_all_segments(parts))


def edge_count(parts: str) -> Column:
    """Number of edges of all rings, from the sizes of the rings alone."""
    size = "if(ring IS NULL, NULL, greatest(size(ring) - 1, 0))"
    return F.expr(f"aggregate(flatten({parts}), 0, (n, ring) -> n + {size})")


def representative_point(geom_type: str, parts: str) -> Column:
    """Point: itself.  Line: a vertex of it.  Polygon: centroid.  Null when empty."""
    return F.expr(
        f"CASE WHEN endswith({geom_type}, 'POLYGON') THEN {_polygon_centroid(parts)} "
        f"WHEN endswith({geom_type}, 'LINESTRING') THEN {_point_on_line(parts)} "
        f"ELSE {_line_centroid(parts)} END"
    )


def _met(segments: str, x: str, y: str, result: str) -> str:
    """``result`` over the edges at the height of a point, in which ``{crossed}`` is the
    number of edges to its right and ``{touched}`` whether it lies on one."""
    side = f"((s.x1 - {x}) * (s.y2 - {y}) - (s.x2 - {x}) * (s.y1 - {y}))"
    near = f"filter({segments}, s -> {y} BETWEEN least(s.y1, s.y2) AND greatest(s.y1, s.y2))"
    touched = (
        f"exists(n, s -> {side} = 0 "
        f"AND {x} BETWEEN least(s.x1, s.x2) AND greatest(s.x1, s.x2))"
    )
    crossed = (
        f"size(filter(n, s -> (s.y1 > {y}) != (s.y2 > {y}) "
        f"AND ({side} > 0) = (s.y2 > s.y1)))"
    )
    return _let("n", near, result.format(crossed=crossed, touched=touched))


def encloses(segments: str, x: str, y: str) -> Column:
    """Even-odd test of a point against the edges of a polygon.

    Only edges whose y-range includes ``y`` matter, so any subset of the edges that
    keeps those gives the same answer.  Points on an edge are not enclosed.
    """
    return F.expr(_met(segments, x, y, "{crossed} % 2 = 1 AND NOT {touched}"))


def crossings(segments: str, x: str, y: str) -> Column:
    """The two facts behind :func:`encloses` for some of a polygon's edges, ``crossed`` and
    ``touched``: added up over all edges they decide."""
    return F.expr(
        _met(segments, x, y, "named_struct('crossed', {crossed}, 'touched', {touched})")
    )


def _number(v: str) -> str:
    """Shortest decimal text: no trailing ``.0``, an exponent only below 1e-4."""
    text = f"cast({v} AS string)"
    tiny = (
        f"replace(regexp_replace(replace({text}, '.0E', 'E'), 'E-([0-9])$', 'E-0$1'), 'E', 'e')"
    )
    small = f"rtrim('0', cast(cast({v} AS decimal(30, 25)) AS string))"
    return (
        f"CASE WHEN {v} = 0 THEN '0' WHEN abs({v}) < 1e-4 THEN {tiny} "
        f"WHEN abs({v}) < 1e-3 THEN {small} "
        f"ELSE regexp_replace({text}, '[.]0$', '') END"
    )


def _list(items: str, item: str, text: str) -> str:
    return f"concat('(', array_join(transform({items}, {item} -> {text}), ', '), ')')"


def as_text(geom_type: str, parts: str) -> Column:
    """Well-known text of a geometry."""
    vertex = f"concat({_number('p.x')}, ' ', {_number('p.y')})"
    ring = _list("ring", "p", vertex)
    polygon = _list("poly", "ring", ring)
    body = (
        f"CASE {geom_type} WHEN 'MULTIPOLYGON' THEN {_list(parts, 'poly', polygon)} "
        f"WHEN 'POLYGON' THEN {_list(f'{parts}[0]', 'ring', ring)} "
        f"WHEN 'MULTILINESTRING' THEN {_list(f'flatten({parts})', 'ring', ring)} "
        f"WHEN 'MULTIPOINT' THEN {_list(_vertices(parts), 'p', vertex)} "
        f"ELSE {_list(f'{parts}[0][0]', 'p', vertex)} END"
    )
    return F.expr(
        f"CASE WHEN size({_vertices(parts)}) > 0 THEN concat({geom_type}, ' ', {body}) "
        f"WHEN {parts} IS NOT NULL THEN concat({geom_type}, ' EMPTY') END"
    )
