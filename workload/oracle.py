"""DuckDB SQL that computes the same answers in a different way.

Distances come from Vincenty's formula, centroids and containment from unnested edges,
joins from plain range conditions; nothing of the Spark plans is reused except the
derivation of the input.
"""

from __future__ import annotations

from waymark.sources.layers import THEMES
from waymark.sources.taxonomy import BUILT_IN
from workload import shapes
from workload.shapes import DUCKDB

_PASSES = 8
VERSION = "2026-01-21.0"


def _with(*ctes: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({body})" for n, body in ctes)


def _layer(name: str) -> tuple[str, str]:
    return f"{name}_raw", getattr(shapes, name)(DUCKDB)


def _edges(layer: str) -> list[tuple[str, str]]:
    return [
        (
            f"{layer}_rings",
            f"""SELECT id, bbox, p, r, parts[p][r] AS pts FROM (
              SELECT id, bbox, parts, p, unnest(range(1, len(parts[p]) + 1)) AS r FROM (
                SELECT id, bbox, parts, unnest(range(1, len(parts) + 1)) AS p
                FROM {layer}_raw))""",
        ),
        (
            f"{layer}_edges",
            f"""SELECT id, bbox, p, r, i, pts[i].x AS x1, pts[i].y AS y1,
              pts[i + 1].x AS x2, pts[i + 1].y AS y2
              FROM (SELECT *, unnest(range(1, len(pts))) AS i FROM {layer}_rings)""",
        ),
    ]


def _polygon_reps(layer: str) -> list[tuple[str, str]]:
    return [
        (
            f"{layer}_ring_sums",
            f"""SELECT id, r, sum(c) AS a, sum(c * (ux + vx)) AS mx, sum(c * (uy + vy)) AS my
              FROM (SELECT *, ux * vy - vx * uy AS c FROM (
                SELECT id, p, r, bbox, x1 - bbox.xmin AS ux, y1 - bbox.ymin AS uy,
                  x2 - bbox.xmin AS vx, y2 - bbox.ymin AS vy FROM {layer}_edges))
              GROUP BY id, p, r""",
        ),
        (
            f"{layer}_sums",
            f"""SELECT id, sum(g * a) AS a, sum(g * mx) AS mx, sum(g * my) AS my FROM (
                SELECT *, sign(a) * CASE WHEN r = 1 THEN 1 ELSE -1 END AS g
                FROM {layer}_ring_sums) GROUP BY id""",
        ),
        (
            layer,
            f"""SELECT t.*, bbox.xmin + mx / (3 * a) AS rx, bbox.ymin + my / (3 * a) AS ry
              FROM {layer}_raw t JOIN {layer}_sums s USING (id)""",
        ),
    ]


def _line_reps(layer: str) -> list[tuple[str, str]]:
    return [
        (
            f"{layer}_centres",
            f"""SELECT id, sum(l * ((x1 + x2) / 2)) / sum(l) AS cx, sum(l * ((y1 + y2) / 2)) / sum(l) AS cy
              FROM (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS l
                FROM {layer}_edges) GROUP BY id""",
        ),
        (
            f"{layer}_vertices",
            f"""SELECT id, i, len(pts) AS n, pts[i].x AS x, pts[i].y AS y
              FROM (SELECT *, unnest(range(1, len(pts) + 1)) AS i FROM {layer}_rings)""",
        ),
        (
            f"{layer}_chosen",
            f"""SELECT id, x, y FROM {layer}_vertices JOIN {layer}_centres USING (id)
              WHERE n = 2 OR i BETWEEN 2 AND n - 1
              QUALIFY row_number() OVER (PARTITION BY id ORDER BY
                sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), i) = 1""",
        ),
        (
            layer,
            f"""SELECT t.*, x AS rx, y AS ry FROM {layer}_raw t JOIN {layer}_chosen c USING (id)""",
        ),
    ]


def _prepared(name: str) -> list[tuple[str, str]]:
    if name == "places":
        rep = "SELECT *, parts[1][1][1].x AS rx, parts[1][1][1].y AS ry FROM places_raw"
        return [_layer(name), ("places", rep)]
    reps = _line_reps if name == "roads" else _polygon_reps
    return [_layer(name), *_edges(name), *reps(name)]


def _points(radius: str = "radius_m", source: str = "query_points") -> list[tuple[str, str]]:
    base = f"SELECT * REPLACE ({radius} AS radius_m) FROM ({getattr(shapes, source)(DUCKDB)})"
    return [
        ("points", base),
        (
            "boxed",
            """SELECT *, radius_m / 111320 AS d_lat,
              CASE WHEN cos(radians(lat)) < 0.01 THEN 180
                ELSE radius_m / (111320 * cos(radians(lat))) END AS d_lng FROM points""",
        ),
    ]


_CORNER = """f.bbox.xmin BETWEEN p.lng - p.d_lng AND p.lng + p.d_lng
                AND f.bbox.ymin BETWEEN p.lat - p.d_lat AND p.lat + p.d_lat"""


def _distances(
    layer: str, columns: str, where: str, tag: str = "", near: str = _CORNER
) -> list[tuple[str, str]]:
    """CTE ``hits``: pairs within reach, ``distance`` by Vincenty's iteration."""
    f = "(1 / 298.257223563)"
    a = "6378137.0"
    b = f"({a} * (1 - {f}))"
    ep2 = f"(({a} * {a} - {b} * {b}) / ({b} * {b}))"
    ctes = [
        (
            f"v0{tag}",
            f"""SELECT p.query_id, p.radius_m, {columns},
              radians(f.rx - p.lng) AS dl, radians(f.rx - p.lng) AS lam,
              atan((1 - {f}) * tan(radians(p.lat))) AS u1,
              atan((1 - {f}) * tan(radians(f.ry))) AS u2
              FROM boxed p JOIN {layer} f
                ON {near}
              WHERE {where}""",
        ),
        (
            f"v1{tag}",
            f"SELECT *, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2 FROM v0{tag}",
        ),
    ]
    source = f"v1{tag}"
    for i in range(_PASSES):
        n = f"{tag}_{i}"
        ctes += [
            (
                f"va{n}",
                f"""SELECT *, c2 * sin(lam) AS p_, c1 * s2 - s1 * c2 * cos(lam) AS q_,
                  s1 * s2 + c1 * c2 * cos(lam) AS cs FROM {source}""",
            ),
            (f"vb{n}", f"SELECT *, sqrt(p_ * p_ + q_ * q_) AS ss FROM va{n}"),
            (
                f"vc{n}",
                f"""SELECT *, atan2(ss, cs) AS sg,
                  CASE WHEN ss = 0 THEN 0 ELSE c1 * c2 * sin(lam) / ss END AS sa FROM vb{n}""",
            ),
            (f"vd{n}", f"SELECT *, 1 - sa * sa AS ca FROM vc{n}"),
            (
                f"ve{n}",
                f"""SELECT *, CASE WHEN ca <= 0 THEN 0 ELSE cs - 2 * s1 * s2 / ca END AS cm,
                  {f} / 16 * ca * (4 + {f} * (4 - 3 * ca)) AS cc FROM vd{n}""",
            ),
            (
                f"vf{n}",
                f"""SELECT * EXCLUDE (lam, p_, q_, cc{", cs, ss, sg, sa, ca, cm" if i < _PASSES - 1 else ""}),
                  dl + (1 - cc) * {f} * sa * (sg + cc * ss * (cm + cc * cs * (2 * cm * cm - 1))) AS lam
                  FROM ve{n}""",
            ),
        ]
        source = f"vf{n}"
    ctes += [
        (
            f"vg{tag}",
            f"""SELECT *, ca * {ep2} AS w FROM {source}""",
        ),
        (
            f"vh{tag}",
            f"""SELECT *, 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w))) AS ka,
              w / 1024 * (256 + w * (-128 + w * (74 - 47 * w))) AS kb FROM vg{tag}""",
        ),
        (
            f"hits{tag}",
            f"""SELECT *, CAST(distance AS INTEGER) AS distance_m FROM (
              SELECT *, {b} * ka * (sg - kb * ss * (cm + kb / 4 * (cs * (2 * cm * cm - 1)
                - kb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) AS distance
              FROM vh{tag}) WHERE distance < radius_m""",
        ),
    ]
    return ctes


_PLACE = "f.categories.\"primary\" = p.category"
_OPEN = "(p.include_closed OR coalesce(f.operating_status, 'open') != 'permanently_closed')"

_PLACE_FIELDS = """id, name, CASE WHEN found THEN rx END AS lng, CASE WHEN found THEN ry END AS lat,
  distance_m, confidence, address, phone, website, brand_name, brand_wikidata"""

_PLACE_COLUMNS = """f.id, f.names."primary" AS name, f.rx, f.ry, f.confidence, f.bbox,
  coalesce(nullif(f.addresses[1].freeform, ''), nullif(concat_ws(', ',
    nullif(f.addresses[1].locality, ''), nullif(f.addresses[1].postcode, ''),
    nullif(f.addresses[1].region, ''), nullif(f.addresses[1].country, '')), '')) AS address,
  f.phones[1] AS phone, f.websites[1] AS website,
  CASE WHEN f.brand.names."primary" != '' THEN f.brand.names."primary" END AS brand_name,
  CASE WHEN f.brand.names."primary" != '' THEN nullif(f.brand.wikidata, '') END AS brand_wikidata"""


def _ranked(limit: str) -> tuple[str, str]:
    return (
        "top",
        f"""SELECT *, true AS found FROM (SELECT h.*, row_number() OVER (PARTITION BY query_id
              ORDER BY distance_m, distance, id) AS rank FROM hits h)
            JOIN (SELECT query_id, {limit} AS k FROM points) USING (query_id) WHERE rank <= k""",
    )


def places_in_radius() -> str:
    ctes = [
        *_points(),
        *_prepared("places"),
        *_distances("places", _PLACE_COLUMNS, f"{_PLACE} AND {_OPEN}"),
        _ranked('coalesce("limit", 20)'),
    ]
    return f"""{_with(*ctes)}
SELECT q.query_id, q.lat AS query_lat, q.lng AS query_lng, q.radius_m, q.category, rank,
  count(id) OVER (PARTITION BY q.query_id) AS count, id, name, ry AS lat, rx AS lng, distance_m, confidence, address, phone, website,
  concat('POINT (', CAST(rx AS VARCHAR), ' ', CAST(ry AS VARCHAR), ')')
    || CASE WHEN rx IS NULL THEN NULL ELSE '' END AS geometry,
  CAST(NULL AS VARCHAR) AS geometry_note,
  CASE WHEN found IS NULL THEN concat('No ', q.category, ' found within ', q.radius_m,
    'm. Try increasing radius or check category with get_place_categories.') END AS suggestion,
  brand_name, brand_wikidata
FROM points q LEFT JOIN top t USING (query_id)"""


def nearest_place_of_type() -> str:
    ctes = [
        *_points("5000"),
        *_prepared("places"),
        *_distances(
            "places",
            _PLACE_COLUMNS,
            f"{_PLACE} AND coalesce(f.operating_status, 'open') != 'permanently_closed'",
        ),
        _ranked("1"),
    ]
    return f"""{_with(*ctes)}
SELECT q.query_id, q.lat AS query_lat, q.lng AS query_lng, q.radius_m AS max_radius_m, q.category,
  count(id) OVER (PARTITION BY q.query_id) AS count, id, name, ry AS lat, rx AS lng, distance_m, confidence, address, phone, website,
  CASE WHEN found IS NULL THEN concat('No ', q.category, ' found within ', q.radius_m,
    'm. Try increasing max_radius_m.') END AS suggestion, brand_name, brand_wikidata
FROM points q LEFT JOIN top t USING (query_id)"""


def count_places_by_type_in_radius() -> str:
    ctes = [
        *_points(),
        *_prepared("places"),
        *_distances("places", "f.id", f"{_PLACE} AND {_OPEN}"),
        ("counted", "SELECT query_id, count(*) AS n FROM hits GROUP BY query_id"),
    ]
    return f"""{_with(*ctes)}
SELECT query_id, lat AS query_lat, lng AS query_lng, radius_m, category,
  coalesce(n, 0) AS count,
  CASE WHEN n IS NULL THEN concat('Zero ', category, ' found within ', radius_m,
    'm. This may indicate sparse coverage in this region, or try a larger radius.') END AS suggestion
FROM points LEFT JOIN counted USING (query_id)"""


def _taxonomy() -> tuple[str, str]:
    rows = []
    for i, line in enumerate(BUILT_IN.strip().splitlines()):
        category, description = (t.replace("'", "''") for t in line.split(": ", 1))
        rows.append(f"({i}, '{category}', '{description}')")
    return "taxonomy", f"SELECT * FROM (VALUES {', '.join(rows)}) t(position, category, description)"


def category_catalog() -> str:
    ctes = [
        _taxonomy(),
        ("searches", shapes.searches(DUCKDB)),
        _layer("places"),
        (
            "observed",
            'SELECT categories."primary" AS category, count(*) AS n FROM places_raw GROUP BY 1',
        ),
        (
            "found",
            """SELECT query_id, category, description, row_number() OVER
                 (PARTITION BY query_id ORDER BY position) AS rank
               FROM searches JOIN taxonomy ON nullif(trim(query), '') IS NULL
                 OR contains(lower(category), lower(trim(query)))
                 OR contains(lower(description), lower(trim(query)))""",
        ),
    ]
    return f"""{_with(*ctes)}
SELECT s.query_id, nullif(trim(query), '') AS query, rank, f.category, description,
  CASE WHEN f.category IS NOT NULL THEN coalesce(n, 0) END AS places
FROM searches s LEFT JOIN (SELECT * FROM found WHERE rank <= 50) f USING (query_id)
  LEFT JOIN observed o ON o.category = f.category"""


def building_count_in_radius(
    points: str = "query_points", layer: str = "buildings", near: str = _CORNER
) -> str:
    ctes = [
        *_points(source=points),
        *_prepared(layer),
        *_distances(layer, "f.id", "true", near=near),
        ("counted", "SELECT query_id, count(*) AS n FROM hits GROUP BY query_id"),
    ]
    return f"""{_with(*ctes)}
SELECT query_id, lat AS query_lat, lng AS query_lng, radius_m, coalesce(n, 0) AS count,
  CASE WHEN n IS NULL THEN concat('Zero buildings found within ', radius_m,
    'm. This may be an undeveloped area or indicate sparse coverage in this region.') END AS suggestion
FROM points LEFT JOIN counted USING (query_id)"""


def _composition(layer: str, key: str, where: str, names: tuple[str, str], text: str) -> str:
    ctes = [
        *_points(),
        *_prepared(layer),
        *_distances(layer, f"{key} AS key", where),
        ("counted", "SELECT query_id, key, count(*) AS n FROM hits GROUP BY query_id, key"),
        ("totals", "SELECT query_id, sum(n) AS total FROM counted GROUP BY query_id"),
    ]
    return f"""{_with(*ctes)}
SELECT query_id, lat AS query_lat, lng AS query_lng, radius_m,
  CAST(coalesce(total, 0) AS BIGINT) AS {names[1]}, key AS {names[0]}, coalesce(n, 0) AS count,
  CAST(format('{{:.1f}}', n / CAST(total AS DOUBLE) * 100) AS DOUBLE) AS percentage,
  CASE WHEN n IS NULL THEN concat({text}) END AS suggestion
FROM points LEFT JOIN counted USING (query_id) LEFT JOIN totals USING (query_id)"""


def building_class_composition() -> str:
    return _composition(
        "buildings",
        "coalesce(f.class, 'unknown')",
        "true",
        ("class", "total_buildings"),
        "'Zero buildings found within ', radius_m, "
        "'m. Cannot compute composition for an area with no buildings.'",
    )


def road_count_by_class() -> str:
    return _composition(
        "roads",
        "coalesce(f.class, 'unknown')",
        "f.subtype = 'road'",
        ("road_class", "total_segments"),
        "'Zero road segments found within ', radius_m, "
        "'m. This may be an undeveloped area or an area with limited road mapping.'",
    )


def road_surface_composition() -> str:
    return _composition(
        "roads",
        "coalesce(f.road_surface[1].value, 'unknown')",
        "f.subtype = 'road'",
        ("surface", "total_segments"),
        "'Zero road segments found within ', radius_m, "
        "'m. Cannot compute surface composition for an area with no roads.'",
    )


def land_use_composition() -> str:
    return _composition(
        "land_use",
        "f.subtype",
        "true",
        ("subtype", "total_parcels"),
        "'Zero land use parcels found within ', radius_m, "
        "'m. This area may lack land use mapping coverage. Try increasing radius.'",
    )


_NUMBERS = "concat(CAST(v.x AS VARCHAR), ' ', CAST(v.y AS VARCHAR))"
_RING = f"concat('(', array_to_string(list_transform(r, lambda v: {_NUMBERS}), ', '), ')')"
_POLYGON = f"concat('(', array_to_string(list_transform(p, lambda r: {_RING}), ', '), ')')"


def _wkt(source: str) -> str:
    ring = _RING.replace("(r,", f"({source}.parts[1][1],")
    polygon = _POLYGON.replace("(p,", f"({source}.parts[1],")
    multi = (
        f"concat('(', array_to_string(list_transform({source}.parts, lambda p: {_POLYGON}), ', '), ')')"
    )
    text = f"""concat({source}.geom_type, ' ', CASE {source}.geom_type WHEN 'POLYGON' THEN {polygon}
      WHEN 'MULTIPOLYGON' THEN {multi} ELSE {ring} END)"""
    # whole numbers print without a fraction in well-known text
    return f"regexp_replace({text}, '\\.0([ ,)])', '\\1', 'g')"


def nearest_road_of_class() -> str:
    flags = ", ".join(
        f"coalesce(list_contains(flatten(list_transform(f.road_flags, lambda x: x.values)), '{n}'), false) AS {n}"
        for n in ("is_bridge", "is_tunnel", "is_link")
    )
    ctes = [
        *_points("5000"),
        *_prepared("roads"),
        *_distances(
            "roads",
            f"""f.id, f.names."primary" AS name, f.road_surface[1].value AS road_surface,
            f.rx, f.ry, {flags}, {_wkt("f")} AS geometry""",
            "f.subtype = 'road' AND f.class = p.road_class",
        ),
        _ranked("1"),
    ]
    return f"""{_with(*ctes)}
SELECT q.query_id, q.lat AS query_lat, q.lng AS query_lng, q.radius_m AS max_radius_m, q.road_class,
  count(id) OVER (PARTITION BY q.query_id) AS count, id, name, road_surface, distance_m, round(ry, 7) AS lat, round(rx, 7) AS lng,
  is_bridge, is_tunnel, is_link, geometry, CAST(NULL AS VARCHAR) AS geometry_note,
  CASE WHEN found IS NULL THEN concat('No ', q.road_class, ' road found within ', q.radius_m,
    'm. Try increasing max_radius_m or use a more common road class.') END AS suggestion
FROM points q LEFT JOIN top t USING (query_id)"""


def land_use_search() -> str:
    ctes = [
        *_points(),
        *_prepared("land_use"),
        *_distances(
            "land_use",
            f"""f.id, f.class, f.names."primary" AS names_primary, f.rx, f.ry,
            {_wkt("f")} AS geometry""",
            "f.subtype = p.subtype",
        ),
        _ranked('coalesce("limit", 20)'),
    ]
    return f"""{_with(*ctes)}
SELECT q.query_id, q.lat AS query_lat, q.lng AS query_lng, q.radius_m, q.subtype, rank, count(id) OVER (PARTITION BY q.query_id) AS count, id,
  class, names_primary, round(ry, 7) AS lat, round(rx, 7) AS lng, distance_m,
  geometry, CAST(NULL AS VARCHAR) AS geometry_note,
  CASE WHEN found IS NULL THEN concat('No ', q.subtype, ' land use found within ', q.radius_m,
    'm. Try increasing radius or use land_use_composition to see what land use types exist in this area.')
    END AS suggestion
FROM points q LEFT JOIN top t USING (query_id)"""


def _containment(layer: str, where: str) -> list[tuple[str, str]]:
    """CTE ``inside``: query_id and id of enclosing polygons, by counting crossings."""
    return [
        (
            "tested",
            f"""SELECT query_id, id, lng AS x, lat AS y, x1, y1, x2, y2,
                (x1 - lng) * (y2 - lat) - (x2 - lng) * (y1 - lat) AS side
              FROM points p JOIN (SELECT id AS fid FROM {layer}_raw WHERE {where}) ON true
                JOIN {layer}_edges e ON e.id = fid
              WHERE e.bbox.xmin <= lng AND e.bbox.xmax >= lng
                AND e.bbox.ymin <= lat AND e.bbox.ymax >= lat""",
        ),
        (
            "inside",
            """SELECT query_id, id FROM tested GROUP BY query_id, id
              HAVING count(*) FILTER (WHERE (y1 > y) != (y2 > y) AND (side > 0) = (y2 > y1)) % 2 = 1
                AND count(*) FILTER (WHERE side = 0 AND x BETWEEN least(x1, x2) AND greatest(x1, x2)
                  AND y BETWEEN least(y1, y2) AND greatest(y1, y2)) = 0""",
        ),
    ]


_LEVEL = """CASE subtype WHEN 'country' THEN 2 WHEN 'dependency' THEN 3 WHEN 'region' THEN 4
  WHEN 'county' THEN 6 WHEN 'localadmin' THEN 7 WHEN 'locality' THEN 8 WHEN 'neighborhood' THEN 9
  WHEN 'macrohood' THEN 10 WHEN 'microhood' THEN 11 ELSE 99 END"""

_NESTED = (
    "nested",
    f"""SELECT query_id,
      max_by(name, id) FILTER (WHERE subtype = 'locality') AS locality,
      max_by(name, id) FILTER (WHERE subtype = 'region') AS region,
      max_by(name, id) FILTER (WHERE subtype = 'country') AS country,
      string_agg(concat_ws(':', CAST(level AS VARCHAR), name, subtype), ' > ' ORDER BY level, id) AS admin_levels
    FROM (SELECT query_id, id, names."primary" AS name, subtype, {_LEVEL} AS level
      FROM inside JOIN divisions_raw USING (id)) GROUP BY query_id""",
)


def point_in_admin_boundary() -> str:
    ctes = [
        *_points(),
        _layer("divisions"),
        *_edges("divisions"),
        *_containment("divisions", "class = 'land'"),
        _NESTED,
    ]
    # Wording of the suggestion.
    text = "No administrative boundaries found for this point. It may be in international waters or an area with limited coverage."
    return f"""{_with(*ctes)}
SELECT query_id, lat AS query_lat, lng AS query_lng, locality, region, country, admin_levels,
  CASE WHEN admin_levels IS NULL THEN '{text}' END AS suggestion
FROM points LEFT JOIN nested USING (query_id)"""


def land_use_at_point(layer: str = "land_use") -> str:
    ctes = [
        *_points(),
        _layer(layer),
        *_edges(layer),
        *_containment(layer, "true"),
        (
            "matched",
            f"""SELECT query_id, id, subtype, class, names."primary" AS names_primary,
              sources[1].dataset AS source FROM inside JOIN {layer}_raw USING (id)""",
        ),
    ]
    return f"""{_with(*ctes)}
SELECT q.query_id, q.lat AS query_lat, q.lng AS query_lng, count(id) OVER (PARTITION BY q.query_id) AS count, id, m.subtype, class, names_primary, source,
  CASE WHEN id IS NULL THEN 'No land use designation found for this point. The area may lack land use mapping coverage, or the point may be in water/unmapped territory.' END AS suggestion
FROM points q LEFT JOIN matched m USING (query_id)"""


def screen_points() -> str:
    number = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"
    word = r"'^\s*[+-]?(nan|inf|infinity)\s*$'"

    def value(column: str) -> str:
        return f"CASE WHEN regexp_matches({column}, {number}) THEN CAST(trim({column}) AS DOUBLE) END"

    def not_number(column: str) -> str:
        return f"NOT (regexp_matches(coalesce({column}, ''), {number}) OR regexp_matches(lower(coalesce({column}, '')), {word}))"

    def shown(column: str) -> str:
        return f"coalesce('''' || {column} || '''', 'None')"

    cases = []
    for name, most in (("lat", 90), ("lng", 180)):
        cases += [
            (name, not_number(f"r.{name}"), f"concat('{name} must be a number. Received: ', {shown('r.' + name)})"),
            (name, f"{name}_v IS NULL", f"concat('{name} must be a finite number. Received: ', {shown('r.' + name)})"),
            (name, f"{name}_v NOT BETWEEN -{most} AND {most}", f"concat('{name} must be between -{most} and {most}. Received: ', CAST({name}_v AS VARCHAR))"),
        ]
    cases += [
        ("radius_m", "radius_v IS NULL", f"concat('radius_m must be a number. Received: ', {shown('r.radius_m')})"),
        ("radius_m", "NOT (radius_v >= 1 AND radius_v < 50001)", "concat('radius_m must be between 1 and 50000. Received: ', CAST(CAST(trunc(radius_v) AS BIGINT) AS VARCHAR))"),
        ("category", "coalesce(r.category, '') = ''", "'category is required and must be a non-empty string.'"),
        ("category", "trim(r.category) = ''", "'category must be a non-empty string.'"),
        ("category", "known IS NULL", "concat('Unknown category: ''', trim(r.category), '''. Use get_place_categories to find valid categories.')"),
        ("limit", 'r."limit" IS NOT NULL AND NOT (limit_v >= 1 AND limit_v < 101)', "concat('limit must be between 1 and 100. Received: ', CAST(CAST(trunc(limit_v) AS BIGINT) AS VARCHAR))"),
    ]
    which = "CASE " + " ".join(f"WHEN {c} THEN '{p}'" for p, c, _ in cases) + " END"
    message = "CASE " + " ".join(f"WHEN {c} THEN {m}" for _, c, m in cases) + " END"
    ctes = [
        _taxonomy(),
        ("raw", shapes.raw_points(DUCKDB)),
        (
            "r",
            f"""SELECT raw.*, {value("lat")} AS lat_v, {value("lng")} AS lng_v,
              {value("radius_m")} AS radius_v, {value('"limit"')} AS limit_v, t.category AS known
              FROM raw LEFT JOIN taxonomy t ON t.category = trim(raw.category)""",
        ),
    ]
    return f"""{_with(*ctes)}
SELECT query_id, CASE WHEN lat_v BETWEEN -90 AND 90 THEN lat_v END AS lat,
  CASE WHEN lng_v BETWEEN -180 AND 180 THEN lng_v END AS lng,
  CASE WHEN radius_v >= 1 AND radius_v < 50001 THEN CAST(trunc(radius_v) AS INTEGER) END AS radius_m,
  known AS category,
  CASE WHEN "limit" IS NULL THEN 20 WHEN limit_v >= 1 AND limit_v < 101 THEN CAST(trunc(limit_v) AS INTEGER) END AS "limit",
  false AS include_geometry,
  coalesce(lower(include_closed) IN ('true', '1', 'yes'), false) AS include_closed,
  {which} AS error_param, {message} AS error
FROM r"""


_COLLECTIONS = {
    "place": "places", "building": "buildings", "division_area": "divisions", "segment": "roads",
    "land_use": "land_use",
}


def _manifest() -> list[tuple[str, str]]:
    tables = _COLLECTIONS
    rows = " UNION ALL ".join(
        f"""SELECT '{name}' AS collection,
          concat('{name}/', CAST(CAST(floor(bbox.ymin * 2000) AS BIGINT) AS VARCHAR)) AS path,
          bbox FROM {table}_raw"""
        for name, table in tables.items()
    )
    return [
        *(_layer(t) for t in tables.values()),
        ("tiled", rows),
        (
            "manifest",
            """SELECT collection, path, min(bbox.xmin) AS xmin, max(bbox.xmax) AS xmax,
              min(bbox.ymin) AS ymin, max(bbox.ymax) AS ymax, count(*) AS features
              FROM tiled GROUP BY collection, path""",
        ),
    ]


def build_manifest() -> str:
    return f"{_with(*_manifest())}\nSELECT * FROM manifest"


def prune_files_by_radius() -> str:
    return f"""{_with(*_points(), *_manifest())}
SELECT DISTINCT collection, path FROM manifest JOIN boxed
  ON xmin < lng + d_lng AND xmax > lng - d_lng AND ymin < lat + d_lat AND ymax > lat - d_lat"""


def prune_files_by_point() -> str:
    return f"""{_with(*_points(), *_manifest())}
SELECT DISTINCT collection, path FROM manifest JOIN points
  ON lng BETWEEN xmin AND xmax AND lat BETWEEN ymin AND ymax"""


def normalise_geometry() -> str:
    names = ("places", "buildings", "divisions", "roads", "land_use")
    ctes = [cte for n in names for cte in _prepared(n)]
    ctes.append(_edges("places")[0])
    ctes.append(_edges("places")[1])
    rows = " UNION ALL ".join(
        f"""SELECT '{n}' AS layer, t.id, geom_type, coalesce(n_edges, 0) AS n_edges,
          round(rx, 7) AS rep_x, round(ry, 7) AS rep_y, {_wkt("t")} AS wkt
        FROM {n} t LEFT JOIN (SELECT id, CAST(count(*) AS INTEGER) AS n_edges FROM {n}_edges GROUP BY id) e USING (id)"""
        for n in names
    )
    return f"{_with(*ctes)}\n{rows}"


def area_profile() -> str:
    ctes = [*_points()]
    for name in ("places", "buildings", "roads", "land_use"):
        ctes += _prepared(name)
    ctes += [
        *_distances("places", "f.id", f"{_PLACE} AND {_OPEN}", "_p"),
        *_distances("buildings", "f.id, coalesce(f.class, 'unknown') AS key", "true", "_b"),
        *_distances("roads", "f.id, coalesce(f.class, 'unknown') AS key", "f.subtype = 'road'", "_r"),
        *_distances("land_use", "f.id, f.subtype AS key", "true", "_l"),
        _layer("divisions"),
        *_edges("divisions"),
        *_containment("divisions", "class = 'land'"),
        _NESTED,
    ]
    counts = {"p": "place_count", "b": "building_count", "r": "total_segments", "l": "total_parcels"}
    shares = {"b": "building_classes", "r": "road_classes", "l": "land_use_subtypes"}
    for tag in shares:
        ctes += [
            (f"n_{tag}", f"SELECT query_id, key, count(*) AS n FROM hits_{tag} GROUP BY query_id, key"),
            (
                f"s_{tag}",
                f"""SELECT query_id, string_agg(concat(coalesce(key, 'null'), ':', n, ':',
                  CAST(CAST(format('{{:.1f}}', n / CAST(total AS DOUBLE) * 100) AS DOUBLE) AS VARCHAR)), ' ' ORDER BY n DESC, key NULLS FIRST) AS line
                  FROM n_{tag} JOIN (SELECT query_id, sum(n) AS total FROM n_{tag} GROUP BY query_id) USING (query_id)
                  GROUP BY query_id""",
            ),
        ]
    joins = " ".join(
        f"LEFT JOIN (SELECT query_id, count(*) AS {c} FROM hits_{t} GROUP BY query_id) {t} USING (query_id)"
        for t, c in counts.items()
    )
    joins += " ".join(
        f" LEFT JOIN (SELECT query_id, line AS {c} FROM s_{t}) c{t} USING (query_id)" for t, c in shares.items()
    )
    fields = ", ".join(f"coalesce({c}, 0) AS {c}" for c in counts.values())
    fields += ", " + ", ".join(f"coalesce({c}, '') AS {c}" for c in shares.values())
    return f"""{_with(*ctes)}
SELECT query_id, {fields}, locality, region, country
FROM points {joins} LEFT JOIN nested USING (query_id)"""


def dateline_building_count() -> str:
    return building_count_in_radius("dateline_points", "dateline_buildings", "true")


def dateline_building_count_by_corner() -> str:
    return building_count_in_radius("dateline_points", "dateline_buildings")


def land_use_of_large_parcels() -> str:
    return land_use_at_point("large_parcels")


#: Bytes of a geometry: a header, counts of parts, rings and vertices, and the vertices.
_WKB_BYTES = """CASE geom_type WHEN 'POINT' THEN 21 WHEN 'LINESTRING' THEN 9 + 16 * len(parts[1][1])
  ELSE CASE geom_type WHEN 'MULTIPOLYGON' THEN 9 ELSE 0 END + list_sum(list_transform(parts,
    lambda p: 9 + list_sum(list_transform(p, lambda r: 4 + 16 * len(r))))) END"""


def scan_release() -> str:
    ctes = [_layer(t) for t in _COLLECTIONS.values()]
    rows = " UNION ALL ".join(
        f"""SELECT '{THEMES[c]}' AS theme, '{c}' AS type, id, bbox.xmin AS xmin, bbox.ymax AS ymax,
          CAST({_WKB_BYTES} AS INTEGER) AS bytes FROM {t}_raw"""
        for c, t in _COLLECTIONS.items()
    )
    return f"{_with(*ctes)}\n{rows}"


def scan_sources() -> str:
    ctes = [_layer(t) for t in _COLLECTIONS.values()]
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS layer, source, count(*) AS features, max(id) AS last FROM {t}_raw, "
        "(VALUES ('path'), ('files'), ('view'), ('frame')) s(source) GROUP BY source"
        for c, t in _COLLECTIONS.items()
    )
    return f"{_with(*ctes)}\n{rows}"


def taxonomy_from_json() -> str:
    return f"""SELECT CAST(row_number() OVER (ORDER BY category, description) - 1 AS INTEGER) AS position,
  category, description FROM ({shapes.kinds(DUCKDB)})"""


def broken_geometry() -> str:
    ctes = [cte for n in _COLLECTIONS.values() for cte in _prepared(n)]
    ctes += _edges("places")
    error = """CASE WHEN k % 7 = 0 THEN 'truncated' WHEN k % 11 = 0 THEN 'unsupported type'
      WHEN k % 13 = 0 THEN 'unknown byte order' WHEN k % 17 = 0 THEN 'trailing bytes'
      WHEN k % 19 = 0 THEN 'truncated' END"""
    rows = " UNION ALL ".join(
        f"""SELECT '{n}' AS layer, id, {error} AS geometry_error, geom_type,
          coalesce(n_edges, 0) AS n_edges, round(rx, 7) AS rep_x, round(ry, 7) AS rep_y
        FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS k FROM {n})
          LEFT JOIN (SELECT id, CAST(count(*) AS INTEGER) AS n_edges FROM {n}_edges GROUP BY id) USING (id)"""
        for n in _COLLECTIONS.values()
    )
    kept = ", ".join(
        f"CASE WHEN geometry_error IS NULL THEN {c} END AS {c}"
        for c in ("geom_type", "n_edges", "rep_x", "rep_y")
    )
    return f"{_with(*ctes)}\nSELECT layer, id, geometry_error, {kept} FROM ({rows})"


def _judged_degrees(most: int):
    def judge(name: str, text: str | None) -> tuple[str | None, str | None]:
        try:
            value = float(text)
        except (TypeError, ValueError):
            return None, f"{name} must be a number. Received: {text!r}"
        if value != value or abs(value) == float("inf"):
            return None, f"{name} must be a finite number. Received: {text!r}"
        if abs(value) > most:
            return None, f"{name} must be between -{most} and {most}. Received: {value}"
        return repr(value), None

    return judge


def _judged_whole(most: int, default: int | None):
    def judge(name: str, text: str | None) -> tuple[str | None, str | None]:
        if text is None and default is not None:
            return str(default), None
        try:
            value = int(float(text))
        except (TypeError, ValueError, OverflowError):
            return None, f"{name} must be a number. Received: {text!r}"
        if not 1 <= value <= most:
            return None, f"{name} must be between 1 and {most}. Received: {value}"
        return str(value), None

    return judge


def _judged_word(known: tuple[str, ...], label: str):
    def judge(name: str, text: str | None) -> tuple[str | None, str | None]:
        if not text:
            return None, f"{name} is required and must be a non-empty string."
        word = text.strip().lower()
        if not word:
            return None, f"{name} must be a non-empty string."
        if word not in known:
            return None, f"Unknown {label}: '{word}'. Valid values: {', '.join(sorted(known))}"
        return word, None

    return judge


def _judged_search(name: str, text: str | None) -> tuple[str | None, str | None]:
    return (text or "").strip() or None, None


def _screened(parameters: dict[str, tuple]) -> str:
    """Screening by tables of every text that occurs, judged here one by one.

    ``parameters``: by source column, the name in messages, the type, the texts, the judge.
    """
    ctes = [("raw", shapes.raw_calls(DUCKDB))]
    joins, values, errors = [], [], []
    for i, (column, (name, kind, texts, judge)) in enumerate(parameters.items()):
        rows = [(text, *judge(name, text)) for text in dict.fromkeys(texts)]
        listed = ", ".join(f"({', '.join(DUCKDB.text(x) for x in row)})" for row in rows)
        ctes.append((f"t{i}", f"SELECT * FROM (VALUES {listed}) t(word, cleaned, message)"))
        joins.append(f'JOIN t{i} ON t{i}.word IS NOT DISTINCT FROM raw."{column}"')
        values.append(f'CAST(t{i}.cleaned AS {kind}) AS "{name}"')
        errors.append((name, f"t{i}.message"))
    which = " ".join(f"WHEN {m} IS NOT NULL THEN '{n}'" for n, m in errors)
    flag = "coalesce(lower(include_geometry) IN ('true', '1', 'yes'), false) AS include_geometry"
    return f"""{_with(*ctes)}
SELECT query_id, {", ".join(values)}, {flag}, false AS include_closed,
  CASE {which} END AS error_param, coalesce({", ".join(m for _, m in errors)}) AS error
FROM raw {" ".join(joins)}"""


_PLACE_PARAMETERS = {
    "lat": ("lat", "DOUBLE", shapes.DEGREES, _judged_degrees(90)),
    "lng": ("lng", "DOUBLE", shapes.DEGREES, _judged_degrees(180)),
}


def screen_road_points() -> str:
    return _screened(
        _PLACE_PARAMETERS
        | {
            "road_class": ("road_class", "VARCHAR", shapes.ROAD_WORDS, _judged_word(shapes.ROAD_CLASSES, "road_class")),
            "max_radius_m": ("radius_m", "INTEGER", shapes.RADII, _judged_whole(50_000, 5000)),
        }
    )


def screen_land_use_points() -> str:
    return _screened(
        _PLACE_PARAMETERS
        | {
            "radius_m": ("radius_m", "INTEGER", shapes.RADII, _judged_whole(50_000, None)),
            "subtype": ("subtype", "VARCHAR", shapes.SUBTYPE_WORDS, _judged_word(shapes.SUBTYPES, "land use subtype")),
            "limit": ("limit", "INTEGER", shapes.LIMITS, _judged_whole(100, 20)),
        }
    )


def screen_searches() -> str:
    return _screened({"query": ("query", "VARCHAR", shapes.QUERY_WORDS, _judged_search)})


def _noted(build):
    """The same with the release in every row."""
    return lambda: f"SELECT *, '{VERSION}' AS data_version FROM ({build()})"


ORACLES = {
    f.__name__: f
    for f in (
        places_in_radius,
        nearest_place_of_type,
        count_places_by_type_in_radius,
        category_catalog,
        building_count_in_radius,
        building_class_composition,
        point_in_admin_boundary,
        road_count_by_class,
        nearest_road_of_class,
        road_surface_composition,
        land_use_at_point,
        land_use_composition,
        land_use_search,
        screen_points,
        build_manifest,
        prune_files_by_radius,
        prune_files_by_point,
        normalise_geometry,
        area_profile,
        dateline_building_count,
        dateline_building_count_by_corner,
        land_use_of_large_parcels,
        scan_release,
        scan_sources,
        taxonomy_from_json,
        screen_road_points,
        screen_land_use_points,
        screen_searches,
        broken_geometry,
    )
}
ORACLES["many_sites_building_count"] = building_count_in_radius
ORACLES["many_sites_nearest_road"] = nearest_road_of_class
ORACLES["pruned_building_count"] = building_count_in_radius
ORACLES["pruned_places_in_radius"] = places_in_radius
ORACLES["pruned_land_use_at_point"] = land_use_at_point
for _name in (
    "places_in_radius", "nearest_place_of_type", "count_places_by_type_in_radius",
    "building_count_in_radius", "building_class_composition", "point_in_admin_boundary",
    "road_count_by_class", "nearest_road_of_class", "road_surface_composition",
    "land_use_at_point", "land_use_composition", "land_use_search", "area_profile",
    "pruned_building_count", "pruned_places_in_radius", "pruned_land_use_at_point",
    "many_sites_nearest_road", "land_use_of_large_parcels",
):
    ORACLES[_name] = _noted(ORACLES[_name])
