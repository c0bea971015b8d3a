"""How map features are derived from table keys, for Spark and for DuckDB.

Positions are whole micro-degrees computed from integer keys and divided by 1e6 once,
so both engines hold the same doubles.  Only the syntax of arrays and structs differs
between the two; ``Dialect`` covers that.
"""

from __future__ import annotations

from dataclasses import dataclass

from waymark.operators.screening import LAND_USE_SUBTYPES as SUBTYPES
from waymark.operators.screening import ROAD_CLASSES


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def struct(self, **fields: str) -> str:
        if self.spark:
            return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def array(self, *items: str) -> str:
        body = ", ".join(items)
        return f"array({body})" if self.spark else f"[{body}]"

    def vertex(self, x: str, y: str) -> str:
        return self.struct(x=f"({x}) / 1e6", y=f"({y}) / 1e6")

    def line(self, vertices: list[tuple[str, str]]) -> str:
        return self.array(*[self.vertex(x, y) for x, y in vertices])

    def ring(self, vertices: list[tuple[str, str]]) -> str:
        return self.line([*vertices, vertices[0]])

    def head(self, array: str, n: str) -> str:
        return f"slice({array}, 1, {n})" if self.spark else f"({array})[1:{n}]"

    def join(self, a: str, b: str) -> str:
        return f"concat({a}, {b})" if self.spark else f"list_concat({a}, {b})"

    def repeat(self, n: int | str, item: str) -> str:
        """List of ``item`` for ``i`` in ``0..n-1``."""
        if self.spark:
            return f"transform(sequence(0L, cast({n} as bigint) - 1), i -> {item})"
        return f"list_transform(range({n}), lambda i: {item})"

    def divided(self, a: str, b: str) -> str:
        """Quotient of whole numbers, cut."""
        return f"(({a}) div ({b}))" if self.spark else f"(({a}) // ({b}))"

    def text(self, value: str | None) -> str:
        """Any text, whatever characters it has."""
        if value is None:
            return f"CAST(NULL AS {'STRING' if self.spark else 'VARCHAR'})"
        octets = f"unhex('{value.encode().hex()}')"
        return f"decode({octets}, 'UTF-8')" if self.spark else f"decode({octets})"

    def pick_text(self, values: tuple[str | None, ...], index: str) -> str:
        whens = " ".join(f"WHEN {i} THEN {self.text(v)}" for i, v in enumerate(values))
        return f"CASE ({index}) % {len(values)} {whens} END"

    def box(self, x0: str, x1: str, y0: str, y1: str) -> str:
        return self.struct(
            xmin=f"({x0}) / 1e6", xmax=f"({x1}) / 1e6", ymin=f"({y0}) / 1e6", ymax=f"({y1}) / 1e6"
        )

    def pick(self, values: tuple[str, ...], index: str) -> str:
        """``values[index]``, null past the end."""
        whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
        return f"CASE {index} {whens} END"


SPARK = Dialect(True)
DUCKDB = Dialect(False)

CENTRE_X, CENTRE_Y = 4_904_100, 52_367_600


def x_of(k: str) -> str:
    return f"({CENTRE_X} + (({k}) * 7919 % 20011 - 10005))"


def y_of(k: str) -> str:
    return f"({CENTRE_Y} + (({k}) * 104729 % 20021 - 10010))"


CATEGORIES = ("car_dealership", "construction_site", "furniture_store", "supermarket", "factory")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
BUILDING_CLASSES = (
    ("1-URGENT", "residential"),
    ("2-HIGH", "commercial"),
    ("3-MEDIUM", "industrial"),
    ("5-LOW", "education"),
)
SURFACES = ("asphalt", "paved", "gravel", "dirt", "cobblestone", "concrete", "sand", "wood")


def places(d: Dialect) -> str:
    """Points of interest, one per customer."""
    k = "c_custkey"
    x, y = x_of(k), y_of(k)
    category = "CASE c_mktsegment " + " ".join(
        f"WHEN '{s}' THEN '{c}'" for s, c in zip(SEGMENTS, CATEGORIES)
    ) + " END"
    address = d.struct(
        freeform=f"CASE {k} % 3 WHEN 1 THEN concat('Street ', {k}) WHEN 2 THEN '' END",
        locality=f"CASE WHEN {k} % 4 = 0 THEN NULL ELSE concat('Town ', {k} % 50) END",
        postcode=f"CASE WHEN {k} % 5 = 0 THEN '' ELSE concat('10', {k} % 100) END",
        region="CAST(NULL AS VARCHAR(9))" if not d.spark else "CAST(NULL AS STRING)",
        country=f"CASE WHEN {k} % 9 < 3 THEN 'NL' END",
    )
    other = d.struct(
        freeform="'Back door'", locality="'X'", postcode="'Y'", region="'Z'", country="'NL'"
    )
    return f"""
SELECT concat('p', {k}) AS id,
  {d.struct(primary=f"CASE WHEN {k} % 10 = 0 THEN NULL ELSE c_name END")} AS names,
  {d.struct(primary=category)} AS categories,
  CASE {k} % 20 WHEN 0 THEN 'permanently_closed' WHEN 1 THEN 'temporarily_closed'
    WHEN 2 THEN NULL ELSE 'open' END AS operating_status,
  ({k} % 100) / 100.0e0 AS confidence,
  CASE {k} % 6 WHEN 0 THEN NULL WHEN 1 THEN {d.array(address, other)} ELSE {d.array(address)} END AS addresses,
  CASE {k} % 4 WHEN 0 THEN {d.array(f"concat('+31', {k})", "'+310'")} END AS phones,
  CASE {k} % 3 WHEN 0 THEN {d.array(f"concat('https://p', {k}, '.example')")} END AS websites,
  CASE {k} % 7 WHEN 0 THEN {d.struct(
      names=d.struct(primary=f"concat('Brand ', {k} % 40)"),
      wikidata=f"CASE WHEN {k} % 2 = 0 THEN concat('Q', {k}) ELSE '' END")}
    WHEN 1 THEN {d.struct(names=d.struct(primary="''"), wikidata="'Q1'")} END AS brand,
  {d.box(f"{x} - 100", f"{x} + 100", f"{y} - 100", f"{y} + 100")} AS bbox,
  'POINT' AS geom_type,
  {d.array(d.array(d.line([(x, y)])))} AS parts
FROM customer"""


def buildings(d: Dialect) -> str:
    """L-shaped footprints, one per order."""
    k = "o_orderkey"
    x, y, s = x_of(k), y_of(k), f"(50 + {k} % 100)"
    ring = d.ring(
        [
            (f"{x} - {s}", f"{y} - {s}"),
            (f"{x} + {s}", f"{y} - {s}"),
            (f"{x} + {s}", y),
            (x, y),
            (x, f"{y} + {s}"),
            (f"{x} - {s}", f"{y} + {s}"),
        ]
    )
    kind = "CASE o_orderpriority " + " ".join(
        f"WHEN '{p}' THEN '{c}'" for p, c in BUILDING_CLASSES
    ) + " END"
    return f"""
SELECT concat('b', {k}) AS id, {kind} AS class,
  {d.box(f"{x} - {s}", f"{x} + {s}", f"{y} - {s}", f"{y} + {s}")} AS bbox,
  'POLYGON' AS geom_type, {d.array(d.array(ring))} AS parts
FROM orders"""


def roads(d: Dialect) -> str:
    """Line segments of two to five vertices, one per event."""
    k = "event_id"
    x, y = x_of(k), y_of(k)
    across = f"(60 + {k} % 50)"
    path = [
        (f"{x} + {i} * {across} + {i * i} * ({k} % 7)", f"{y} + {i} * (35 + {k} % 30) - {i**3} * ({k} % 5)")
        for i in range(5)
    ]
    line = d.head(d.line(path), f"(2 + {k} % 4)")
    last = f"(1 + {k} % 4)"
    top = f"{last} * (35 + {k} % 30)"
    surface = d.struct(value=d.pick(SURFACES, f"{k} % 8"))
    gap = d.struct(value="CAST(NULL AS STRING)" if d.spark else "CAST(NULL AS VARCHAR)")
    tags = {
        "click": d.array(
            d.struct(values="NULL" if not d.spark else "CAST(NULL AS ARRAY<STRING>)"),
            d.struct(values=d.array("'is_bridge'")),
        ),
        "purchase": d.array(d.struct(values=d.array("'is_tunnel'", "'is_link'"))),
        "error": d.array(d.struct(values=d.array("'is_covered'"))),
    }
    flags = " ".join(f"WHEN '{t}' THEN {v}" for t, v in tags.items())
    return f"""
SELECT concat('r', {k}) AS id,
  {d.struct(primary=f"CASE WHEN {k} % 6 = 0 THEN NULL ELSE concat('Road ', {k}) END")} AS names,
  CASE WHEN user_id % 10 = 0 THEN 'rail' ELSE 'road' END AS subtype,
  {d.pick(ROAD_CLASSES, f"{k} % 13")} AS class,
  CASE WHEN {k} % 10 = 0 THEN NULL WHEN {k} % 10 = 1 THEN {d.head(d.array(gap), "0")}
    WHEN {k} % 10 = 5 THEN {d.array(gap, surface)} ELSE {d.array(surface)} END AS road_surface,
  CASE event_type {flags} END AS road_flags,
  {d.box(x, f"{x} + {last} * {across} + {last} * {last} * ({k} % 7)",
         f"{y} - 256", f"{y} + {top}")} AS bbox,
  'LINESTRING' AS geom_type, {d.array(d.array(line))} AS parts
FROM events"""


_CORNERS = ((-8, -6), (0, -9), (8, -5), (10, 1), (7, 7), (0, 10), (-7, 6), (-10, 0))


def land_use(d: Dialect) -> str:
    """Convex parcels of four to eight vertices, one per part."""
    k = "p_partkey"
    x, y, s = x_of(k), y_of(k), f"(20 + {k} % 30)"
    corners = d.line([(f"{x} + {a} * {s}", f"{y} + {b} * {s}") for a, b in _CORNERS])
    ring = d.join(d.head(corners, f"(4 + {k} % 5)"), d.head(corners, "1"))
    source = d.struct(
        property="''",
        dataset=f"CASE WHEN {k} % 2 = 0 THEN 'survey' ELSE 'imagery' END",
        record_id=f"concat('w', {k})",
    )
    empty = d.head(d.array(source), "0")
    return f"""
SELECT concat('l', {k}) AS id,
  {d.struct(primary=f"CASE WHEN {k} % 4 = 0 THEN NULL ELSE p_name END")} AS names,
  {d.pick(SUBTYPES, f"{k} % 23")} AS subtype,
  CASE WHEN {k} % 9 = 0 THEN NULL ELSE lower(p_type) END AS class,
  CASE WHEN {k} % 11 = 0 THEN {empty} ELSE {d.array(source)} END AS sources,
  {d.box(f"{x} - 10 * {s}", f"{x} + 10 * {s}", f"{y} - 9 * {s}", f"{y} + 10 * {s}")} AS bbox,
  'POLYGON' AS geom_type, {d.array(d.array(ring))} AS parts
FROM part"""


def _rectangle(x0: str, x1: str, y0: str, y1: str) -> list[tuple[str, str]]:
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def divisions(d: Dialect) -> str:
    """Administrative areas: a striped country per region (one with a hole, one with an
    island, all with a jagged northern border), provinces and towns per nation, and a
    neighbourhood per supplier."""
    west, south = CENTRE_X - 12_000, CENTRE_Y - 12_000
    r = "r_regionkey"
    x0 = f"({west} + {r} * 4800)"
    north = CENTRE_Y + 12_000
    jagged = d.repeat(100, d.vertex(f"{x0} + 4752 - i * 48", f"{north} + (i % 2) * 500"))
    start = d.line([(x0, str(south)), (f"{x0} + 4752", str(south))])
    shell = d.join(d.join(start, jagged), d.line([(x0, str(south))]))
    hole = d.ring(_rectangle(f"{x0} + 1900", f"{x0} + 2900", str(CENTRE_Y - 500), str(CENTRE_Y + 500)))
    island = d.ring(_rectangle(f"{x0} + 30000", f"{x0} + 31000", str(south), str(south + 900)))
    n = "n_nationkey"
    nx = f"({west} + n_regionkey * 4800)"
    ny = f"({south} + ({n} - {n} % 5) / 5 * 4800)" if d.spark else f"({south} + ({n} // 5) * 4800)"
    ny = f"CAST({ny} AS BIGINT)"
    s = "s_suppkey"
    sx, sy, half = x_of(f"{s} * 17"), y_of(f"{s} * 17"), f"(300 + {s} % 500)"
    far = f"{x0} + CASE WHEN {r} = 4 THEN 31000 ELSE 4752 END"
    return f"""
SELECT concat('c', {r}) AS id, {d.struct(primary="r_name")} AS names, 'country' AS subtype,
  'land' AS class,
  {d.box(x0, far, str(south), f"{north} + 500")} AS bbox,
  CASE WHEN {r} = 4 THEN 'MULTIPOLYGON' ELSE 'POLYGON' END AS geom_type,
  CASE {r} WHEN 4 THEN {d.array(d.array(shell), d.array(island))}
    WHEN 2 THEN {d.array(d.array(shell, hole))} ELSE {d.array(d.array(shell))} END AS parts
FROM region
UNION ALL
SELECT concat('n', {n}), {d.struct(primary="n_name")}, 'region',
  CASE WHEN {n} % 7 = 0 THEN 'maritime' ELSE 'land' END,
  {d.box(nx, f"{nx} + 4752", ny, f"{ny} + 4800")}, 'POLYGON',
  {d.array(d.array(d.ring(_rectangle(nx, f"{nx} + 4752", ny, f"{ny} + 4800"))))}
FROM nation
UNION ALL
SELECT concat('t', {n}), {d.struct(primary="concat('Town of ', n_name)")}, 'locality', 'land',
  {d.box(f"{nx} + 600", f"{nx} + 4000", f"{ny} + 600", f"{ny} + 4100")}, 'POLYGON',
  {d.array(d.array(d.ring(_rectangle(f"{nx} + 600", f"{nx} + 4000", f"{ny} + 600", f"{ny} + 4100"))))}
FROM nation
UNION ALL
SELECT concat('h', {s}), {d.struct(primary="s_name")},
  CASE WHEN {s} % 6 = 0 THEN 'quarter' ELSE 'neighborhood' END, 'land',
  {d.box(f"{sx} - {half}", f"{sx} + {half}", f"{sy} - {half}", f"{sy} + {half}")}, 'POLYGON',
  {d.array(d.array(d.ring(_rectangle(f"{sx} - {half}", f"{sx} + {half}", f"{sy} - {half}", f"{sy} + {half}"))))}
FROM supplier"""


def query_points(d: Dialect) -> str:
    """Valid query points, one per supplier.  Some share one place, some are at sea, at
    a pole, or on the border of a division."""
    k = "s_suppkey"
    west, south = CENTRE_X - 12_000, CENTRE_Y - 12_000
    x = f"""CASE WHEN {k} % 7 = 0 THEN {CENTRE_X} WHEN {k} % 11 = 0 THEN 0
      WHEN {k} % 13 = 0 THEN 0 WHEN {k} % 17 = 0 THEN {west + 4800} ELSE {x_of(f"{k} * 13")} END"""
    y = f"""CASE WHEN {k} % 7 = 0 THEN {CENTRE_Y} WHEN {k} % 11 = 0 THEN 0
      WHEN {k} % 13 = 0 THEN 90000000 - ({k} % 2) * 180000000
      WHEN {k} % 17 = 0 THEN {south + 1000} ELSE {y_of(f"{k} * 13")} END"""
    radius = f"CASE WHEN {k} % 7 = 0 THEN 250 ELSE CASE {k} % 4 WHEN 0 THEN 100 WHEN 1 THEN 250 WHEN 2 THEN 500 ELSE 1000 END END"
    return f"""
SELECT {k} AS query_id, ({y}) / 1e6 AS lat, ({x}) / 1e6 AS lng, {radius} AS radius_m,
  {d.pick(CATEGORIES, f"{k} % 5")} AS category,
  {d.pick(ROAD_CLASSES, f"{k} % 12")} AS road_class,
  {d.pick(SUBTYPES, f"{k} % 22")} AS subtype,
  CASE {k} % 3 WHEN 0 THEN NULL WHEN 1 THEN 5 ELSE 100 END AS "limit",
  {k} % 2 = 0 AS include_closed
FROM supplier""".replace('"limit"', "`limit`" if d.spark else '"limit"')


def raw_points(d: Dialect) -> str:
    """Query points as untyped text, one per customer, many of them malformed."""
    k = "c_custkey"
    text = "STRING" if d.spark else "VARCHAR"
    return f"""
SELECT {k} AS query_id,
  CASE {k} % 12 WHEN 0 THEN '90.001' WHEN 1 THEN 'abc' WHEN 2 THEN 'NaN' WHEN 3 THEN NULL
    WHEN 4 THEN ' 52.5 ' ELSE concat('52.', {k} % 1000 + 1000) END AS lat,
  CASE {k} % 13 WHEN 0 THEN '-180.5' WHEN 1 THEN '180' WHEN 2 THEN '-inf'
    ELSE concat('4.', {k} % 1000 + 1000) END AS lng,
  CASE {k} % 14 WHEN 0 THEN '0' WHEN 1 THEN '50001' WHEN 2 THEN '500.7' WHEN 3 THEN '1e2'
    WHEN 4 THEN 'far' WHEN 5 THEN '-0.5' ELSE CAST({k} % 900 + 1 AS {text}) END AS radius_m,
  CASE {k} % 15 WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN 'Cafe' WHEN 3 THEN ' cafe '
    WHEN 4 THEN NULL WHEN 5 THEN lower(c_mktsegment) ELSE 'restaurant' END AS category,
  CASE {k} % 16 WHEN 0 THEN '0' WHEN 1 THEN '101' WHEN 2 THEN NULL WHEN 3 THEN '7.9'
    ELSE '20' END AS "limit",
  CASE {k} % 4 WHEN 0 THEN 'YES' WHEN 1 THEN '0' WHEN 2 THEN 'true' END AS include_closed
FROM customer""".replace('"limit"', "`limit`" if d.spark else '"limit"')


def searches(d: Dialect) -> str:
    """Catalogue searches, one per part: words of the part, or nothing."""
    k = "p_partkey"
    words = ("store", "COFFEE", " car", "%", "_", "sell", "school", "", "shop selling", "zzz", "a")
    word = d.pick(words, f"{k} % 12")
    return f"""
SELECT {k} AS query_id, CASE WHEN {k} % 5 = 0 THEN p_type ELSE {word} END AS query FROM part"""


#: Edges in one piece of an outline.
PIECE = 4096


def _border(d: Dialect) -> str:
    """Vertex ``i`` of the northern border of a large parcel."""
    west = CENTRE_X - 12_000
    step = d.divided("i * 24000000", "n")
    x = f"(CAST(({west} + r_regionkey * 1000) AS BIGINT) * 1000 + {step}) / 1e9"
    teeth = d.divided("i * 16", "n")
    y = f"({CENTRE_Y + 9_000} + i * 7919 % 2003 - {teeth} % 2 * 6000) / 1e6"
    return d.struct(x=x, y=y)


def _parcel_edges(d: Dialect) -> str:
    return d.divided("(SELECT count(*) FROM orders) * 8", "1 + r_regionkey")


def _parcel_columns(d: Dialect) -> str:
    r = "r_regionkey"
    south = CENTRE_Y - 12_000
    x0 = f"({CENTRE_X - 12_000} + {r} * 1000)"
    source = d.struct(property="''", dataset="'survey'", record_id="''")
    return f"""SELECT concat('z', {r}) AS id, {d.struct(primary="r_name")} AS names, 'park' AS subtype,
  CAST(NULL AS {"STRING" if d.spark else "VARCHAR"}) AS class, {d.array(source)} AS sources,
  {d.box(x0, f"{x0} + 24000", str(south), str(CENTRE_Y + 11_002))} AS bbox, 'POLYGON' AS geom_type"""


def large_parcels(d: Dialect) -> str:
    """A polygon per region with a jagged, stepped northern border; the larger the table of
    orders, the more edges: eight per order in the first region."""
    x0 = f"({CENTRE_X - 12_000} + r_regionkey * 1000)"
    south = CENTRE_Y - 12_000
    corners = d.line([(f"{x0} + 24000", str(south)), (x0, str(south))])
    first = d.line([(x0, str(CENTRE_Y + 9_000))])
    return f"""
{_parcel_columns(d)},
  {d.array(d.array(d.join(d.repeat("n", _border(d)), d.join(corners, first))))} AS parts
FROM (SELECT r_regionkey, r_name, {_parcel_edges(d)} AS n FROM region)"""


def large_parcel_rows(d: Dialect) -> str:
    """The rows of ``large_parcels`` without vertices; ``outline`` tells where they are."""
    return f"""
{_parcel_columns(d)}, r_regionkey AS outline
FROM region"""


def large_outlines(d: Dialect) -> str:
    """Numbers of the pieces of the outlines of ``large_parcels``, of ``PIECE`` edges each.  For
    Spark alone; :func:`outline_piece` makes their vertices."""
    return f"""
SELECT r_regionkey, n, explode(sequence(0L, {d.divided("n + 1", str(PIECE))})) AS at
FROM (SELECT DISTINCT r_regionkey, {_parcel_edges(d)} AS n FROM region)"""


def outline_piece(d: Dialect) -> list[str]:
    """Columns of a piece, from a row of ``large_outlines``.  Vertices ``0`` to ``n - 1`` are the
    border, the last three the corners and the first vertex again."""
    x0 = f"({CENTRE_X - 12_000} + r_regionkey * 1000)"
    south = CENTRE_Y - 12_000
    vertex = f"""CASE WHEN i < n THEN {_border(d)} WHEN i = n THEN {d.vertex(f"{x0} + 24000", str(south))}
      WHEN i = n + 1 THEN {d.vertex(x0, str(south))} ELSE {d.vertex(x0, str(CENTRE_Y + 9_000))} END"""
    low, high = f"at * {PIECE}", f"least((at + 1) * {PIECE}, n + 2)"
    # the border runs east in two heights; the other pieces get the box of the polygon
    column = lambda i: d.divided(f"({i}) * 24000", "n")
    steps = [f"({d.divided(f'({i}) * 16', 'n')} % 2)" for i in (low, high)]
    border = d.box(
        f"{x0} + {column(low)}", f"{x0} + {column(high)} + 1",
        f"{CENTRE_Y + 3_000} + 6000 * least(1 - {steps[0]}, 1 - {steps[1]})",
        f"{CENTRE_Y + 5_002} + 6000 * greatest(1 - {steps[0]}, 1 - {steps[1]})",
    )
    whole = d.box(x0, f"{x0} + 24000", str(south), str(CENTRE_Y + 11_002))
    # a piece as long as a step or longer may hold several
    return [
        "r_regionkey AS outline",
        "at",
        f"CASE WHEN {high} < n AND {PIECE} * 16 < n THEN {border} ELSE {whole} END AS bbox",
        f"transform(sequence({low}, {high}), i -> {vertex}) AS line",
    ]


def _beside_date_line(k: str, gap: int) -> str:
    """Longitude of a key on either side of the date line, ``gap`` or more from it."""
    off = f"(({k}) * 7919 % 20011 - 10005)"
    return f"CASE WHEN {off} >= 0 THEN {off} + {gap} - 180000000 ELSE {off} - {gap} + 180000000 END"


def dateline_buildings(d: Dialect) -> str:
    """Square footprints on both sides of the date line, one per order."""
    k, s = "o_orderkey", "(50 + k % 100)"
    ring = d.ring(_rectangle(f"x - {s}", f"x + {s}", f"y - {s}", f"y + {s}"))
    return f"""
SELECT concat('d', k) AS id, 'house' AS class,
  {d.box(f"x - {s}", f"x + {s}", f"y - {s}", f"y + {s}")} AS bbox,
  'POLYGON' AS geom_type, {d.array(d.array(ring))} AS parts
FROM (SELECT {k} AS k, {_beside_date_line(k, 200)} AS x, {y_of(k)} AS y FROM orders)"""


def dateline_points(d: Dialect) -> str:
    """Query points on both sides of the date line, one per supplier."""
    k = "s_suppkey"
    radius = f"CASE {k} % 4 WHEN 0 THEN 100 WHEN 1 THEN 250 WHEN 2 THEN 500 ELSE 1000 END"
    return f"""
SELECT {k} AS query_id, ({y_of(f"{k} * 13")}) / 1e6 AS lat,
  ({_beside_date_line(f"{k} * 13", 0)}) / 1e6 AS lng, {radius} AS radius_m
FROM supplier"""


#: Parameters as text in all the ways callers write them.
DEGREES = (
    "52.5", "1_0.2_5", "1__0", "_1", "abc", "NaN", " -inf\n", None, "", "１２.５", "١٫٥", "+.5e1", "5.", ".",
    "90.0001", "-200", "1e400", "1e16", "0x10", "it's", 'a "b"', "both ' and \"", "tab\t", "\u2003 7 \u3000", "\x1c1",
    "\u200b1", "back\\slash", "☕", "-0", "1d",
)
RADII = ("500", "500.7", "0", "-0.5", "50000", "50001", "1e3", "1_000", "far", None, "inf", "9e18", "1e22", " ٣٠٠ ")
LIMITS = (None, "20", "0", "101", "7.9", "1_0", "many", "-3")
ROAD_WORDS = (" Residential ", "motorway", "rail", "", "   ", None, "PATH\u2003", "it's", "spaceway")
SUBTYPE_WORDS = ("park", " Forest", "moon", "", "\u3000", None, "QUARRY", "☕☕")
QUERY_WORDS = ("store", "  car ", "", " \u2003 ", None, "ラーメン", "%", "\x85x\x85")


def raw_calls(d: Dialect) -> str:
    """Calls with parameters as untyped text, one per customer."""
    k = "c_custkey"
    picked = {
        "lat": d.pick_text(DEGREES, f"CASE WHEN {k} % 3 = 0 THEN {k} ELSE 0 END"),
        "lng": d.pick_text(DEGREES, f"CASE WHEN {k} % 3 = 1 THEN {k} ELSE 0 END"),
        "radius_m": d.pick_text(RADII, k),
        "max_radius_m": d.pick_text(RADII, f"{k} + 3"),
        "limit": d.pick_text(LIMITS, f"{k} * 3"),
        "road_class": d.pick_text(ROAD_WORDS, k),
        "subtype": d.pick_text(SUBTYPE_WORDS, k),
        "query": d.pick_text(QUERY_WORDS, k),
        "include_geometry": d.pick_text(("YES", "0", None, "true", "no"), k),
    }
    quote = "`" if d.spark else '"'
    columns = ", ".join(f"{text} AS {quote}{name}{quote}" for name, text in picked.items())
    return f"SELECT {k} AS query_id, {columns} FROM customer"


def kinds(d: Dialect) -> str:
    """Entries of a taxonomy, one per market segment, brand and size of the tables."""
    return """
SELECT DISTINCT lower(c_mktsegment) AS category, CASE WHEN c_mktsegment < 'F' THEN concat('About "', c_mktsegment, '"') END AS description FROM customer
UNION ALL SELECT DISTINCT lower(p_brand), concat('Brand of size ', CAST(max(p_size) AS STRING)) FROM part GROUP BY p_brand""".replace("STRING", "STRING" if d.spark else "VARCHAR")
