import struct

import pytest
from pyspark.sql import functions as F

from waymark.functions import geometry, wkb
from waymark.sources.layers import normalise_geometry
from workload.geometry_bytes import encode

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
HOLE = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
FAR = [(10.0, 0.0), (12.0, 0.0), (12.0, 2.0), (10.0, 2.0), (10.0, 0.0)]


def frame(spark, *rows):
    data = [
        (i, kind, [[[{"x": x, "y": y} for x, y in ring] for ring in poly] for poly in parts])
        for i, (kind, parts) in enumerate(rows)
    ]
    return spark.createDataFrame(data, f"i int, geom_type string, parts {geometry.PARTS_TYPE}")


def rep(spark, kind, parts):
    row = frame(spark, (kind, parts)).select(
        geometry.representative_point("geom_type", "parts").alias("p")
    ).first()["p"]
    return None if row is None else (row.x, row.y)


@pytest.mark.parametrize(
    "kind, parts, want",
    [
        ("POINT", [[[(3.0, 5.0)]]], (3, 5)),
        ("POLYGON", [[SQUARE]], (2, 2)),
        ("POLYGON", [[SQUARE[::-1]]], (2, 2)),
        # 16 - 1 area; the hole pushes the centroid away, whatever its direction
        ("POLYGON", [[SQUARE, HOLE]], ((32 - 1.5) / 15, (32 - 1.5) / 15)),
        ("POLYGON", [[SQUARE, HOLE[::-1]]], ((32 - 1.5) / 15, (32 - 1.5) / 15)),
        ("MULTIPOLYGON", [[SQUARE], [FAR]], ((32 + 44) / 20, (32 + 4) / 20)),
        # no area: the outline counts
        ("POLYGON", [[[(0.0, 0.0), (2.0, 0.0), (0.0, 0.0)]]], (1, 0)),
        ("POLYGON", [[[(7.0, 7.0), (7.0, 7.0), (7.0, 7.0)]]], (7, 7)),
        # interior vertex nearest to the centroid, the first on ties
        ("LINESTRING", [[[(0.0, 0.0), (1.0, 0.0), (9.0, 0.0), (10.0, 0.0)]]], (1, 0)),
        ("LINESTRING", [[[(0.0, 0.0), (1.0, 0.0), (6.0, 0.0), (10.0, 0.0)]]], (6, 0)),
        ("LINESTRING", [[[(0.0, 0.0), (8.0, 0.0), (10.0, 0.0)]]], (8, 0)),
        ("LINESTRING", [[[(0.0, 0.0), (8.0, 0.0)]]], (0, 0)),
        ("POLYGON", [], None),
    ],
)
def test_representative_point(spark, kind, parts, want):
    got = rep(spark, kind, parts)
    assert got == (None if want is None else pytest.approx(want))


@pytest.mark.parametrize(
    "x, y, want",
    [
        (3.0, 3.0, True), (1.5, 1.5, False), (5.0, 1.0, False), (11.0, 1.0, True),
        (0.0, 2.0, False), (4.0, 4.0, False), (2.0, 4.0, False), (1.0, 1.5, False),
        (0.5, 2.0, True), (0.5, 1.0, True), (3.0, 2.0, True), (-1.0, 0.0, False),
    ],
)
def test_encloses(spark, x, y, want):
    df = frame(spark, ("MULTIPOLYGON", [[SQUARE, HOLE], [FAR]])).select(
        geometry.all_segments("parts").alias("s"), F.lit(x).alias("x"), F.lit(y).alias("y")
    )
    assert df.select(geometry.encloses("s", "x", "y")).first()[0] is want


def test_text(spark):
    rows = frame(
        spark,
        ("POINT", [[[(4.0, 52.5)]]]),
        ("LINESTRING", [[[(0.0, -0.5), (0.0005, 0.00002), (1e-7, 2.5e-6)]]]),
        ("POLYGON", [[SQUARE, HOLE]]),
        ("MULTIPOLYGON", [[SQUARE], [FAR]]),
        ("POLYGON", []),
    )
    got = [r[0] for r in rows.orderBy("i").select(geometry.as_text("geom_type", "parts")).collect()]
    assert got == [
        "POINT (4 52.5)",
        "LINESTRING (0 -0.5, 0.0005 2e-05, 1e-07 2.5e-06)",
        "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))",
        "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0)), ((10 0, 12 0, 12 2, 10 2, 10 0)))",
        "POLYGON EMPTY",
    ]


def test_wkb_round_trip(spark):
    df = frame(
        spark,
        ("POINT", [[[(4.0, 52.5)]]]),
        ("LINESTRING", [[[(0.0, -0.5), (1.0, 2.0)]]]),
        ("POLYGON", [[SQUARE, HOLE]]),
        ("MULTIPOLYGON", [[SQUARE, HOLE], [FAR]]),
        ("MULTILINESTRING", [[[(0.0, 0.0), (1.0, 1.0)]], [[(2.0, 2.0), (3.0, 3.0)]]]),
        ("MULTIPOINT", [[[(1.0, 2.0)]], [[(3.0, 4.0)]]]),
    )
    again = wkb.decode(encode(df))
    assert again.orderBy("i").collect() == df.orderBy("i").collect()


def test_wkb_variants(spark):
    big_endian = struct.pack(">BIdd", 0, 1, 4.0, 52.5)
    with_srid = struct.pack("<BIIdd", 1, 0x20000001, 4326, 4.0, 52.5)
    with_z = struct.pack("<BIddd", 1, 1001, 4.0, 52.5, 9.0)
    flag_z = struct.pack("<BIddd", 1, 0x80000001, 4.0, 52.5, 9.0)
    rows = [(i, b) for i, b in enumerate([big_endian, with_srid, with_z, flag_z, None])]
    got = normalise_geometry(spark.createDataFrame(rows, "i int, geometry binary"))
    got = got.orderBy("i").select("geom_type", "rep_x", "rep_y").collect()
    assert [tuple(r) for r in got] == [("POINT", 4.0, 52.5)] * 4 + [(None, None, None)]


class PlainReader:
    """One geometry, byte by byte."""

    def __init__(self, data):
        self.data, self.at = data, 0

    def take(self, form):
        values = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return values

    def header(self):
        (order,) = self.take("B")
        if order > 1:
            raise ValueError("unknown byte order")
        order = "<" if order else ">"
        (code,) = self.take(order + "I")
        dims = 2 + (code >> 31 & 1) + (code >> 30 & 1)
        if code >> 29 & 1:
            self.at += 4
        code &= 0x1FFFFFFF
        dims += {0: 0, 1: 1, 2: 1, 3: 2}.get(code // 1000, 0)
        if code // 1000 > 3 or not 1 <= code % 1000 <= 6:
            raise ValueError("unsupported type")
        return order, code % 1000, dims

    def ring(self, order, dims, n=None):
        n = self.take(order + "I")[0] if n is None else n
        if 8 * n * dims > len(self.data) - self.at:
            raise struct.error
        return [self.take(f"{order}{dims}d")[:2] for _ in range(n)]

    def part(self, order, code, dims):
        if code == 1:
            point = self.ring(order, dims, 1)
            return [] if point[0][0] != point[0][0] or point[0][1] != point[0][1] else [point]
        if code == 2:
            line = self.ring(order, dims)
            return [line] if line else []
        return [self.ring(order, dims) for _ in range(self.take(order + "I")[0])]

    def read(self):
        order, code, dims = self.header()
        parts = []
        if code <= 3:
            parts.append(self.part(order, code, dims))
        else:
            for _ in range(self.take(order + "I")[0]):
                order, member, dims = self.header()
                if member != code - 3:
                    raise ValueError("mixed members")
                parts.append(self.part(order, member, dims))
        if self.at != len(self.data):
            raise ValueError("trailing bytes")
        return wkb.TYPE_NAMES[code], [p for p in parts if p]


def plain(data):
    """Type, parts and error of one geometry."""
    if data is None:
        return None, None, None
    try:
        return *PlainReader(data).read(), None
    except struct.error:
        return None, None, "truncated"
    except ValueError as error:
        return None, None, str(error)


def some_geometry(rng, depth=0):
    order = rng.choice("<>")
    extra, flag = rng.choice([(0, 0), (0, 1000), (0, 3000), (0x80000000, 0), (0x20000000, 0), (0xE0000000, 0)])
    dims = 2 + {0: 0, 1000: 1, 3000: 2}[flag] + (extra >> 31) + (extra >> 30 & 1)
    code = rng.randint(1, 3) if depth else rng.randint(1, 6)
    number = lambda n: struct.pack(order + "I", n)
    head = struct.pack(order + "BI", order == "<", (code + flag) | extra) + b"srid" * (extra >> 29 & 1)
    vertices = lambda n: struct.pack(f"{order}{n * dims}d", *[rng.choice([rng.uniform(-9, 9), 0.0, float("nan")]) if rng.random() < 0.1 else rng.uniform(-180, 180) for _ in range(n * dims)])
    line = lambda: (lambda n: number(n) + vertices(n))(rng.choice([0, 1, 2, 5, 30]))
    if code == 1:
        return head + vertices(1)
    if code == 2:
        return head + line()
    if code == 3:
        n = rng.choice([0, 1, 1, 1, 4])
        return head + number(n) + b"".join(line() for _ in range(n))
    members = []
    for _ in range(rng.choice([0, 1, 3])):
        while True:
            member = some_geometry(rng, 1)
            if PlainReader(member).header()[1] == code - 3 or rng.random() < 0.02:
                break
        members.append(member)
    return head + number(len(members)) + b"".join(members)


def test_any_bytes_decode_like_a_plain_reader(spark):
    import random

    rng = random.Random(11)
    data = [None, b"", b"\x01", bytes(5), b"\x01\x07\x00\x00\x00" + bytes(8)]
    for _ in range(3000):
        made = bytearray(some_geometry(rng))
        fate = rng.random()
        if fate < 0.1:
            made = made[: rng.randrange(len(made) + 1)]
        elif fate < 0.2:
            made[rng.randrange(len(made))] = rng.randrange(256)
        elif fate < 0.25:
            made += b"\0"
        elif fate < 0.3:
            made[0] = 9
        data.append(bytes(made))
    frame = spark.createDataFrame(list(enumerate(data)), "i int, geometry binary")
    rows = wkb.decode(frame, "geometry", "why").orderBy("i").collect()
    for row, bytes_ in zip(rows, data, strict=True):
        parts = None if row.parts is None else [[[(p.x, p.y) for p in ring] for ring in part] for part in row.parts]
        # as text, for not-a-number equals itself there
        assert (row.geom_type, repr(parts), row.why) == (lambda t, p, e: (t, repr(p), e))(*plain(bytes_)), bytes_
    assert {r.why for r in rows} == set(wkb.ERRORS)


def test_broken_geometry_is_kept_apart(spark):
    good = struct.pack("<BIdd", 1, 1, 4.0, 52.5)
    rows = [(1, good), (2, good[:-1]), (3, None)]
    found = normalise_geometry(spark.createDataFrame(rows, "i int, geometry binary")).orderBy("i")
    assert [(r.rep_x, r.geometry_error) for r in found.collect()] == [(4.0, None), (None, "truncated"), (None, None)]
