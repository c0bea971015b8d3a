import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import literals
from waymark.operators.screening import (
    OPERATOR_PARAMETERS, accepted_points, rejected_points, screen_points,
)
from waymark.plans.limits import Limits
from waymark.sources.taxonomy import load_taxonomy

COLUMNS = "query_id int, lat string, lng string, radius_m string, category string, limit string"
GOOD = ("52.5", "4.9", "500", "cafe", "20")

CASES = [
    (GOOD, None, None),
    (("90", "-180", "500.7", " cafe\n", None), None, None),
    (("90.001", "4.9", "500", "cafe", "20"), "lat", "lat must be between -90 and 90. Received: 90.001"),
    (("abc", "4.9", "500", "cafe", "20"), "lat", "lat must be a number. Received: 'abc'"),
    (("1d", "4.9", "500", "cafe", "20"), "lat", "lat must be a number. Received: '1d'"),
    ((None, "4.9", "500", "cafe", "20"), "lat", "lat must be a number. Received: None"),
    (("NaN", "4.9", "500", "cafe", "20"), "lat", "lat must be a finite number. Received: 'NaN'"),
    (("52", "-inf", "500", "cafe", "20"), "lng", "lng must be a finite number. Received: '-inf'"),
    (("52", "4.9", "0.9", "cafe", "20"), "radius_m", "radius_m must be between 1 and 50000. Received: 0"),
    (("52", "4.9", "50001", "cafe", "20"), "radius_m", "radius_m must be between 1 and 50000. Received: 50001"),
    (("52", "4.9", "inf", "cafe", "20"), "radius_m", "radius_m must be a number. Received: 'inf'"),
    (("52", "4.9", "5", "", "20"), "category", "category is required and must be a non-empty string."),
    (("52", "4.9", "5", " ", "20"), "category", "category must be a non-empty string."),
    (("52", "4.9", "5", "Cafe", "20"), "category", "Unknown category: 'Cafe'. Use get_place_categories to find valid categories."),
    (("52", "4.9", "5", "cafe", "101"), "limit", "limit must be between 1 and 100. Received: 101"),
    (("52", "4.9", "5", "cafe", "x"), "limit", "limit must be a number. Received: 'x'"),
]


def test_first_bad_parameter_is_reported(spark):
    points = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(CASES)], COLUMNS)
    taxonomy = load_taxonomy(spark)
    screened = screen_points(points, "places_in_radius", taxonomy).orderBy("query_id").collect()
    assert [(r.error_param, r.error) for r in screened] == [c[1:] for c in CASES]
    assert (screened[1].radius_m, screened[1].category, screened[1].limit) == (500, "cafe", 20)
    kept = accepted_points(points, "places_in_radius", taxonomy).collect()
    assert sorted(r.query_id for r in kept) == [0, 1]
    assert rejected_points(points, "places_in_radius", taxonomy).count() == len(CASES) - 2


def test_words_and_flags(spark):
    rows = [(0, " Residential ", "YES"), (1, "rail", "0"), (2, None, None)]
    points = spark.createDataFrame(
        [(i, 1.0, 2.0, w, f) for i, w, f in rows],
        "query_id int, lat double, lng double, road_class string, include_geometry string",
    )
    got = screen_points(points, "nearest_road_of_class").orderBy("query_id").collect()
    assert [r.road_class for r in got] == ["residential", None, None]
    assert [r.include_geometry for r in got] == [True, False, False]
    assert [r.radius_m for r in got] == [5000] * 3
    assert got[1].error.startswith("Unknown road_class: 'rail'. Valid values: cycleway, footway")


@pytest.mark.parametrize("operator", sorted(OPERATOR_PARAMETERS))
def test_numbers_of_any_type(spark, operator):
    points = spark.createDataFrame(
        [(1, 1, 2.5, 500, "cafe", "path", "park"), (2, 91, 2.5, 500, "cafe", "path", "park")],
        "query_id int, lat int, lng float, radius_m long, category string, road_class string, subtype string",
    )
    if operator == "category_catalog":
        return
    kept = accepted_points(points, operator, load_taxonomy(spark)).collect()
    assert [r.query_id for r in kept] == [1]


def shown(value):
    return repr(value)


def texts():
    rng = random.Random(3)
    digits = list("0123456789") + ["١", "٢", "９", "０", "𝟘", "५"]
    made = ["", " ", "1_0", "1__0", "_1", "1_", "1._5", ".5", "5.", ".", "+.5e-1_0", "1e400", "-1e400", "inf", "-Infinity", "nan", "+NaN", "infinit",
            " 1 ", "\x1c1", "​1", "1\n", "1\x85", "１２．５", "it's", 'say "hi"', "both ' and \"", "back\\slash", "tab\there", "nul\0", "\x7f", "é", "­", "",
            "🙂", "\U000e0001", "a b", "　", "'", '"', "1d", "0x10", "1e5f", "١٢٣", "1,5"]
    for _ in range(600):
        parts = [rng.choice(["", "", "+", "-"]), *rng.choices([*digits, "_", ".", "e", "E"], k=rng.randint(1, 6))]
        made.append(rng.choice(["", "", " ", "\t", " "]) + "".join(parts) + rng.choice(["", "", "\n", "\xa0"]))
    for _ in range(300):
        made.append("".join(chr(rng.choice([*range(32, 127), 0, 9, 10, 13, 39, 34, 92, 133, 160, 173, 0x300, 0x2029, 0xFFFD, 0x1F600, 0xF0000])) for _ in range(rng.randint(1, 5))))
    return made


def parsed(text):
    try:
        return float(text)
    except ValueError:
        return None


def test_texts_are_read_and_shown_like_the_answered_calls_do(spark):
    made = texts()
    frame = spark.createDataFrame(list(enumerate(made)), "i int, t string")
    value, is_number = literals.number(F.col("t"))
    rows = frame.select("t", value.alias("v"), is_number.alias("n"), literals.shown_text(F.col("t")).alias("s"), literals.stripped(F.col("t")).alias("w"))
    for r in rows.collect():
        want = parsed(r.t)
        assert r.n == (want is not None), ascii(r.t)
        if want is None or want != want or (math.isinf(want) and "n" in r.t.lower()):
            assert r.v is None, ascii(r.t)
        else:
            assert r.v == want, ascii(r.t)
        assert r.s == shown(r.t), ascii(r.t)
        assert r.w == r.t.strip(), ascii(r.t)


def test_numbers_are_shown_like_the_answered_calls_do(spark):
    rng = random.Random(4)
    made = [0.0, -0.0, 1.0, 91.0, -180.5, 1e15, 1e16, 123456789012345680.0, 1e-4, 1e-5, 1.5e-7, 5e-324, 1.7976931348623157e308, 2e23, 0.1 + 0.2, 2.0**62, 2.0**63, 1e22, 9.007199254740993e15,
            float("nan"), float("inf"), float("-inf")]
    made += [rng.choice([-1, 1]) * 10 ** rng.uniform(-30, 36) for _ in range(500)] + [round(rng.uniform(-400, 400), rng.randint(0, 9)) for _ in range(500)]
    frame = spark.createDataFrame([(x,) for x in made], "v double")
    for r in frame.select("v", literals.shown_number(F.col("v")).alias("s"), literals.shown_whole(F.col("v")).alias("w")).collect():
        exact = 2.0**53 <= abs(r.v) < 1e37 or len(shown(r.v)) < 16 or not math.isfinite(r.v)
        assert r.s == shown(r.v) if exact else (float(r.s) == r.v and len(r.s) <= len(shown(r.v)) + 1), r.v
        if math.isfinite(r.v) and abs(r.v) < 1e37:
            assert r.w == str(int(r.v)).replace("-0", "0") if int(r.v) == 0 else r.w == str(int(r.v))


def test_limits_are_settings(spark):
    points = spark.createDataFrame([(1, 1.0, 2.0, 700, "path", None), (2, 1.0, 2.0, 60_000, "path", 5)], "query_id int, lat double, lng double, radius_m int, road_class string, max_radius_m int")
    wide, narrow = Limits(max_radius_m=60_000), Limits(max_radius_m=500, null_is_omitted=False)
    ids = lambda limits, op: [r.query_id for r in accepted_points(points, op, limits=limits).collect()]
    assert ids(wide, "building_count_in_radius") == [1, 2] and ids(narrow, "building_count_in_radius") == []
    assert ids(Limits(), "nearest_road_of_class") == [1, 2] and ids(narrow, "nearest_road_of_class") == [2]
    bad = {r.query_id: r.error for r in rejected_points(points, "nearest_road_of_class", limits=narrow).collect()}
    assert bad == {1: "radius_m must be a number. Received: None"}
    with pytest.raises(ValueError):
        Limits(max_results=0)


def test_search_texts(spark):
    rows = spark.createDataFrame([(1, " store "), (2, "  "), (3, None)], "query_id int, query string")
    assert [r["query"] for r in screen_points(rows, "category_catalog").orderBy("query_id").collect()] == ["store", None, None]
    numbers = spark.createDataFrame([(1, 5), (2, None)], "query_id int, query int")
    assert [r.error for r in screen_points(numbers, "category_catalog").orderBy("query_id").collect()] == ["query must be a string. Received: int", None]
    assert accepted_points(numbers, "category_catalog").count() == 1
