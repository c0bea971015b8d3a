import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.brute import geodesic
from waymark.functions.geodesy import whole_metres, with_position, within_distance


def measured(spark, pairs: pd.DataFrame, radius: float) -> pd.Series:
    df = spark.createDataFrame(pairs.reset_index(names="i")).withColumn("r", F.lit(radius))
    df = with_position(with_position(df, "x1", "y1", "a"), "x2", "y2", "b")
    rows = within_distance(df, "a", "b", "r").select("i", "distance").toPandas()
    return rows.set_index("i").distance


@pytest.mark.parametrize("reach", [50, 5_000, 50_000])
def test_agrees_with_the_converged_geodesic(spark, reach):
    rng = np.random.default_rng(reach)
    n = 20_000
    y1 = rng.uniform(-89.4, 89.4, n)
    x1 = rng.uniform(-180, 180, n)
    d, turn = rng.uniform(0, reach, n), rng.uniform(0, 2 * np.pi, n)
    y2 = np.clip(y1 + d * np.cos(turn) / 111_320, -90, 90)
    x2 = x1 + d * np.sin(turn) / 111_320 / np.cos(np.radians(y1))
    pairs = pd.DataFrame({"x1": x1, "y1": y1, "x2": x2, "y2": y2})
    want = pd.Series(geodesic(x1, y1, x2, y2))
    got = measured(spark, pairs, 60_000.0)
    assert len(got) == n
    assert (got - want).abs().max() < 1e-6
    # the radius test takes exactly the pairs below the radius
    assert set(measured(spark, pairs, reach / 2).index) == set(want[want < reach / 2].index)


def test_known_lines(spark):
    pairs = pd.DataFrame(
        {  # a surveyed line, a meridian second near the pole, one and the same place
            "x1": [144.42486788, 10.0, 4.9041],
            "y1": [-37.95103341, 89.9, 52.3676],
            "x2": [143.92649552, -170.0, 4.9041],
            "y2": [-37.65282114, 89.9, 52.3676],
        }
    )
    got = measured(spark, pairs, 100_000.0)
    assert got[0] == pytest.approx(54972.271, abs=1e-3)
    assert got[1] == pytest.approx(2 * 11169.4, abs=2)
    assert got[2] == 0


def test_metres_round_half_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (499.7,), (499.4,)], "d double")
    got = [r[0] for r in df.select(whole_metres(F.col("d"))).collect()]
    assert got == [0, 2, 2, 500, 499]
