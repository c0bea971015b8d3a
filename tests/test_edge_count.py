"""Counting edges by the sizes of rings against listing them."""

from pyspark.sql import functions as F

from waymark.functions import geometry


def test_edges_are_counted_without_being_listed(spark):
    spot = {"x": 1.0, "y": 2.0}
    ring = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 0.0))]
    hidden = [{"x": None, "y": None}, *ring]
    shapes = [None, [], [[]], [[[]]], [[[spot]]], [[ring]], [[ring, [spot, spot]]], [[], [ring]], [[ring], [[], ring]],
              [[hidden]], [None, [ring]], [[ring, None]], [[[None, spot, spot]]]]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], f"i int, parts {geometry.PARTS_TYPE}").cache()
    listed = F.array_size(geometry.all_segments("parts"))
    found = frame.select("i", geometry.edge_count("parts").alias("n"), listed.alias("want"))
    assert found.schema["n"].dataType == found.schema["want"].dataType
    assert found.where("NOT n <=> want").collect() == []
    assert [r.n for r in found.orderBy("i").collect()][4:7] == [0, 3, 4]
