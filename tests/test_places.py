"""The nearest of a few places."""

from tessera.functions import ingest


def test_a_point_stays_one_row(spark):
    points = spark.createDataFrame([(1, 10.0, 10.0), (2, None, 1.0), (3, 50.0, 50.0)], "k long, lat double, lon double")
    places = spark.createDataFrame([("b", 10.0, 10.0), ("a", 10.0, 10.0), ("c", 51.0, 50.0)], "place string, g_lat double, g_lon double")
    found = ingest.nearest_place(points, places, "k")
    assert sorted((r.k, r.place) for r in found.collect()) == [(1, "a"), (3, "c")]
    assert "array_min" in found._jdf.queryExecution().executedPlan().toString()
    assert ingest.nearest_place(points, places.limit(0), "k").count() == 0
