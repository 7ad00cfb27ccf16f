import pytest
from pyspark.sql import functions as F

from wakeline.functions import geo

#: Published lines on the ellipsoid: two positions and the distance in km.
LINES = [
    ((-37.951033417, 144.424867889), (-37.652821139, 143.926495528), 54.972271),
    ((40.6, -73.8), (51.6, -0.5), 5551.759400),
    ((0.0, 0.0), (0.0, 1.0), 111.319491),
    ((0.0, 30.0), (90.0, -100.0), 10001.965729),
    ((10.0, 179.5), (10.0, -179.5), 109.639373),
    ((5.0, 5.0), (5.0, 5.0), 0.0),
]


def distances(spark, pairs):
    df = spark.createDataFrame([(i, *a, *b) for i, (a, b) in enumerate(pairs)], "i long, a double, b double, c double, d double")
    done = df.select("i", geo.geodesic_km(*map(F.col, "abcd")).alias("km"), geo.geodesic_km(*map(F.col, "cdab")).alias("back"), geo.geo_distance_km(*map(F.col, "abcd")).alias("sphere"))
    return [tuple(r)[1:] for r in done.orderBy("i").collect()]


def test_published_lines(spark):
    for (_, _, want), (km, back, _) in zip(LINES, distances(spark, [line[:2] for line in LINES]), strict=True):
        assert km == pytest.approx(want, abs=1e-3) and back == pytest.approx(km, abs=1e-6)


def test_antipodes_and_nulls(spark):
    pairs = [((0.0, 0.0), (0.0, 180.0)), ((30.0, 10.0), (-30.0, -170.0)), ((90.0, 0.0), (-90.0, 77.0)), ((0.0, 0.0), (0.5, 179.5)), ((-41.32, 174.81), (40.96, -5.50))]
    got = distances(spark, pairs)
    for km, _, _ in got[:3]:
        assert km == pytest.approx(20003.931459, abs=1e-3)
    for (km, back, sphere), least in zip(got[3:], (19936.288579, 19959.679267), strict=True):
        assert least - 1e-3 <= km < 20003.94 and back == pytest.approx(km) and abs(km - sphere) < 60
    assert spark.range(1).select(geo.geodesic_km(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0))).first()[0] is None
