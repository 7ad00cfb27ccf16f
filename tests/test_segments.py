import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wakeline.operators import segments, voyages

PORTS = "pos long, portcode string, country_code string, city_code string, country_name string, city_name string, latitude double, longitude double"
ROWS = "event_id long, mmsi long, imo long, dt_pos_utc timestamp, sog double, nav_status string, latitude double, longitude double, destination string"


def history(n_long=1500):
    rng, rows, number = random.Random(3), [], 0
    for ship, n in [(1, n_long), *((s, rng.choice([1, 2, 40, 150])) for s in range(2, 14))]:
        at, lon = datetime(2020, 1, 1), rng.uniform(-179, 179)
        for _ in range(n):
            number += 1
            at += timedelta(hours=rng.choice([1, 6, 30, 200]))
            lon = (lon + rng.choice([0, 0, 0.5, 2, 60 if rng.random() < 0.05 else 1]) + 180) % 360 - 180
            rows.append((number, ship, 9000 + ship, at, rng.choice([None, 0.5, 2.0, 9.0, 12.0, 45.0]), rng.choice(["moored", "under way", None]), rng.uniform(-2, 2), lon, rng.choice(["A", "A", "A", "B", None])))
    return rows + [(number + 1, 5, 9005, None, 1.0, "moored", 0.0, 0.0, "A"), (number + 2, 0, 9, datetime(2020, 1, 1), 1.0, "moored", 0.0, 0.0, "A")]


def test_pieces_equal_the_extraction_by_ship(spark):
    ports = spark.createDataFrame([(i, f"P{i:03}", "", "", "", "", 0.0, float(i * 3 - 180)) for i in range(120)], PORTS)
    df = spark.createDataFrame(history(), ROWS)
    pa, va = voyages.extract_voyages(df, ports, 100.0, 10.0, 2)
    for unit in ("month", "day"):
        pb, vb = segments.extract_voyages(df, ports, 100.0, 10.0, 2, unit)
        columns = ["event_id", "mmsi", "voyage_id", "sog", "cut"]
        want = sorted(map(tuple, pa.select(*columns).collect()))
        assert sorted(map(tuple, pb.select(*columns).collect())) == want and len(want) > 500
        rounded = lambda v: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in v.select(*sorted(va.columns)).collect()), key=repr)
        assert rounded(vb) == rounded(va) and va.count() > 20
    assert segments.extract_voyages(df.limit(0), ports)[1].count() == 0


def test_a_ship_with_half_the_rows_is_split(spark):
    df = segments.in_pieces(spark.createDataFrame([r for r in history(4000) if r[1]], ROWS))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little data would be put together again
    try:
        rows = segments.with_neighbours(df)
        spread = rows.filter("mmsi = 1").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    n = sum(r["count"] for r in spread)
    assert n > df.count() / 2 and max(r["count"] for r in spread) < 0.6 * n
    groups = df.groupBy("mmsi", segments.PIECE).count().agg(F.max("count")).first()[0]
    assert groups < 0.05 * n  # what must meet in one task


def test_rows_given_are_read_by_written_steps_only(spark):
    ports = spark.createDataFrame([(i, f"P{i:03}", "", "", "", "", 0.0, float(i * 3 - 180)) for i in range(120)], PORTS)
    df = spark.createDataFrame(history(100), ROWS)
    for build in (voyages.extract_voyages, segments.extract_voyages):
        plan = build(df, ports, 100.0, 10.0, 2)[1]._jdf.queryExecution().optimizedPlan().toString()
        assert "LogicalRDD" not in plan and "LocalRelation" not in plan
