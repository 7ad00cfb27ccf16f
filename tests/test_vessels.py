from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wakeline import schemas
from wakeline.functions import geo
from wakeline.operators import carry, coding, tracks, voyages
from wakeline.sources import tables as S

PORTS = "pos long, portcode string, country_code string, city_code string, country_name string, city_name string, latitude double, longitude double"
T0 = datetime(2024, 1, 1)


def ports(spark, *codes):
    return spark.createDataFrame([(i, c, c[:2], c[2:], "Land", "City" + c, 0.0, float(i)) for i, c in enumerate(codes)], PORTS)


@pytest.mark.parametrize(
    "text,confidence,codes,pred,code,resolution",
    [
        ("for orders", 99.0, [], "KRPUS", "", "noise"),
        ("busan", 90.0, ["BUSAN"], "KRPUS", "KRPUS", "model"),
        ("busan for order", 49.99, [], "KRPUS", "", "noise"),
        ("busan for order", 50.0, [], "KRPUS", "KRPUS", "model"),
        ("xyzw", 10.0, [], "KRPUS", "", "low"),
        ("shacn", 60.0, ["CNSHA", "SHACN"], "KRPUS", "CNSHA", "dictionary"),
        ("cnsha", 60.0, ["CNSHA"], "KRPUS", "CNSHA", "dictionary"),
        ("eta to cnsha", 60.0, ["CNSHA"], "KRPUS", "CNSHA", "dictionary"),
        ("ab cd", 60.0, [], "KRPUS", "KRPUS", "model"),
        ("12345", 60.0, [], "", "", "model"),
    ],
)
def test_ladder(spark, text, confidence, codes, pred, code, resolution):
    df = spark.createDataFrame([(text, pred, confidence)], "clean_dest string, pred string, confidence double")
    row = coding.hybrid_code(df, ports(spark, *(codes or ["ZZZZZ"]))).first()
    assert (row["code"], row["resolution"]) == (code, resolution)


def departures(spark, dests, adjacent=None):
    rows = [(9, T0 + timedelta(hours=n), n, n, d) for n, d in dests]
    df = spark.createDataFrame(rows, "imo long, snapshot_ts timestamp, o_orderkey long, n long, dest_code string")
    return [r["dept_code"] for r in carry.departure_history(df, adjacent=adjacent).orderBy("n").collect()]


def test_departure_history(spark):
    assert departures(spark, enumerate("AABBC")) == [None, None, "A", "A", "B"]
    assert departures(spark, [(0, "A"), (1, None), (2, "A")]) == [None, "A", None]
    assert departures(spark, [(0, "A"), (2, "B")]) == [None, "A"]
    assert departures(spark, [(0, "A"), (2, "B")], "n") == [None, None]


def test_carry_departure_nulls_and_zero(spark):
    kind = "imo long, dest_code string, dept_code string, at int"
    cur = spark.createDataFrame([(1, "B", None, 0), (2, None, "own", 0), (0, "B", "own", 0), (None, "B", "own", 0), (5, "B", "own", 0)], kind)
    past = spark.createDataFrame([(1, "A", "X", 1), (1, "C", "Y", 0), (2, None, "Z", 0), (0, "A", "X", 0), (None, "A", "X", 0)], kind)
    got = {(r["imo"], r["dest_code"]): r["dept_code"] for r in carry.carry_departure(cur, past, "at").collect()}
    assert got == {(1, "B"): "A", (2, None): "Z", (0, "B"): "own", (None, "B"): "own", (5, "B"): "own"}


def test_previous_destination(spark):
    rows = [(1, 0, "A"), (1, 1, "B"), (1, 2, "B"), (2, 0, "B"), (2, 1, "B"), (3, 0, "A"), (3, 1, None)]
    history = spark.createDataFrame(rows, "imo long, snapshot_ts int, dest_code string")
    asks = spark.createDataFrame([(1, "B"), (2, "B"), (3, "A")], "imo long, asked string")
    assert {r["imo"]: r["previous_code"] for r in carry.previous_destination(history, asks).collect()} == {1: "A", 2: "B", 3: None}


def test_update_from_takes_nulls(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "imo long, v string")
    source = spark.createDataFrame([(1, "x", 0), (1, None, 1), (None, "z", 0)], "imo long, v string, at int")
    assert sorted((r["imo"] or 0, r["v"]) for r in carry.update_from(target, source, "imo", ["v"], "at").collect()) == [(0, "c"), (1, None), (2, "b")]


def test_voyage_slices(spark):
    rows = [(i, 7, T0 + timedelta(hours=i), i in (2, 5, 9), sum(c <= i for c in (2, 5, 9))) for i in range(12)]
    df = spark.createDataFrame(rows, "event_id long, mmsi long, dt_pos_utc timestamp, cut boolean, voyage_id long")
    got = sorted((r["voyage_id"], r["event_id"]) for r in voyages.voyage_slices(df).collect())
    assert got == [(1, 2), (1, 3), (1, 4), (1, 5), (2, 5), (2, 6), (2, 7), (2, 8), (2, 9)]


def test_drop_short(spark):
    df = spark.createDataFrame([(1, 19, 60.0), (2, 20, 49.9), (3, 20, 50.0)], "voyage_id long, n_points long, km double")
    assert [r["voyage_id"] for r in voyages.drop_short_voyages(df).collect()] == [3]


def test_fill_speed_and_errors(spark):
    rows = [(i, 1, T0 + timedelta(hours=i), 0.0, lon, sog, 1) for i, (lon, sog) in enumerate([(0.0, None), (0.1, 4.0), (0.2, None), (0.3, 8.0), (9.0, 5.0), (9.1, 50.0)])]
    df = spark.createDataFrame(rows, "event_id long, mmsi long, dt_pos_utc timestamp, latitude double, longitude double, sog double, voyage_id long")
    assert [r["sog"] for r in voyages.fill_speed(df).orderBy("event_id").collect()] == [4.0, 4.0, 6.0, 8.0, 5.0, 50.0]
    assert sorted(r["event_id"] for r in voyages.drop_position_errors(df).collect()) == [0, 1, 2, 3]


def test_nearest_port_at_edges(spark):
    place = [(0, 0.0, 179.9), (1, 0.0, -179.9), (2, 80.0, 10.0), (3, 0.0, 50.0), (4, 0.0, 50.0), (5, 89.9, 0.0)]
    p = spark.createDataFrame([(i, f"P{i}", "", "", "", "", la, lo) for i, la, lo in place], PORTS)
    points = [(0, 0.0, -179.95), (1, 0.0, 180.0), (2, 80.0, 12.0), (3, 0.0, 50.2), (4, 89.9, 180.0), (5, 30.0, 30.0), (6, None, 3.0)]
    df = spark.createDataFrame(points, "event_id long, latitude double, longitude double")
    got = {r["event_id"]: r["portcode"] for r in voyages.nearest_port(df, p, 50.0).collect()}
    assert got == {0: "P1", 1: "P0", 2: "P2", 3: "P3", 4: "P5"}
    exact = geo.geo_distance_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    km = spark.range(1).select(exact).first()[0]
    at_radius = spark.createDataFrame([(9, 0.0, 51.0)], "event_id long, latitude double, longitude double")
    assert voyages.nearest_port(at_radius, p, km + 1e-9).count() == 1


def test_times_and_sides(spark):
    row = spark.range(1).select(
        geo.snapshot_id(F.lit("2022-09-06 07:29:00").cast("timestamp")),
        geo.snapshot_id(F.lit("2022-09-06 07:30:00").cast("timestamp")),
        geo.months_between(F.lit("2022-11-15").cast("date"), F.lit("2023-01-02").cast("date")),
        geo.months_between(F.lit("2023-11-15").cast("date"), F.lit("2023-01-02").cast("date")),
        geo.ocean_side(F.lit(170.0), F.lit(-170.0)),
        geo.ocean_side(F.lit(10.0), F.lit(-10.0)),
        geo.ocean_side(F.lit(0.0), F.lit(180.0)),
    ).first()
    assert list(row) == ["lvi_prm_20220906071000", "lvi_prm_20220906074000", ["202211", "202212", "202301"], [], "pacific", "atlantic", "pacific"]


def test_first_rows_have_no_step(spark):
    rows = [(i, 1, T0 + timedelta(hours=i), 0.0, lon) for i, lon in enumerate([10.0, 11.0, 11.0])]
    df = spark.createDataFrame(rows, "event_id long, mmsi long, dt_pos_utc timestamp, latitude double, longitude double")
    first, *rest = voyages.with_steps(df).orderBy("event_id").collect()
    assert first["step_km"] is None and [round(r["step_km"], 2) for r in rest] == [111.2, 0.0]
    assert 111 < voyages.voyage_summary(df.withColumn("voyage_id", F.lit(1))).first()["km"] < 112
    row = spark.range(1).select(geo.geo_distance_km(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("a"), geo.geo_distance_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("b")).first()
    assert row["a"] is None and round(row["b"], 3) == 20015.114


def test_port_position_last_wins(spark):
    p = spark.createDataFrame([(0, "A", "", "", "", "", 1.0, 1.0), (1, "A", "", "", "", "", 2.0, 2.0)], PORTS)
    asked = spark.createDataFrame([("A",), ("B",), (None,)], "destination string")
    assert {r["destination"]: r["dest_latitude"] for r in tracks.port_position(asked, p).collect()} == {"A": 2.0, "B": None, None: None}


def test_sources_and_sinks(spark, tmp_path):
    source = tmp_path / "ports.csv"
    source.write_bytes("index,port_code,country_code,city_code,country_name,city_name,extra\n0,NAWVB,NA,WVB,Namibia,Walvis\xe9,x\n1,KRPUS,KR,PUS,Korea,,y\n".encode("latin-1"))
    rows = S.read_port_dictionary(spark, str(source)).orderBy("pos").collect()
    assert [(r["portcode"], r["country_code"], r["city_name"]) for r in rows] == [("NAWVB", "NA", "Walvisé"), ("KRPUS", "KR", "")]
    out = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "GRPIR", "p"), (2, "KRPUS", "q")], "mmsi long, dest_code string, geom string")
    S.append_rows(df, out)
    S.append_rows(df, out)
    S.replace_table(spark.read.parquet(out).distinct(), out)
    assert spark.read.parquet(out).count() == 2
    S.export_by_country_group(df, str(tmp_path / "g"))
    assert [r["country_group"] for r in spark.read.option("header", True).csv(str(tmp_path / "g")).collect()] == ["gr_ro_bg_cy_mt"]
    S.export_by_vessel(df, str(tmp_path / "v"))
    assert set(spark.read.option("header", True).csv(str(tmp_path / "v")).columns) == {"dest_code", "mmsi"}
    assert S.to_snapshot_schema(df).columns == schemas.names(schemas.SNAPSHOT) and len(schemas.names(schemas.SNAPSHOT)) == 39


def test_normalise_history(spark):
    raw = spark.createDataFrame([("2024-01-01T00:00:00", "123", 9, 1.0, 2.0, 3.0, 4.0, "moored", "X"), ("bad", "x", None, None, None, None, None, None, None)], schemas.HISTORY_RAW)
    rows = S.normalise_history(raw).collect()
    assert rows[0]["mmsi"] == 123 and rows[0]["imo"] == 9 and rows[1]["mmsi"] is None and rows[1]["dt_pos_utc"] is None


def test_history_is_sorted(spark):
    rows = [(i, imo, T0 + timedelta(hours=h)) for i, (imo, h) in enumerate([(2, 1), (1, 5), (None, 9), (2, 0), (1, 5), (1, 2)])]
    df = spark.createDataFrame(rows, "event_id long, imo long, dt_pos_utc timestamp").repartition(3)
    assert [r["event_id"] for r in voyages.sort_history(df).collect()] == [2, 5, 1, 4, 3, 0]


def test_ports_on_one_spot_meet_points_once(spark):
    rows = [(i, f"P{i}", "", "", "", "", float(i % 3), 0.0) for i in range(3000, 0, -1)]
    p, df = spark.createDataFrame(rows, PORTS), spark.createDataFrame([(1, 0.1, 0.1), (2, 1.9, 0.0), (3, 40.0, 0.0)], "event_id long, latitude double, longitude double")
    assert voyages.port_spots(p).count() == 3
    got = {r["event_id"]: r["portcode"] for r in voyages.nearest_port(df, p, 200.0).collect()}
    assert got == {1: "P3", 2: "P2"}
