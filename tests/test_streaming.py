import os
import random
from datetime import datetime, timedelta
from unittest import mock

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from wakeline.jobs.queries import QUERIES, SQL
from wakeline.streaming import snapshots as R

KIND = "imo long, snapshot_ts timestamp, o_orderkey long, dest_code string"
T0 = datetime(2024, 1, 1)


def streamed(spark, tmp_path, batches, **more):
    """Rows (imo, hours, order, destination), a file a batch; what came out and the state's rows at the end."""
    source = tmp_path / "in"
    for n, rows in enumerate(batches):
        part = tmp_path / f"part{n}"
        spark.createDataFrame([(i, T0 + timedelta(hours=h), o, d) for i, h, o, d in rows], KIND).coalesce(1).write.parquet(str(part))
        source.mkdir(exist_ok=True)
        (file,) = part.glob("*.parquet")
        file.rename(source / f"{n}.parquet")
        os.utime(source / f"{n}.parquet", (1_000_000 + n * 10, 1_000_000 + n * 10))
    stream = R.stream_departures(spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(source)), **more)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()
    left = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return {(r["imo"], r["o_orderkey"]): r["dept_code"] for r in rows}, left[-1]


def test_late_rows_are_put_in_their_place(spark, tmp_path):
    batches = [
        [(1, 0, 1, "A"), (1, 3, 3, "C"), (2, 0, 10, "X"), (None, 0, 90, "A"), (0, 0, 91, "A")],
        # within two hours of the newest row: before C
        [(1, 2, 2, "B"), (1, 3, 4, "C"), (2, 3, 11, None)],
        [(1, 30, 5, "D"), (2, 30, 12, None)],
        # too late for everything that has come out
        [(1, 1, 6, "E"), (2, 31, 13, "X"), (1, 40, 7, "D")],
        [(3, 100, 99, "Z")],
    ]
    got, _ = streamed(spark, tmp_path, batches, late="2 hours")
    assert got == {(1, 1): None, (1, 2): "A", (1, 3): "B", (1, 4): "B", (1, 5): "C", (1, 7): "C", (2, 10): None, (2, 11): "X", (2, 12): "X", (2, 13): None}


def test_silent_ships_leave_no_state(spark, tmp_path):
    day = 24
    batches = [[(i, 0, i, "A") for i in range(1, 40)], [(1, day, 101, "B"), (2, 20 * day, 102, "B")], [(50, 40 * day, 150, "A")], [(50, 41 * day, 151, "A")]]
    got, left = streamed(spark, tmp_path, batches, late="1 hour", expire_days=10)
    # ship 1 came back in time, ship 2 too late
    assert got[1, 101] == "A" and got[2, 102] is None and len(got) == 42
    assert left <= 6


def test_state_is_held_for_buckets_not_for_ships(spark, tmp_path):
    """A ship with an entry of its own costs calls between JVM and Python in every batch."""
    ships = range(1, 5001)
    batches = [[(i, h, 10 * i + h, "AB"[h % 2]) for i in ships] for h in (0, 1)] + [[(1, 9, 9, "A")], [(1, 10, 8, "A")]]
    got, left = streamed(spark, tmp_path, batches)
    assert len(got) == 10_001 and all(got[i, 10 * i + 1] == "A" and got[i, 10 * i] is None for i in ships)
    assert left < 5000


def walked(rows, expire):
    """Plain walk over rows (imo, hours, order, destination): departure by (imo, order)."""
    out, last = {}, {}
    for imo, hour, order, dest in sorted(rows, key=lambda r: r[:3]):
        if imo in last and hour - last[imo][0] <= expire:
            dept = last[imo][2] if dest == last[imo][1] else last[imo][1]
        else:
            dept = None
        out[imo, order] = dept
        last[imo] = (hour, dest, dept)
    return out


def test_ships_of_a_bucket_do_not_mix(spark, tmp_path):
    """Rows out of order, nulls and long silences of many ships in three buckets, small chunks of state, against a plain walk."""
    draw = random.Random(7)
    batches, order = [], 0
    for n in range(5):
        batch = []
        for _ in range(300):
            order += 1
            # within the 40 hours of a batch and the ten before: never later than the watermark
            batch.append((draw.randint(-2, 60) or None, 40 * n + draw.randint(-10 if n else 0, 39), order, draw.choice(["A", "B", "C", "", None])))
        batches.append(batch + [(99, 40 * n + 39, order + 10_000, "Z")])
    ends = [[(99, 400, 90_000, "Z")], [(99, 401, 90_001, "Z")]]
    with mock.patch.object(R.DepartureProcessor, "CHUNK", 7):
        got, _ = streamed(spark, tmp_path, batches + ends, late="50 hours", expire_days=2, buckets=3)
    want = walked([r for b in batches for r in b if r[0]], 48)
    assert got == want and len({i for i, _ in want}) > 55


def test_ships_with_text_keys_and_a_row_between_milliseconds(spark, tmp_path):
    """The watermark has whole milliseconds: a row just behind it waits for the next, and comes out though its ship sends no more."""
    kind = KIND.replace("imo long", "imo string")
    batches = [[("7", timedelta(hours=1), 1, "A"), ("8", timedelta(hours=1, microseconds=500), 2, "B")], [("9", timedelta(hours=2), 3, "C")], [("9", timedelta(hours=9), 4, "D")], [("9", timedelta(hours=10), 5, "D")]]
    for n, rows in enumerate(batches):
        part = tmp_path / f"part{n}"
        spark.createDataFrame([(i, T0 + at, o, d) for i, at, o, d in rows], kind).coalesce(1).write.parquet(str(part))
        (tmp_path / "in").mkdir(exist_ok=True)
        (file,) = part.glob("*.parquet")
        file.rename(tmp_path / "in" / f"{n}.parquet")
        os.utime(tmp_path / "in" / f"{n}.parquet", (1_000_000 + n * 10, 1_000_000 + n * 10))
    stream = R.stream_departures(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()
    assert {(r["imo"], r["o_orderkey"], r["dept_code"]) for r in rows} == {("7", 1, None), ("8", 2, None), ("9", 3, None), ("9", 4, "C")}


def run_to_end(spark, tmp_path, batches, **more):
    """Batches of rows (imo, hours or None, order, destination), read one after the other: (what came out, what waits) as rows (imo, order, time, departure)."""
    for n, rows in enumerate(batches):
        file = tmp_path / "in" / f"{n}.parquet"
        file.parent.mkdir(exist_ok=True)
        at = [None if h is None else T0 + timedelta(hours=h) for _, h, _, _ in rows]
        table = {"imo": pa.array([r[0] for r in rows], pa.int64()), "snapshot_ts": pa.array(at, pa.timestamp("us", "UTC")), "o_orderkey": pa.array([r[2] for r in rows], pa.int64()), "dest_code": pa.array([r[3] for r in rows], pa.string())}
        pq.write_table(pa.table(table), file)
        os.utime(file, (1_000_000 + n * 10, 1_000_000 + n * 10))
    stream = R.stream_departures(spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), **more)
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    parts = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")), R.waiting_departures(stream, str(tmp_path / "state"), more.get("expire_days", 400))
    assert parts[0].schema == parts[1].schema
    return tuple(sorted(((r["imo"], r["o_orderkey"], r["snapshot_ts"], r["dept_code"]) for r in part.collect()), key=repr) for part in parts)


def row(imo, order, hours, dept):
    return imo, order, None if hours is None else T0 + timedelta(hours=hours), dept


def test_rows_that_wait_when_the_input_ends_are_had_from_the_state(spark, tmp_path):
    """They carry on from what has come out, the stream's state stays, and a stream that goes on sends them out itself."""
    batches = [[(1, 0, 1, "A"), (1, 5, 2, "B"), (2, 5, 3, "X")], [(1, 4.5, 4, "C"), (2, 5.5, 5, None)]]
    out, waits = run_to_end(spark, tmp_path, batches)
    assert out == [row(1, 1, 0, None), row(1, 4, 4.5, "A")]
    assert waits == [row(1, 2, 5, "C"), row(2, 3, 5, None), row(2, 5, 5.5, "X")]
    out, waits = run_to_end(spark, tmp_path, [*batches, [(1, 4.75, 6, "D"), (3, 9, 7, "Z")]])
    assert out == [row(1, 1, 0, None), row(1, 2, 5, "D"), row(1, 4, 4.5, "A"), row(1, 6, 4.75, "C"), row(2, 3, 5, None), row(2, 5, 5.5, "X")]
    assert waits == [row(3, 7, 9, None)]


def test_no_row_is_left_out(spark, tmp_path):
    """Rows without a ship, time or order, before 1970, and ships silent for years."""
    year = 24 * 365
    batches = [[(1, -60 * year, 1, "A"), (1, -54 * year, 2, "B"), (1, 0, 3, "C"), (None, 0, 4, "A"), (0, 1, 5, "B"), (1, None, 6, "D"), (2, None, 7, "E")], [(1, 0, None, "D"), (1, 3 * year, 8, "E"), (None, None, 9, "F")]]
    out, waits = run_to_end(spark, tmp_path, batches, every=True, expire_days=None)
    assert out == sorted([row(1, 1, -60 * year, None), row(1, 2, -54 * year, "A"), row(1, 3, 0, "B"), row(1, None, 0, "C"), row(None, 4, 0, None), row(0, 5, 1, None), row(None, 9, None, None)], key=repr)
    assert waits == [row(1, 6, None, "E"), row(1, 8, 3 * year, "D"), row(2, 7, None, None)]


def test_nothing_waits_in_a_stream_without_rows(spark, tmp_path):
    assert run_to_end(spark, tmp_path, [[]], every=True) == ([], [])


def test_stream_departures_has_all_orders(spark, sf_dir, tmp_path):
    """Every order once, in two files: the newest, those of no ship, without a date, before 1970, and ships silent for years; as the SQL has them."""
    (tmp_path / "orders.parquet").mkdir()
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    odd = "case when o_orderkey%97=0 then null when o_orderkey%89=0 then o_orderdate-interval 40 year else o_orderdate end as o_orderdate, case when o_orderkey%83=0 then null else o_custkey end as o_custkey"
    for n in range(2):
        con.execute(f"copy (select * replace ({odd}) from '{sf_dir}/orders.parquet' where o_orderkey%2={n}) to '{tmp_path}/orders.parquet/{n}.parquet' (format parquet)")
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    got = QUERIES["stream_departures"](spark, str(tmp_path)).select("o_orderkey", "imo", "dest_code", "dept_code").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(SQL["stream_departures"]).fetchall()))
    assert sorted((r["o_orderkey"],) for r in got) == con.execute("select o_orderkey from orders order by all").fetchall()
