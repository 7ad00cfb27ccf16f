"""The half-hourly cycle as structured streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wakeline.operators.carry import known_ship
from wakeline.operators.coding import Scorer, code_raw, ngram_scorer
from wakeline.sources.versions import update_table

#: What a row without a time or an order has in their place, as numbers: it comes after all others.
NO_TIME, NO_ORDER = 2**61, 2**63 - 1


def stream_snapshots(positions: DataFrame, width: str = "30 minutes", late: str = "30 minutes", columns: tuple[str, ...] = ("event_id", "imo", "sog", "destination")) -> DataFrame:
    """The newest row of each ship in each half hour. Rows later than the watermark are dropped; also works on a batch."""
    rows = positions.withColumn("dt_pos_utc", F.col("dt_pos_utc").cast("timestamp"))
    rows = rows.withWatermark("dt_pos_utc", late) if rows.isStreaming else rows
    newest = F.max_by(F.struct("dt_pos_utc", *columns), F.struct("dt_pos_utc", "event_id")).alias("row")
    done = rows.groupBy(F.window("dt_pos_utc", width).alias("w"), "mmsi").agg(newest)
    return done.select(F.col("w.start").alias("window_start"), "mmsi", "row.*")


class DepartureProcessor(StatefulProcessor):
    """Carries the departures of a bucket of ships over rows that come out of order.

    Rows wait in state until the watermark has passed their time; a timer at the
    earliest of them then puts all that are due in order, for all ships of the
    bucket at once. What stays is the last destination and departure of a ship,
    and that only until `expire_us` after its last row. A ship silent for longer
    starts anew, whether it has left the state or not. Without `expire_us` ships
    stay. Rows without a time wait as long as the stream runs.

    State is held in columns: an array a field, so a bucket costs a few calls
    between JVM and Python in a batch, however many ships and rows it has.
    """

    #: Rows in one entry of the list that waits.
    CHUNK = 10_000

    def __init__(self, key: str, kind: str, expire_us: int | None):
        self.key, self.expire_us = key, expire_us
        self.number = np.int64 if kind in ("tinyint", "smallint", "int", "bigint") else object
        self.waits = f"ship array<{kind}>, us array<long>, ord array<long>, dest array<string>"
        self.carries = f"{self.waits}, dept array<string>, wake long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.settled = handle, set()
        self.carried = handle.getValueState("carried", self.carries)
        self.waiting = handle.getListState("waiting", self.waits)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Rows wait."""
        first = []
        for new in rows:
            self.waiting.appendValue(self.lists(new[self.key].to_numpy(self.number), new["us"].to_numpy(np.int64), new["ord"].to_numpy(np.int64), texts(new["dest"])))
            first.append(int(new["us"].min()))
        self.wake(min(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Rows that are due go out in order; the first timer of a batch does all."""
        if key in self.settled:
            return
        self.settled.add(key)
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows, last, wake = self.columns(list(self.waiting.get()), self.carried.get())
        due = rows[1] <= now
        done, last = self.carry([c[due] for c in rows], last)
        rest = [c[~due] for c in rows]
        if due.any():
            self.waiting.clear()
            for at in range(0, len(rest[0]), self.CHUNK):
                self.waiting.appendValue(self.lists(*(c[at : at + self.CHUNK] for c in rest)))
        if len(rest[0]):
            self.wake(int(rest[1].min()))
        stays = np.full(len(last[1]), True) if self.expire_us is None else last[1] + self.expire_us > now
        if len(stays) and stays.any():
            last = [c[stays] for c in last]
            ends = None if self.expire_us is None else int(last[1].min()) + self.expire_us + 1000
            if ends is not None and (wake is None or wake <= now or ends < wake):
                wake = ends
                self.wake(wake)
            if due.any() or not stays.all() or wake == ends:
                self.carried.update((*self.lists(*last), wake))
        elif len(stays):
            self.carried.clear()
        if len(done[0]):
            yield self.frame(done)

    def settle(self, rows: pd.DataFrame, last: pd.DataFrame) -> pd.DataFrame:
        """The rows that wait in a bucket, as the state has them, put in order as if all were due."""
        rows, last, _ = self.columns(list(rows[["ship", "us", "ord", "dest"]].itertuples(index=False)), next(last[["ship", "us", "ord", "dest", "dept", "wake"]].itertuples(index=False), None))
        return self.frame(self.carry(rows, last)[0])

    def frame(self, done: list) -> pd.DataFrame:
        return pd.DataFrame(dict(zip((self.key, "us", "ord", "dest", "dept"), done, strict=True)))

    def wake(self, us: int) -> None:
        """A timer that is due as soon as the watermark, in whole milliseconds, has reached `us`."""
        self.handle.registerTimer(-(-us // 1000))

    def lists(self, *columns: np.ndarray) -> tuple:
        return tuple(c.tolist() for c in columns)

    def columns(self, parts: list, last: tuple | None) -> tuple[list, list, int | None]:
        """(columns of the rows that wait, columns of what is carried, its timer) of the bucket."""
        kinds = (self.number, np.int64, np.int64, object, object)
        rows = [np.concatenate([np.array([], kind), *(np.array(p[n], kind) for p in parts)]) for n, kind in enumerate(kinds[:4])]
        return rows, [np.array(last[n] if last else [], kind) for n, kind in enumerate(kinds)], last[5] if last else None

    def carry(self, rows: list, last: list) -> tuple[list, list]:
        """(rows in order with their departures, what is then carried), for all ships of the bucket.

        The departure of a row is the destination before its ship's run of equal
        ones; a new start has none. Rows not after what is carried are dropped.
        """
        old = len(last[0])
        ship, _ = pd.factorize(np.concatenate([last[0], rows[0]]))
        codes, names = pd.factorize(np.concatenate([last[3], rows[3], last[4]]))  # null: -1
        us, order = (np.concatenate([last[n], rows[n]]) for n in (1, 2))
        dest, told = codes[: len(us)], np.full(len(us), -1)
        told[:old] = codes[len(us) :]
        # what is carried comes first, and a number for each ship: its place there
        new, seen = np.arange(len(us)) >= old, ship < old
        before = np.where(seen, ship, 0)
        late = new & seen & ((us < us[before]) | ((us == us[before]) & (order <= order[before])))
        at = np.lexsort((order, us, ship))
        at = at[~late[at]]
        ship, us, order, dest, told, new = (c[at] for c in (ship, us, order, dest, told, new))
        same = np.append(False, ship[1:] == ship[:-1])[: len(at)]
        near = same if self.expire_us is None else same & ((us == NO_TIME) | (np.diff(us, prepend=us[:1]) <= self.expire_us))
        previous = np.append(-1, dest[:-1])[: len(at)]
        begins = ~near | (dest != previous)
        told = np.where(near, previous, np.where(same, -1, told))
        dept = told[np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))]
        names = np.append(np.array(names, object), None)
        every = [np.concatenate([last[0], rows[0]])[at], us, order, names[dest], names[dept]]
        ends = np.append(ship[1:] != ship[:-1], True)[: len(at)]
        return [c[new] for c in every], [c[ends] for c in every]

    def close(self) -> None:
        pass


def texts(column: pd.Series) -> np.ndarray:
    """Texts as objects, missing ones as None."""
    found = column.to_numpy(object)
    return np.where(pd.isna(found), None, found)


def stream_departures(coded: DataFrame, key: str = "imo", time: str = "snapshot_ts", order: str = "o_orderkey", code: str = "dest_code", late: str = "1 hour", expire_days: int | None = 400, buckets: int = 1024, every: bool = False) -> DataFrame:
    """Rows (key, time, order, code, dept_code) with the departure carried in state by ship.

    A row comes out once the watermark, `late` behind the newest time, has
    passed it: rows up to that late are put in their place, later ones are
    dropped. Those that still wait when the input ends are had from
    `waiting_departures`; rows without a time only there. A watermark starts in
    1970, and rows before that come out with the first batch. A ship that is
    silent for more than `expire_days` starts anew and leaves no state; with
    None ships stay. Rows without a ship number are left out, unless `every` is
    set: then they come out at once, without a departure. The state is held by
    RocksDB, by `buckets` of ships: a batch reads and writes the buckets that
    its rows fall in. Their number must stay the same over a checkpoint.
    """
    coded.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = {f.name: f.dataType.simpleString() for f in coded.schema}
    start = F.timestamp_micros(F.lit(1))
    rows = coded.filter(known_ship(key)).withColumn("__time", F.col(time).cast("timestamp"))
    rows = rows.withColumn("__at", F.when(F.col("__time") < start, start).otherwise(F.col("__time"))).withWatermark("__at", late)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("__bucket")
    us, number = F.coalesce(F.unix_micros("__time"), F.lit(NO_TIME)), F.coalesce(F.col(order).cast("long"), F.lit(NO_ORDER))
    rows = rows.select(bucket, key, "__at", us.alias("us"), number.alias("ord"), F.col(code).alias("dest"))
    done = rows.groupBy("__bucket").transformWithStateInPandas(processor(kinds[key], key, expire_days), departed(kinds[key], key), "append", "EventTime")
    done = named(done, [key, time, order, code], kinds)
    if not every:
        return done
    rest = coded.filter(~F.coalesce(known_ship(key), F.lit(False)))
    return done.unionByName(rest.select(key, time, order, code, F.lit(None).cast("string").alias("dept_code")))


def waiting_departures(stream: DataFrame, checkpoint: str, expire_days: int | None = 400) -> DataFrame:
    """Rows of `stream` (of `stream_departures`) that still wait in its state, with their departures, as a batch.

    With what has come out, they are all rows that were read and not too late.
    The state stays as it is: a stream that goes on sends them out itself when
    their time has come, with rows between them that came in meanwhile.
    """

    def state(name: str) -> DataFrame:
        return stream.sparkSession.read.format("statestore").option("stateVarName", name).load(checkpoint)

    columns, kinds = stream.columns[:4], {f.name: f.dataType.simpleString() for f in stream.schema}
    key = columns[0]
    carries = processor(kinds[key], key, expire_days)

    def due(rows: pd.DataFrame, last: pd.DataFrame) -> pd.DataFrame:
        return carries.settle(rows, last)

    rows = state("waiting").select("key.__bucket", "list_element.*").groupBy("__bucket")
    last = state("carried").select("key.__bucket", "value.*").groupBy("__bucket")
    return named(rows.cogroup(last).applyInPandas(due, departed(kinds[key], key)), columns, kinds)


def processor(kind: str, key: str, expire_days: int | None) -> DepartureProcessor:
    return DepartureProcessor(key, kind, None if expire_days is None else expire_days * 86_400_000_000)


def departed(kind: str, key: str) -> str:
    """The schema of rows as the processor gives them."""
    return f"{key} {kind}, us long, ord long, dest string, dept string"


def named(done: DataFrame, columns: list[str], kinds: dict[str, str]) -> DataFrame:
    """Rows of the processor under the names and types of its input."""
    key, time, order, code = columns
    us, number = F.when(F.col("us") != NO_TIME, F.col("us")), F.when(F.col("ord") != NO_ORDER, F.col("ord"))
    return done.select(key, F.timestamp_micros(us).cast(kinds[time]).alias(time), number.cast(kinds[order]).alias(order), F.col("dest").alias(code), F.col("dept").alias("dept_code"))


def stream_update(stream: DataFrame, apply: Callable[[DataFrame, str], None], target: str, checkpoint: str):
    """Apply a function to each micro-batch and a folder of its own under `target`.

    A batch that runs again gets the same folder; as long as `apply` writes
    nothing but that folder, and in overwrite mode, a batch counts once even
    after a crash in its midst. Returns the stream's writer, not started.
    """

    def batch(df: DataFrame, number: int) -> None:
        apply(df, f"{target.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def stream_upsert(stream: DataFrame, root: str, key: str, columns: list[str], order: str, checkpoint: str, name: str):
    """Update a versioned table by key from each micro-batch; a batch is one version, and counts once also if it runs again.

    Each batch of the stream `name` must find the table committed. Returns the
    stream's writer, not started.
    """

    def batch(df: DataFrame, number: int) -> None:
        update_table(df.sparkSession, root, df, key, columns, order, (name, number))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def stream_code(positions: DataFrame, ports: DataFrame, registered: DataFrame, target: str, checkpoint: str, scorer: Scorer = ngram_scorer):
    """Write every valid row with clean_dest, code and resolution: registered texts, then the whole ladder, as a batch has them.

    The distinct texts of each micro-batch are coded once against the static
    tables. Returns the stream's writer, not started.
    """

    def apply(df: DataFrame, folder: str) -> None:
        coded = code_raw(df, ports, registered, scorer).filter("resolution is not null")
        df.join(coded, F.col("destination") == F.col("__raw")).drop("__raw").write.mode("overwrite").parquet(folder)

    return stream_update(positions, apply, target, checkpoint)
