"""Carrying each ship's departure port from snapshot to snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.sources.staging import staged


def known_ship(column: str):
    """A ship number that tells ships apart: neither null nor 0."""
    return F.col(column).isNotNull() & (F.col(column) != 0)


def watch_list_filter(df: DataFrame, ids: DataFrame, key: str = "imo") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def latest_per_vessel(df: DataFrame, key: str = "mmsi", order: tuple[str, ...] = ("dt_pos_utc", "event_id")) -> DataFrame:
    """The newest row of each ship; one aggregation with partial sums, no sort of a ship's rows."""
    rows = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("row"))
    return rows.select("row.*")


def carry_departure(cur: DataFrame, past: DataFrame, order: str, with_etd: bool = False) -> DataFrame:
    """`cur` with dept_code carried on, and `changed`.

    A ship whose destination is the one it had keeps its departure; one with a
    new destination departs from the old one; one not seen before keeps its own.
    Of several past rows of a ship the last by `order` counts. Null codes are
    equal to each other; ships without a number match nothing. With `with_etd`
    the past row's eta becomes the etd of ships that changed.
    """
    columns = ["dest_code", "dept_code"] + ["eta"] * with_etd
    last = past.filter(known_ship("imo")).groupBy("imo").agg(F.max_by(F.struct(*columns), order).alias("__past")).withColumnRenamed("imo", "__imo")
    joined = cur.join(last, known_ship("imo") & (cur["imo"] == last["__imo"]), "left")
    matched, same = F.col("__past").isNotNull(), F.col("dest_code").eqNullSafe(F.col("__past.dest_code"))
    out = joined.withColumn("dept_code", F.when(matched & same, F.col("__past.dept_code")).when(matched, F.col("__past.dest_code")).otherwise(F.col("dept_code")))
    if with_etd:
        out = out.withColumn("etd", F.when(matched & ~same, F.col("__past.eta")).otherwise(F.col("etd")))
    return out.withColumn("changed", matched & ~same).drop("__imo", "__past")


def changed_departures(carried: DataFrame) -> DataFrame:
    return carried.agg(F.count_if("changed").alias("n_changed"), F.count(F.lit(1)).alias("n_ships"))


def departure_strict(cur: DataFrame, last: DataFrame, key: str = "mmsi") -> DataFrame:
    """Ships with a number on both sides: the last destination as departure where it changed, '' where not; rows with any null are dropped."""
    old = last.filter(known_ship(key)).select(F.col(key), F.col("dest_code").alias("__last"))
    joined = cur.drop("dept_code").join(old, key)
    out = joined.withColumn("dept_code", F.when(F.col("dest_code") != F.col("__last"), F.col("__last")).when(F.col("dest_code") == F.col("__last"), ""))
    return drop_incomplete(out.drop("__last"))


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def code_delta(updates: DataFrame, rows: DataFrame) -> DataFrame:
    """(imo, dest_code, dept_code) of the updates whose ship is among `rows`; null codes as ''."""
    ships = rows.select(F.col("imo").cast("long").alias("imo")).filter(F.col("imo").isNotNull()).distinct()
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("dest_code", "dept_code")]
    return updates.select(F.col("imo").cast("long").alias("imo"), *blank).join(ships, "imo")


def previous_destination(history: DataFrame, asks: DataFrame, key: str = "imo", code: str = "dest_code", order: tuple[str, ...] = ("snapshot_ts",)) -> DataFrame:
    """For rows (key, asked): the newest code that differs from the one asked about, or the oldest of all if none does.

    A null code differs from every other one. `asks` holds a row for each key;
    ships without a number (null, 0) get no answer.
    """
    joined = history.filter(known_ship(key)).select(key, F.struct(F.col(code).alias("c")).alias("__code"), F.struct(*order).alias("__at")).join(asks, key)
    differs = ~F.col("__code.c").eqNullSafe(F.col("asked"))
    newest = F.max_by("__code", F.when(differs, F.col("__at")))
    return joined.groupBy(key, "asked").agg(F.coalesce(newest, F.min_by("__code", "__at"))["c"].alias("previous_code"))


def previous_destination_back(history: DataFrame, asks: DataFrame, partition: str, key: str = "imo", code: str = "dest_code", order: tuple[str, ...] = ("snapshot_ts",)) -> tuple[DataFrame, list]:
    """(`previous_destination`, the partitions read): the history is read backwards, as far as there are questions open.

    `partition` is a column that grows with `order` and by which the history is
    stored, such as the day. Each round reads twice as many partitions as the
    one before. A ship whose newest other code is found is done; only if there is
    none, which takes all of the history, its oldest code counts.
    """
    values = sorted((r[0] for r in history.select(partition).distinct().collect()), reverse=True)  # as many as folders
    at, own = F.struct(*order), F.struct(F.col(code).alias("c"))
    open_ = asks.filter(known_ship(key)).select(key, "asked", F.lit(None).cast(f"struct<c:{history.schema[code].dataType.simpleString()}>").alias("oldest"))
    done, read, width = None, [], 1
    while len(read) < len(values):
        part = values[len(read) : len(read) + width]
        read, width = read + part, width * 2
        rows = history.filter(F.col(partition).isin(part)).select(key, own.alias("__own"), at.alias("__at")).join(open_.select(key, "asked"), key)
        differs = ~F.col("__own.c").eqNullSafe(F.col("asked"))
        met = rows.groupBy(key).agg(F.max_by("__own", F.when(differs, F.col("__at"))).alias("newest"), F.min_by("__own", "__at").alias("first"))
        state = staged(open_.join(met, key, "left").select(key, "asked", "newest", F.coalesce("first", "oldest").alias("oldest")), "asks")
        found = state.filter("newest is not null").select(key, "asked", F.col("newest.c").alias("previous_code"))
        done = found if done is None else done.unionByName(found)
        open_ = state.filter("newest is null").select(key, "asked", "oldest")
        if open_.isEmpty():
            break
    rest = open_.filter("oldest is not null").select(key, "asked", F.col("oldest.c").alias("previous_code"))
    return (rest if done is None else done.unionByName(rest)), read


def departure_history(df: DataFrame, key: str = "imo", order: tuple[str, ...] = ("snapshot_ts", "o_orderkey"), code: str = "dest_code", adjacent: str | None = None) -> DataFrame:
    """Add dept_code for all snapshots at once: the destination before the present run of equal ones.

    The first run has none. A ship keeps its departure over snapshots that lack
    it, unless `adjacent` names a column that numbers the snapshots: then a gap
    in it starts anew. Rows without a ship number have a null departure.
    """
    w = Window.partitionBy(key).orderBy(*order)
    first = F.row_number().over(w) == 1
    gap = (F.col(adjacent) - F.lag(adjacent).over(w) > 1) if adjacent else F.lit(False)
    before = F.struct(F.when(~gap, F.lag(code).over(w)).alias("code"))
    changed = (~F.col(code).eqNullSafe(F.lag(code).over(w)) | gap) & ~first
    marked = df.filter(known_ship(key)).withColumn("__change", F.when(changed, before))
    carried = marked.withColumn("dept_code", F.last("__change", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))["code"]).drop("__change")
    return carried.unionByName(df.filter(~F.coalesce(known_ship(key), F.lit(False))).withColumn("dept_code", F.lit(None).cast("string")))


def update_from(target: DataFrame, source: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """`target` with `columns` taken from the matching source row, nulls included; the last source row by `order` counts, and rows without a key (null, 0) match nothing."""
    new = source.filter(known_ship(key)).groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("__new"))
    out = target.join(new, key, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)))
    return out.drop("__new")
