"""Cutting position histories into voyages and naming their ends."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wakeline.functions.geo import EARTH_KM, band_height, band_of, cell_of, cells_in, geo_distance_km
from wakeline.sources.staging import staged

ORDER = ("dt_pos_utc", "event_id")
NAUTICAL_MILE_KM = 1.852
STOPPED = ("moored", "at anchor")


def ship_window(*more: str, order: tuple[str, ...] = ORDER) -> WindowSpec:
    return Window.partitionBy("mmsi", *more).orderBy(*order)


def drop_missing_key(df: DataFrame, option: str = "imo") -> DataFrame:
    """Drop rows without a key; 0 counts as missing. `option` is a key column, or `all` for both."""
    for key in ("imo", "mmsi") if option == "all" else (option,):
        df = df.filter(F.col(key).isNotNull() & (F.col(key) != 0))
    return df


def ambiguous_ids(df: DataFrame, option: str = "mmsi") -> DataFrame:
    """Ids tied to several ids of the other kind."""
    other = {"mmsi": "imo", "imo": "mmsi"}[option]
    # the least and the greatest tell whether there are several, without a set for each id
    return df.groupBy(option).agg(F.min(other).alias("a"), F.max(other).alias("b")).filter("a <> b").select(option)


def drop_ambiguous(df: DataFrame, option: str = "mmsi") -> DataFrame:
    """Drop rows of ids tied to several partners; `all` does both kinds, judged on the input."""
    out = df
    for key in ("mmsi", "imo") if option == "all" else (option,):
        out = out.join(ambiguous_ids(df, key), key, "left_anti")
    return out


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(f"n_missing_{c}") for c in columns))


def nav_status_values(df: DataFrame) -> DataFrame:
    return df.groupBy("nav_status").agg(F.count(F.lit(1)).alias("n_rows"))


def sort_history(df: DataFrame) -> DataFrame:
    return df.orderBy("imo", *ORDER)


def fill_speed(df: DataFrame) -> DataFrame:
    """Missing `sog` becomes the mean of the ship's previous and next known values, or the one there is."""
    w = ship_window()
    before = F.last("sog", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("sog", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    filled = df.withColumn("__before", before).withColumn("__after", after)
    mean = (F.coalesce("__before", "__after") + F.coalesce("__after", "__before")) / 2
    return filled.withColumn("sog", F.coalesce("sog", mean)).drop("__before", "__after")


def with_steps(df: DataFrame, *group: str) -> DataFrame:
    """Add step_km and step_hours from the ship's previous point, within `group` if given; null at the first."""
    w = ship_window(*group)
    km = geo_distance_km(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude"))
    hours = (F.unix_micros(F.col("dt_pos_utc").cast("timestamp")) - F.unix_micros(F.lag("dt_pos_utc").over(w).cast("timestamp"))) / 3.6e9
    return df.withColumn("step_km", km).withColumn("step_hours", hours)


def port_cells(ports: DataFrame, radius_km: float) -> DataFrame:
    """Ports, once for each grid cell that a point within the radius can lie in."""
    h, reach = band_height(radius_km), radius_km / EARTH_KM
    bands = F.sequence(band_of(F.greatest(F.lit(-90.0), F.col("latitude") - h), h), band_of(F.least(F.lit(90.0), F.col("latitude") + h), h))
    rows = ports.withColumn("__band", F.explode(bands)).withColumn("__n", cells_in(F.col("__band"), h))
    polar = F.abs("latitude") + math.degrees(reach) >= 90
    span = F.when(~polar, F.degrees(F.asin(F.least(F.lit(1.0), math.sin(min(reach, math.pi / 2)) / F.cos(F.radians("latitude"))))) * 1.001)
    low = F.floor((F.col("longitude") + 180 - span) / 360 * F.col("__n")).cast("int")
    high = F.floor((F.col("longitude") + 180 + span) / 360 * F.col("__n")).cast("int")
    some = F.transform(F.sequence(low, F.least(high, low + F.col("__n") - 1)), lambda c: F.pmod(c, F.col("__n")))
    cells = F.when(polar, F.sequence(F.lit(0), F.col("__n") - 1)).otherwise(F.array_distinct(some))
    return rows.withColumn("__cell", F.explode(cells)).drop("__n")


def port_spots(ports: DataFrame) -> DataFrame:
    """Of ports on one spot, which are as far from everything, the first in the dictionary; written, so that Spark knows how few they are."""
    first = ports.groupBy("latitude", "longitude").agg(F.min(F.struct("pos", "portcode")).alias("first"))
    return staged(first.select("first.pos", "first.portcode", "latitude", "longitude"), "spots")


def nearest_port(points: DataFrame, ports: DataFrame, radius_km: float = 50.0, key: str = "event_id") -> DataFrame:
    """Rows (key, portcode, port_km) of the points with a port within the radius: the nearest, of equal ones the first in the dictionary.

    Points meet the spots of ports in cells of a grid that is as fine as the
    radius, also across the 180th meridian and at the poles, then the distance
    decides.
    """
    h = band_height(radius_km)
    cells = port_cells(port_spots(ports), radius_km).select("pos", "portcode", F.col("latitude").alias("__lat"), F.col("longitude").alias("__lon"), "__band", "__cell")
    placed = points.select(key, "latitude", "longitude").withColumn("__band", band_of(F.col("latitude"), h))
    placed = placed.withColumn("__cell", cell_of(F.col("longitude"), cells_in(F.col("__band"), h)))
    near = placed.join(cells, ["__band", "__cell"]).withColumn("port_km", geo_distance_km(F.col("latitude"), F.col("longitude"), F.col("__lat"), F.col("__lon"))).filter(F.col("port_km") <= radius_km)
    best = near.groupBy(key).agg(F.min(F.struct("port_km", "pos", "portcode")).alias("best"))
    return best.select(key, "best.portcode", "best.port_km")


def cut_voyages(df: DataFrame, ports: DataFrame, radius_km: float = 50.0, max_sog: float = 3.0, min_score: int = 2, key: str = "event_id") -> DataFrame:
    """Add `cut` and `voyage_id`, the number of cuts so far.

    A slow row is scored by what is true of it: it is slow, the destination has
    changed, a port is near, the status is stopped. A cut is a slow row with
    `min_score` or more that opens a run of such rows.
    """
    w = ship_window()
    slow = F.coalesce(F.col("sog") <= max_sog, F.lit(False))
    near = nearest_port(df.filter(slow), ports, radius_km, key).select(key, F.lit(1).alias("__near"))
    changed = (F.row_number().over(w) > 1) & ~F.col("destination").eqNullSafe(F.lag("destination").over(w))
    stopped = F.coalesce(F.col("nav_status").isin(*STOPPED), F.lit(False))
    score = slow.cast("int") + F.col("__changed").cast("int") + F.coalesce("__near", F.lit(0)) + stopped.cast("int")
    rows = df.join(near, key, "left").withColumn("__changed", changed).withColumn("__stop", slow & (score >= min_score))
    rows = rows.withColumn("cut", F.col("__stop") & ~F.coalesce(F.lag("__stop").over(w), F.lit(False)))
    number = F.sum(F.col("cut").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("voyage_id", number).drop("__near", "__changed", "__stop")


def voyage_slices(df: DataFrame) -> DataFrame:
    """Rows from one cut to the next, both included: a cut row ends one voyage and begins the next. What lies outside goes."""
    last = F.max("voyage_id").over(Window.partitionBy("mmsi"))
    both = F.when(F.col("cut"), F.array(F.col("voyage_id") - 1, F.col("voyage_id"))).otherwise(F.array("voyage_id"))
    rows = df.withColumn("__last", last).withColumn("voyage_id", F.explode(both))
    return rows.filter((F.col("voyage_id") > 0) & (F.col("voyage_id") < F.col("__last"))).drop("__last")


def drop_position_errors(df: DataFrame, max_sog: float = 40.0) -> DataFrame:
    """Drop points reached from the voyage's previous one at more than `max_sog` knots, or with a greater speed of their own."""
    rows = with_steps(df, "voyage_id")
    knots = F.col("step_km") / NAUTICAL_MILE_KM
    jump = F.coalesce(knots > max_sog * F.col("step_hours"), F.lit(False)) & (F.col("step_km") > 0)
    return rows.filter(~jump & ~F.coalesce(F.col("sog") > max_sog, F.lit(False))).drop("step_km", "step_hours")


def voyage_summary(points: DataFrame) -> DataFrame:
    """A row for each voyage: points, km, first and last time and position."""
    at, place = F.struct(*ORDER), F.struct("latitude", "longitude")
    rows = with_steps(points, "voyage_id").groupBy("mmsi", "voyage_id").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.coalesce(F.sum("step_km"), F.lit(0.0)).alias("km"),
        F.min("dt_pos_utc").alias("started"),
        F.max("dt_pos_utc").alias("ended"),
        F.min_by(place, at).alias("first"),
        F.max_by(place, at).alias("last"),
    )
    ends = [F.col(f"{end}.{c}").alias(f"{end}_{c}") for end in ("first", "last") for c in ("latitude", "longitude")]
    return rows.select("mmsi", "voyage_id", "n_points", "km", "started", "ended", *ends)


def drop_short_voyages(summary: DataFrame, min_km: float = 50.0, min_points: int = 20) -> DataFrame:
    return summary.filter((F.col("km") >= min_km) & (F.col("n_points") >= min_points))


def voyages_od(summary: DataFrame, ports: DataFrame, radius_km: float = 50.0) -> DataFrame:
    """Voyages with `origin` and `destination`, the ports nearest to their ends; those with either missing go. The voyages are written first, as both ends and the result need them."""
    rows = staged(summary, "voyages")
    place = lambda end: F.struct(F.lit(end).alias("end"), F.col(f"{end}_latitude").alias("latitude"), F.col(f"{end}_longitude").alias("longitude"))
    ends = rows.select("mmsi", "voyage_id", F.explode(F.array(place("first"), place("last"))).alias("e"))
    near = nearest_port(ends.select(F.struct("mmsi", "voyage_id", "e.end").alias("__end"), "e.latitude", "e.longitude"), ports, radius_km, "__end")
    port = lambda end: F.max(F.when(F.col("__end.end") == end, F.col("portcode")))
    named = near.groupBy("__end.mmsi", "__end.voyage_id").agg(port("first").alias("origin"), port("last").alias("destination"))
    return rows.join(named.filter("origin is not null and destination is not null"), ["mmsi", "voyage_id"])


def recent_origins(voyages: DataFrame, n: int = 5) -> DataFrame:
    """The latest `n` voyages of each ship, newest first: its rank, origin and day of the first point."""
    w = Window.partitionBy("mmsi").orderBy(F.desc("started"), F.desc("voyage_id"))
    ranked = voyages.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return ranked.select("mmsi", "rank", F.col("origin").alias("portCode"), F.date_format("started", "yyyy-MM-dd").alias("arrival_date"))


def od_pairs(voyages: DataFrame) -> DataFrame:
    """(mmsi, ordinal from 0, origin, destination) in the order of the voyages."""
    w = Window.partitionBy("mmsi").orderBy("started", "voyage_id")
    return voyages.select("mmsi", (F.row_number().over(w) - 1).alias("ordinal"), "origin", "destination")


def voyage_records(points: DataFrame, voyages: DataFrame) -> DataFrame:
    """Voyages as nested records: origin, destination and the times of all points."""
    times = points.groupBy("mmsi", "voyage_id").agg(F.array_sort(F.collect_list("dt_pos_utc")).alias("times"))  # at most a voyage's points
    port = lambda c: F.struct(F.col(c).alias("port_code")).alias(c)
    return voyages.join(times, ["mmsi", "voyage_id"]).select("mmsi", "voyage_id", port("origin"), port("destination"), F.struct(F.col("times").alias("dt_pos_utc")).alias("nav_info"))


def extract_voyages(history: DataFrame, ports: DataFrame, radius_km: float = 50.0, min_km: float = 50.0, min_points: int = 20) -> tuple[DataFrame, DataFrame]:
    """(points, named voyages): the whole extraction, errors removed after cutting and before the length test."""
    rows = fill_speed(drop_ambiguous(drop_missing_key(history, "all"), "mmsi"))
    points = staged(drop_position_errors(voyage_slices(cut_voyages(staged(rows, "filled"), ports, radius_km))), "points")
    return points, voyages_od(drop_short_voyages(voyage_summary(points), min_km, min_points), ports, radius_km)


