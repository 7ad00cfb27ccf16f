"""The voyage extraction over pieces of time, for histories of many years.

The rows of a ship are dealt to tasks by month, not by ship alone. What a month
must know of the months before and after it is small: the last row, the nearest
known speeds, whether the ship lay still, the number of cuts. It is summed up to
a row for each ship and month, carried along over these, and joined to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wakeline.functions.geo import geo_distance_km
from wakeline.operators.voyages import NAUTICAL_MILE_KM, ORDER, STOPPED, drop_ambiguous, drop_missing_key, drop_short_voyages, nearest_port, voyages_od
from wakeline.sources.staging import staged

PIECE = "__piece"
GROUP = ["mmsi", PIECE]


def within() -> WindowSpec:
    """A ship's rows in one piece, in order."""
    return Window.partitionBy(*GROUP).orderBy(*ORDER)


def over_pieces() -> WindowSpec:
    """A ship's pieces in order, a row each."""
    return Window.partitionBy("mmsi").orderBy(PIECE)


def in_pieces(df: DataFrame, unit: str = "month") -> DataFrame:
    """Add the piece that a row falls into; rows without a time, which come first, into one before all others."""
    return df.withColumn(PIECE, F.coalesce(F.date_trunc(unit, F.col("dt_pos_utc").cast("timestamp")), F.lit("0001-01-01").cast("timestamp")))


def place_and_time() -> Column:
    return F.struct("latitude", "longitude", "dt_pos_utc", "destination")


def with_neighbours(df: DataFrame) -> DataFrame:
    """Add `__prev`, the ship's previous row (place, time, destination), and the nearest known speeds `__sog_before` and `__sog_after`."""
    at, known = F.struct(*ORDER), F.col("sog").isNotNull()
    edges = df.groupBy(*GROUP).agg(F.max_by(place_and_time(), at).alias("last"), F.min_by("sog", F.when(known, at)).alias("first_sog"), F.max_by("sog", F.when(known, at)).alias("last_sog"))
    carried = edges.select(*GROUP, F.lag("last").over(over_pieces()).alias("__last"), F.last("last_sog", ignorenulls=True).over(over_pieces().rowsBetween(Window.unboundedPreceding, -1)).alias("__sog_0"), F.first("first_sog", ignorenulls=True).over(over_pieces().rowsBetween(1, Window.unboundedFollowing)).alias("__sog_1"))
    before = F.last("sog", ignorenulls=True).over(within().rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("sog", ignorenulls=True).over(within().rowsBetween(1, Window.unboundedFollowing))
    rows = df.withColumns({"__lag": F.lag(place_and_time()).over(within()), "__near_0": before, "__near_1": after}).join(carried, GROUP)
    rows = rows.withColumns({"__prev": F.coalesce("__lag", "__last"), "__sog_before": F.coalesce("__near_0", "__sog_0"), "__sog_after": F.coalesce("__near_1", "__sog_1")})
    return rows.drop("__lag", "__last", "__near_0", "__near_1", "__sog_0", "__sog_1")


def with_cuts(df: DataFrame) -> DataFrame:
    """Add `cut`, `voyage_id` and `__total`, the ship's number of cuts, to rows with `__stop`."""
    at = F.struct(*ORDER)
    rows = df.withColumn("__still", F.lag("__stop").over(within()))
    inside = F.count_if(F.col("__stop") & ~F.col("__still"))  # the first row, which has no __still, is judged by the month before
    edges = rows.groupBy(*GROUP).agg(F.min_by("__stop", at).alias("first"), F.max_by("__stop", at).alias("last"), inside.alias("inside"))
    edges = edges.withColumn("__before", F.coalesce(F.lag("last").over(over_pieces()), F.lit(False)))
    edges = edges.withColumn("cuts", F.col("inside") + (F.col("first") & ~F.col("__before")).cast("long"))
    carried = edges.select(*GROUP, "__before", F.coalesce(F.sum("cuts").over(over_pieces().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__so_far"), F.sum("cuts").over(Window.partitionBy("mmsi")).alias("__total"))
    rows = rows.join(carried, GROUP).withColumn("cut", F.col("__stop") & ~F.coalesce("__still", "__before"))
    rows = rows.withColumn("voyage_id", F.col("__so_far") + F.sum(F.col("cut").cast("long")).over(within().rowsBetween(Window.unboundedPreceding, 0)))
    return rows.drop("__still", "__before", "__so_far", "__stop")


def sailed_points(history: DataFrame, ports: DataFrame, radius_km: float = 50.0, max_sog: float = 3.0, min_score: int = 2, error_sog: float = 40.0, unit: str = "month", key: str = "event_id") -> DataFrame:
    """The points of all voyages, as the extraction by ship has them: speeds filled, voyages cut and sliced, position errors dropped."""
    rows = with_neighbours(staged(in_pieces(drop_ambiguous(drop_missing_key(history, "all")), unit), "pieces"))
    mean = (F.coalesce("__sog_before", "__sog_after") + F.coalesce("__sog_after", "__sog_before")) / 2
    rows = staged(rows.withColumn("sog", F.coalesce("sog", mean)).drop("__sog_before", "__sog_after"), "filled")
    slow = F.coalesce(F.col("sog") <= max_sog, F.lit(False))
    near = nearest_port(rows.filter(slow), ports, radius_km, key).select(key, F.lit(1).alias("__near"))
    changed = F.col("__prev").isNotNull() & ~F.col("destination").eqNullSafe(F.col("__prev.destination"))
    stopped = F.coalesce(F.col("nav_status").isin(*STOPPED), F.lit(False))
    score = slow.cast("int") + changed.cast("int") + F.coalesce("__near", F.lit(0)) + stopped.cast("int")
    marked = staged(rows.join(near, key, "left").withColumn("__stop", slow & (score >= min_score)).drop("__near"), "marked")
    # the copy of a cut row that opens a voyage has no row before it
    part = lambda number, opens: F.struct(number.alias("id"), F.lit(opens).alias("opens"))
    number = F.col("voyage_id")
    both = F.when(F.col("cut"), F.array(part(number - 1, False), part(number, True))).otherwise(F.array(part(number, False)))
    sliced = with_cuts(marked).withColumn("__slice", F.explode(both)).withColumn("voyage_id", F.col("__slice.id"))
    sliced = sliced.filter((F.col("voyage_id") > 0) & (F.col("voyage_id") < F.col("__total")))
    prev = F.when(~F.col("__slice.opens"), F.col("__prev"))
    km = geo_distance_km(prev["latitude"], prev["longitude"], F.col("latitude"), F.col("longitude"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    hours = (micros(F.col("dt_pos_utc")) - micros(prev["dt_pos_utc"])) / 3.6e9
    jump = F.coalesce(km / NAUTICAL_MILE_KM > error_sog * hours, F.lit(False)) & F.coalesce(km > 0, F.lit(False))
    good = sliced.filter(~jump & ~F.coalesce(F.col("sog") > error_sog, F.lit(False)))
    return good.drop("__slice", "__prev", "__total")


def voyage_summary(points: DataFrame) -> DataFrame:
    """A row for each voyage: points, km, first and last time and position; summed up by month, then over the months of a voyage."""
    voyage = ["mmsi", "voyage_id"]
    at, place = F.struct(*ORDER), F.struct("latitude", "longitude")
    w = Window.partitionBy(*voyage, PIECE).orderBy(*ORDER)
    step = geo_distance_km(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude"))
    months = points.withColumn("__km", step).groupBy(*voyage, PIECE).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("__km"), F.lit(0.0)).alias("km"),
        F.min("dt_pos_utc").alias("started"),
        F.max("dt_pos_utc").alias("ended"),
        F.min_by(place, at).alias("first"),
        F.max_by(place, at).alias("last"),
    )
    before = F.lag("last").over(Window.partitionBy(*voyage).orderBy(PIECE))
    months = months.withColumn("__from", before).withColumn("over", geo_distance_km(F.col("__from.latitude"), F.col("__from.longitude"), F.col("first.latitude"), F.col("first.longitude")))
    rows = months.groupBy(*voyage).agg(
        F.sum("n").alias("n_points"),
        (F.sum("km") + F.coalesce(F.sum("over"), F.lit(0.0))).alias("km"),
        F.min("started").alias("started"),
        F.max("ended").alias("ended"),
        F.min_by("first", PIECE).alias("first"),
        F.max_by("last", PIECE).alias("last"),
    )
    ends = [F.col(f"{end}.{c}").alias(f"{end}_{c}") for end in ("first", "last") for c in ("latitude", "longitude")]
    return rows.select(*voyage, "n_points", "km", "started", "ended", *ends)


def extract_voyages(history: DataFrame, ports: DataFrame, radius_km: float = 50.0, min_km: float = 50.0, min_points: int = 20, unit: str = "month") -> tuple[DataFrame, DataFrame]:
    """(points, named voyages) as `voyages.extract_voyages` gives them, with no task that holds all rows of a ship."""
    points = staged(sailed_points(history, ports, radius_km, unit=unit), "points")
    return points.drop(PIECE), voyages_od(drop_short_voyages(voyage_summary(points), min_km, min_points), ports, radius_km)
