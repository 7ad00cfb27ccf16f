"""The half-hourly coding cycle and the fleet extract as whole jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.operators import carry, coding
from wakeline.sources import tables, versions


def coding_cycle(positions: DataFrame, prefix: str, watch_list: DataFrame, ports: DataFrame, registered: DataFrame, past: DataFrame, out: str, past_order: str = "snapshot_ts", order: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """(result, updated snapshot) of one cycle: tables `result` and `snapshot` of one new version of `out`, read back.

    The newest snapshot with `prefix` is taken, cut down to the watch list, its
    destinations are coded and the departures of `past` carried on; then the
    whole snapshot takes over the codes of its ships. Both tables are committed
    at once, so readers never meet those of different cycles. The result is also
    exported as CSV under `csv`, after the commit: a crash before that leaves
    the older file, and the next cycle writes it.
    """
    spark = positions.sparkSession
    snapshot = tables.latest_snapshot(positions, prefix)
    listed = carry.watch_list_filter(snapshot, watch_list)
    coded = tables.with_wkt_point(coding.code_destinations(listed, ports, registered, order=order))
    done = carry.carry_departure(coded.withColumn("dept_code", F.lit(None).cast("string")), past, past_order)
    draft = versions.Draft(spark, out)
    result = draft.replace(done, "result")
    blank = snapshot.withColumns({c: F.lit(None).cast("string") for c in ("dest_code", "dept_code")})
    draft.replace(carry.update_from(blank, result, "imo", ["dest_code", "dept_code"], order), "snapshot")
    draft.commit()
    result = versions.read(spark, out, "result")
    tables.export_csv(result, f"{out}/csv")
    return result, versions.read(spark, out, "snapshot")


def fleet_extract(spark: SparkSession, snapshots: DataFrame, prefix: str, fleet: DataFrame, out: str, schema: str) -> DataFrame:
    """All rows of the fleet's ships in the snapshots with `prefix`, a folder of CSV files for each ship; read back by `schema`.

    The snapshots are read once for the whole fleet.
    """
    tables.export_by_vessel(carry.watch_list_filter(tables.snapshots_by_prefix(snapshots, prefix), fleet, "mmsi"), out)
    return spark.read.schema(schema).option("header", True).csv(out)
