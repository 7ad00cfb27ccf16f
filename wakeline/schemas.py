"""Declared schemas of positions, history and dictionaries."""

from __future__ import annotations

from pyspark.sql import types as T


def struct(spec: str) -> T.StructType:
    return T.StructType([T.StructField(name, T._parse_datatype_string(kind)) for name, kind in (f.split(" ", 1) for f in spec.split(", "))])


#: The fixed columns of a position snapshot, in order.
SNAPSHOT = (
    "gid bigint, mmsi bigint, imo int, vessel_name string, callsign string, vessel_type string, vessel_type_code int, "
    "vessel_type_cargo string, vessel_class string, length int, width int, flag_country string, flag_code int, "
    "destination string, eta string, draught double, longitude double, latitude double, sog double, cog double, rot double, "
    "heading double, nav_status string, nav_status_code int, source string, ts_pos_utc string, ts_static_utc string, "
    "ts_insert_utc string, dt_pos_utc string, dt_static_utc string, dt_insert_utc string, vessel_type_main string, "
    "vessel_type_sub string, message_type int, eeid bigint, geom string, dest_code string, dept_code string, etd string"
)
#: Position history as it arrives, and after `normalise_history`.
HISTORY_RAW = "positionUpdated string, mmsi string, imoNumber int, longitude double, latitude double, sog double, cog double, navStatus string, destination string"
HISTORY = "dt_pos_utc timestamp, mmsi bigint, imo bigint, longitude double, latitude double, sog double, cog double, nav_status string, destination string"
#: Port dictionary; `pos` is the order of its rows, which has a meaning.
PORTS = "index int, portcode string, country_code string, city_code string, country_name string, city_name string, latitude double, longitude double"


def names(spec: str) -> list[str]:
    return [f.split(" ", 1)[0] for f in spec.split(", ")]
