"""Vessel tables derived from the driver's tables; the SQL of the same views is in `wakeline.jobs.oracle`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from wakeline.functions.destination import clean_destination

#: Two letters for each nation key.
NATION_LETTERS = "GRROAUNZNLBEDKNODEPLESPTINITHRGBIECAUSFRKRJPCNSGNA"
#: The ports that a remainder of 10 can name.
REMAINDERS = "pos > -10 and pos < 10"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    rows = s.join(n, s["s_nationkey"] == n["n_nationkey"]).selectExpr(
        "s_suppkey as pos",
        f"substr('{NATION_LETTERS}', cast(2*s_nationkey+1 as int), 2) as country_code",
        "char(65+cast(floor(s_suppkey/676) as int)%26)||char(65+cast(floor(s_suppkey/26) as int)%26)||char(65+cast(s_suppkey as int)%26) as city_code",
        "n_name as country_name",
        "s_name as city_name",
    )
    return rows.selectExpr("pos", "country_code||city_code as portcode", "country_code", "city_code", "country_name", "city_name", "cast(-60+(pos*37)%120 as double) as latitude", "cast(-180+(pos*73)%360 as double) as longitude")


def positions_from(events: DataFrame, port_rows: DataFrame) -> DataFrame:
    e = events.withColumn("h", F.expr("cast(floor(unix_timestamp(ts)/3600) as bigint)")).withColumn("at", F.expr("(user_id+cast(floor(h/72) as bigint))%10"))
    # remainders of 10: few ports whatever their number, which Spark cannot tell; the rows need not be dealt by ten keys for them
    p = port_rows.filter(REMAINDERS).select(F.col("pos").alias("at"), "portcode", "country_code", "city_code", "city_name")
    return e.join(F.broadcast(p), "at").selectExpr(
        "event_id",
        "ts as dt_pos_utc",
        "200000000+user_id as mmsi",
        "case when user_id%29=0 then null when user_id%31=0 then 0 when user_id%37=0 and event_id%2=0 then 9500000+user_id else 9000000+user_id end as imo",
        "case when event_id%17=0 then null else value/10 end as sog",
        "case event_type when 'error' then 'moored' when 'signup' then 'at anchor' else 'under way' end as nav_status",
        "-60+((user_id*13+h)%1200)/10.0D as latitude",
        "-180+((user_id*29+2*h)%3600)/10.0D as longitude",
        """case event_id%12 when 0 then country_code||' '||city_code when 1 then portcode when 2 then city_code||country_code
           when 3 then country_code||'>'||city_code when 4 then 'XXX>'||portcode when 5 then 'FOR ORDERS' when 6 then 'OPEN SEA, WAITING'
           when 7 then city_name when 8 then '' when 9 then null when 10 then '0902' else 'FR MRS > '||country_code||' '||city_code||'/' end as destination""",
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions_from(table(spark, sf_dir, "events"), ports(spark, sf_dir))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots_from(table(spark, sf_dir, "orders"))


def snapshots_from(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "o_orderkey",
        "case when o_custkey%50=0 then null else 9000000+o_custkey end as imo",
        "o_orderdate as snapshot_ts",
        "case when o_orderkey%13=0 then null else 'KR'||upper(substr(o_orderpriority,3,3)) end as dest_code",
    )


def ranked_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(newest, second newest) snapshot row of each ship."""
    w = Window.partitionBy("imo").orderBy(F.desc("snapshot_ts"), F.desc("o_orderkey"))
    ranked = snapshots(spark, sf_dir).filter("imo is not null").withColumn("r", F.row_number().over(w)).filter("r <= 2")
    with_dept = ranked.withColumn("dept_code", F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("JP"), (F.col("o_orderkey") % 7).cast("string"))))
    return with_dept.filter("r = 1").drop("r"), with_dept.filter("r = 2").drop("r")


def watch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").selectExpr("9000000+c_custkey as imo")


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ports(spark, sf_dir).filter("pos % 5 = 0").select(clean_destination(F.col("city_name")).alias("clean_dest"), "portcode")


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ports(spark, sf_dir).groupBy("country_code").agg(F.min("country_name").alias("country"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.broadcast(ports(spark, sf_dir).filter(REMAINDERS).select("pos", "portcode"))
    w = Window.partitionBy("mmsi").orderBy("dt_pos_utc", "event_id")
    nodes = positions(spark, sf_dir).select(F.col("mmsi").alias("track_id"), F.row_number().over(w).alias("seq"), "latitude", "longitude")
    start = p.select(F.col("pos").alias("a"), F.col("portcode").alias("origin"))
    end = p.select(F.col("pos").alias("b"), F.col("portcode").alias("destination"))
    return nodes.join(start, F.col("track_id") % 10 == F.col("a")).join(end, (F.col("track_id") + 3) % 10 == F.col("b")).drop("a", "b")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request from the newest position of every ship, for the voyage of its track; some without origin."""
    p = F.broadcast(ports(spark, sf_dir).filter(REMAINDERS).select("pos", "portcode"))
    newest = positions(spark, sf_dir).groupBy("mmsi").agg(F.max_by(F.struct("latitude", "longitude"), F.struct("dt_pos_utc", "event_id")).alias("at"))
    start = p.select(F.col("pos").alias("a"), F.col("portcode").alias("origin"))
    end = p.select(F.col("pos").alias("b"), F.col("portcode").alias("destination"))
    rows = newest.join(start, F.col("mmsi") % 10 == F.col("a")).join(end, (F.col("mmsi") + 3) % 10 == F.col("b"))
    origin = F.when(F.col("mmsi") % 11 == 0, F.lit(None)).when(F.col("mmsi") % 7 == 0, "").otherwise(F.col("origin"))
    return rows.select(F.col("mmsi").alias("request_id"), origin.alias("origin"), "destination", "at.latitude", "at.longitude")
