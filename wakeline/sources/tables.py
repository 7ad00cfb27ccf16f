"""Reading dictionaries, snapshots and histories; writing results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline import schemas
from wakeline.functions.destination import country_group
from wakeline.functions.geo import wkt_point


def read_port_dictionary(spark: SparkSession, path: str, schema: str = "index int, port_code string, country_code string, city_code string, country_name string, city_name string, extra string") -> DataFrame:
    """A port dictionary from CSV (Latin-1, header): `NA` stays text, empty is '', `pos` is the file's `index`."""
    df = spark.read.schema(schema).option("header", True).option("encoding", "ISO-8859-1").option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    df = df.withColumnsRenamed({"port_code": "portcode"}).drop("extra")
    strings = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    return df.na.fill("", strings).withColumn("pos", F.col("index").cast("long"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_watch_list(spark: SparkSession, path: str, column: str, name: str = "imo") -> DataFrame:
    """Distinct ship numbers from one column of a CSV file with a header."""
    df = spark.read.option("header", True).csv(path)
    return df.select(F.expr(f"try_cast(trim(`{column}`) as bigint)").alias(name)).filter(F.col(name).isNotNull()).distinct()


def latest_snapshot(df: DataFrame, prefix: str, column: str = "snapshot_id") -> DataFrame:
    """All rows of the greatest snapshot id that begins with `prefix`; the greatest id is found on that column alone."""
    latest = df.filter(F.col(column).startswith(prefix)).agg(F.max(column).alias("__latest"))
    return df.join(latest, F.col(column) == F.col("__latest"), "left_semi")


def snapshots_by_prefix(df: DataFrame, prefix: str, column: str = "snapshot_id") -> DataFrame:
    return df.filter(F.col(column).startswith(prefix))


def read_history(df: DataFrame, date_from, date_to, mmsi: int | None = None, time: str = "dt_pos_utc") -> DataFrame:
    """Rows of a time range, both ends included, of one ship or of all.

    A column `yyyymm`, if there is one, is filtered too, so that only the months
    in the range are read; months without data simply have no partition.
    """
    out = time_and_ship_filter(df, date_from, date_to, mmsi, time)
    if "yyyymm" in df.columns:
        out = out.filter(F.col("yyyymm").between(F.date_format(F.lit(date_from).cast("timestamp"), "yyyyMM"), F.date_format(F.lit(date_to).cast("timestamp"), "yyyyMM")))
    return out


def time_and_ship_filter(df: DataFrame, date_from, date_to, mmsi: int | None = None, time: str = "dt_pos_utc") -> DataFrame:
    out = df.filter((F.col(time) >= F.lit(date_from)) & (F.col(time) <= F.lit(date_to)))
    return out.filter(F.col("mmsi") == mmsi) if mmsi else out


def normalise_history(df: DataFrame) -> DataFrame:
    """Raw history rows with the library's names and types; what cannot be cast is null."""
    source = {"dt_pos_utc": "positionUpdated", "imo": "imoNumber", "nav_status": "navStatus"}
    return df.select(*(F.expr(f"try_cast(`{source.get(n, n)}` as {k})").alias(n) for n, k in (f.split(" ", 1) for f in schemas.HISTORY.split(", "))))


def to_snapshot_schema(df: DataFrame) -> DataFrame:
    """Exactly the snapshot's columns, in order; those that are missing are null."""
    return df.select(*((F.expr(f"try_cast(`{n}` as {k})") if n in df.columns else F.lit(None).cast(k)).alias(n) for n, k in (f.split(" ", 1) for f in schemas.SNAPSHOT.split(", "))))


def with_wkt_point(df: DataFrame) -> DataFrame:
    return df.withColumn("geom", wkt_point(F.col("longitude"), F.col("latitude")))


def union_snapshots(frames: list[DataFrame]) -> DataFrame:
    """All rows; columns that a frame lacks are null there."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Write over `path`, even if `df` reads it: the rows are staged beside it first."""
    spark, staged = df.sparkSession, f"{path.rstrip('/')}__staged_{uuid.uuid4().hex}"
    df.write.parquet(staged)
    spark.read.schema(df.schema).parquet(staged).write.mode("overwrite").parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(staged)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def dealt_by_size(df: DataFrame, key: str, rows_a_file: int) -> DataFrame:
    """`df` dealt to tasks so that each value of `key` is written by as many as its rows need, small ones by one each."""
    sizes = df.groupBy(F.col(key).alias("__key")).agg(F.ceil(F.count(F.lit(1)) / rows_a_file).cast("int").alias("__writers"))
    rows = df.join(sizes, F.col(key).eqNullSafe(F.col("__key")))
    return rows.withColumn("__writer", F.pmod(F.xxhash64(*df.columns), F.col("__writers"))).repartition(key, "__writer").drop("__key", "__writers", "__writer")


def export_by_country_group(df: DataFrame, path: str, code: str = "dest_code", max_rows_a_file: int = 1_000_000) -> None:
    """One folder of CSV files for each country group, of about `max_rows_a_file` rows each; rows of no group are left out."""
    grouped = df.withColumn("country_group", country_group(F.col(code))).filter(F.col("country_group").isNotNull())
    dealt = dealt_by_size(grouped, "country_group", max_rows_a_file)
    dealt.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", max_rows_a_file).partitionBy("country_group").csv(path)


def export_by_vessel(df: DataFrame, path: str, max_rows_a_file: int = 1_000_000) -> None:
    """One folder of CSV files for each ship, of about `max_rows_a_file` rows each, without `geom`."""
    dealt = dealt_by_size(df.drop("geom"), "mmsi", max_rows_a_file)
    dealt.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", max_rows_a_file).partitionBy("mmsi").csv(path)


def register_snapshots(df: DataFrame, time: str = "dt_pos_utc", column: str = "snapshot_id") -> DataFrame:
    """A catalogue row for each snapshot: name, usage '1', first and last time in its data."""
    return df.groupBy(F.col(column).alias("tb_name")).agg(F.lit("1").alias("tb_usage"), F.min(time).alias("tb_time"), F.max(time).alias("tb_endtime"))
