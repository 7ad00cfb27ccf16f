"""The shared folder of the cluster, and tables written to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Paths given out in this session, for `clean_up`.
WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    It is what `spark.checkpoint.dir` names. Only where that is unset and Spark
    runs on one machine a temporary folder takes its place; on a cluster each
    executor would write to a disk of its own, so that is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given is None:
        given = spark.sparkContext.getCheckpointDir()
        if given is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        given = given or "file://" + tempfile.mkdtemp(prefix="wakeline-")
        spark.conf.set("spark.checkpoint.dir", given)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    WRITTEN.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return WRITTEN[-1]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it again.

    Later steps then neither repeat the work nor depend on shuffle files of
    executors that may be lost, and Spark knows the real size of the table.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clean_up(spark: SparkSession) -> None:
    """Delete all tables that this library wrote in the shared folder in this session; results not yet computed may need them."""
    for path in WRITTEN:
        delete(spark, path)
    WRITTEN.clear()


def conclude(df: DataFrame, name: str, before: int) -> DataFrame:
    """`df` written, once all is computed; tables written since `WRITTEN` had `before` entries are deleted then, as nothing reads them any more."""
    done = materialise(df, name)
    for path in WRITTEN[before:-1]:
        delete(df.sparkSession, path)
    del WRITTEN[before:-1]
    return done


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Let Spark drop the shuffle files of finished steps now, rather than when the driver happens to collect garbage, and delete tables of `materialise` that nothing reads any more."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            mine = [x for x in WRITTEN if x.rsplit("/", 1)[1] == path.rsplit("/", 1)[1]]
            for x in mine:
                delete(spark, x)
                WRITTEN.remove(x)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
