"""Tables that change as a whole: readers see the state before a change or after it, and never one in between.

A root folder holds Parquet folders that are never changed and a small list of
them for each version. Writing adds folders, which no reader knows of; the
change takes place when the next list is renamed into its place. What a crash
leaves behind before that is not listed, and `vacuum` deletes it.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wakeline.operators.carry import known_ship, update_from

LISTS, DATA, PART = "_versions", "data", "__part"
#: Name that Spark gives the folder of a null (or empty) partition value.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def children(spark: SparkSession, path: str) -> list[str]:
    fs, where = file_system(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def current(spark: SparkSession, root: str) -> tuple[int, dict]:
    """(number, list) of the newest version; number 0 if there is none."""
    numbers = [int(name[:-5]) for name in children(spark, f"{root}/{LISTS}") if name.endswith(".json")]
    if not numbers:
        return 0, {"tables": {}, "batches": {}}
    fs, where = file_system(spark, f"{root}/{LISTS}/{max(numbers):09d}.json")
    stream = fs.open(where)
    try:
        return max(numbers), json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def read(spark: SparkSession, root: str, name: str = "rows", values: list[str | None] | None = None, listed: dict | None = None) -> DataFrame:
    """A table of the newest version, or of a given list; with `values` only those partitions are read."""
    table = (listed or current(spark, root)[1])["tables"].get(name)
    if table is None:
        raise ValueError(f"no table {name} in {root}")
    schema = StructType.fromJson(table["schema"])
    folders = [f"{root}/{folder}" for value, folder in table["folders"] if values is None or value in values]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


class Draft:
    """The next version of a root, made from the newest one; nothing counts before `commit`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.number, self.listed = current(spark, self.root)

    def write(self, df: DataFrame, partition: str | None) -> list[list[str | None]]:
        """Write rows in a new folder, or one for each value of the column `partition`; [value, folder] of each."""
        folder = f"{DATA}/{uuid.uuid4().hex}"
        if partition is None:
            df.write.parquet(f"{self.root}/{folder}")
            return [[None, folder]]
        df.withColumn(PART, F.col(partition).cast("string")).write.partitionBy(PART).parquet(f"{self.root}/{folder}")
        names = [n for n in children(self.spark, f"{self.root}/{folder}") if n.startswith(f"{PART}=")]
        values = [unquote(n.split("=", 1)[1]) for n in names]
        return [[None if v == NO_VALUE else v, f"{folder}/{n}"] for v, n in zip(values, names, strict=True)]

    def replace(self, df: DataFrame, name: str = "rows", partition: str | None = None) -> DataFrame:
        """Give a table new rows; `df` may read the old ones. Returns what was written."""
        self.listed["tables"][name] = {"schema": json.loads(df.schema.json()), "partition": partition, "folders": self.write(df, partition)}
        return read(self.spark, self.root, name, listed=self.listed)

    def append(self, df: DataFrame, name: str = "rows", partition: str | None = None) -> None:
        table = self.listed["tables"].get(name)
        if table is None:
            self.replace(df, name, partition)
        else:
            table["folders"] += self.write(df.select(*StructType.fromJson(table["schema"]).names), table["partition"])

    def update(self, source: DataFrame, key: str, columns: list[str], order: str, name: str = "rows") -> list[str | None]:
        """Take `columns` from the source row of the same key, as `update_from` does; only partitions that hold such a key are written anew.

        Returns the values of those partitions.
        """
        table = self.listed["tables"][name]
        partition = table["partition"]
        if partition in columns:
            raise ValueError("rows cannot move between partitions")
        rows = read(self.spark, self.root, name, listed=self.listed)
        keys = source.filter(known_ship(key)).select(key).distinct()
        if partition is None:
            touched = [None]
        else:
            value = F.nullif(F.col(partition).cast("string"), F.lit(""))
            met = rows.select(key, value.alias("value")).join(keys, key, "left_semi").select("value").distinct()
            touched = [r["value"] for r in met.collect()]  # values of partitions, as many as folders at most
        if touched:
            old = read(self.spark, self.root, name, touched, self.listed)
            new = self.write(update_from(old, source, key, columns, order).select(*rows.columns), partition)
            table["folders"] = [f for f in table["folders"] if f[0] not in touched] + new
        return touched

    def commit(self, batch: tuple[str, int] | None = None) -> None:
        """Make this the newest version. Raises if another writer was faster: of two drafts of one version the second fails."""
        if batch:
            self.listed["batches"][batch[0]] = batch[1]
        fs, temporary = file_system(self.spark, f"{self.root}/{LISTS}/.{uuid.uuid4().hex}")
        _, final = file_system(self.spark, f"{self.root}/{LISTS}/{self.number + 1:09d}.json")
        out = fs.create(temporary)
        out.write(bytearray(json.dumps(self.listed).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(temporary, final):
            fs.delete(temporary, False)
            raise RuntimeError(f"version {self.number + 1} of {self.root} is there already")

    def has_batch(self, batch: tuple[str, int]) -> bool:
        return self.listed["batches"].get(batch[0], -1) >= batch[1]


def update_table(spark: SparkSession, root: str, source: DataFrame, key: str, columns: list[str], order: str, batch: tuple[str, int] | None = None, name: str = "rows") -> list[str | None]:
    """One keyed update as one version; a batch (stream, number) that is already in counts once. Returns the partitions written anew."""
    draft = Draft(spark, root)
    if batch and draft.has_batch(batch):
        return []
    touched = draft.update(source, key, columns, order, name)
    draft.commit(batch)
    return touched


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete all but the `keep` newest lists and every folder that none of those names; not while a draft is being written."""
    names = [n for n in children(spark, f"{root}/{LISTS}") if n.endswith(".json")]
    used = set()
    for n in names[-keep:]:
        fs, where = file_system(spark, f"{root}/{LISTS}/{n}")
        stream = fs.open(where)
        listed = json.loads(bytes(stream.readAllBytes()).decode())
        stream.close()
        used |= {folder for t in listed["tables"].values() for _, folder in t["folders"]}
    for n in names[:-keep]:
        fs, where = file_system(spark, f"{root}/{LISTS}/{n}")
        fs.delete(where, False)
    for folder in children(spark, f"{root}/{DATA}"):
        parts = [f"{DATA}/{folder}", *(f"{DATA}/{folder}/{p}" for p in children(spark, f"{root}/{DATA}/{folder}") if p.startswith(f"{PART}="))]
        mine = used & set(parts)
        for part in parts if mine else parts[:1]:
            if part not in mine and not (mine and part == parts[0]):
                fs, where = file_system(spark, f"{root}/{part}")
                fs.delete(where, True)
