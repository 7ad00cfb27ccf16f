"""Dealing the members of hash buckets into bounded blocks for all-against-all work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.store import materialise


def bucket_blocks(members: DataFrame, keys: list[str], salt: Column, block_rows: int, name: str) -> DataFrame:
    """Add `block` (struct i, j), so that members in blocks (i, j) of one bucket meet all others of the bucket exactly once.

    Buckets with one member go. A bucket with n members is split into
    s = ceil(n / block_rows) parts by `salt`; part p takes part in the blocks
    (p, q) and (q, p) with the lower part first. Column `part` is the member's
    own part: in block (i, j) with i < j only members of different parts are to
    be compared. The counts are summed up before the shuffle.
    """
    sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = materialise(sizes.select(*keys, F.ceil(F.col("n") / block_rows).cast("int").alias("parts")), name)
    dealt = members.join(sizes, keys).withColumn("part", F.pmod(salt, F.col("parts")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least("part", q).alias("i"), F.greatest("part", q).alias("j")))
    return dealt.withColumn("block", F.explode(others)).drop("parts")
