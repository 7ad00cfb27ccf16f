"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.store import materialise


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """Rows (node, component): the smallest node reachable, for all nodes that have a link.

    Alternates large-star and small-star steps until no link changes. Each step
    is a minimum per node, summed up before its shuffle, and one join, so a hub
    with very many links is never gathered in one group. Every round is written
    to the shared folder. Nulls, loops and repeated links do no harm.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    real = x.isNotNull() & y.isNotNull() & (x != y)
    now = materialise(links.filter(real).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "links")
    nodes = now
    state = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u links to the least of u and its neighbours
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = now.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # small star: u and its smaller neighbours link to the least of them
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
        now = materialise(small.filter("u != v").distinct(), "links")
        said = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if said == state:
            break
        state = said
    else:
        raise RuntimeError(f"no components after {max_rounds} rounds")
    own = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return own.join(now.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
