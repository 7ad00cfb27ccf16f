"""Line dedup by site-relative frequency.

A line is boilerplate of a host when the share of the host's pages that hold it
exceeds a ratio. Such lines are dropped from the pages of that host alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.store import materialise
from wakeline.llm.text import SPACES, text_of


def line_key(line: Column) -> Column:
    """64-bit key of a line; white space at its ends is not told apart."""
    return F.xxhash64(F.btrim(line, F.lit(SPACES)))


def host_line_frequency(pages: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """Rows (host, line_key, n_pages, host_pages) for lines with a word.

    A line counts once a page. Counts are summed before the shuffle, so neither
    a line that all pages hold nor a host with a third of all pages gathers in
    one task. A null host is a host of its own.
    """
    lines = F.array_distinct(F.transform(F.filter(F.split(text_of(F.col(text)), "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != ""), line_key))
    # one row a page stands for the page itself (null key), so that one pass gives both counts
    keys = F.concat(F.array(F.lit(None).cast("long")), lines)
    counts = pages.select(F.col(host).alias("host"), F.explode(keys).alias("line_key")).groupBy("host", "line_key").agg(F.count(F.lit(1)).alias("n_pages"))
    return counts


def boilerplate_lines(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.1, min_pages: int = 3) -> DataFrame:
    """Rows (host, host_pages, line_keys): the keys of each host's boilerplate lines.

    A line on p of a host's n pages is boilerplate if p >= min_pages and
    p > max_ratio * n. A host has at most (mean distinct lines a page) /
    max_ratio of them, however many pages it has. Hosts without any are absent.
    """
    counts = materialise(host_line_frequency(pages, host, text).filter(F.col("line_key").isNull() | (F.col("n_pages") >= min_pages)), "line-counts")
    totals = counts.filter(F.col("line_key").isNull()).select("host", F.col("n_pages").alias("host_pages"))
    lines = counts.filter(F.col("line_key").isNotNull())
    frequent = lines.alias("l").join(totals.alias("t"), F.expr("l.host <=> t.host AND l.n_pages > t.host_pages * {r}D".format(r=max_ratio)))
    return frequent.groupBy(F.col("t.host").alias("host"), "host_pages").agg(F.sort_array(F.collect_list("line_key")).alias("line_keys"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.1, min_pages: int = 3, out: str = "boilerplate") -> DataFrame:
    """Add struct column `out` (n_lines, n_dropped, text) with boilerplate lines dropped.

    Lines without a word are kept unless all other lines go. A null text counts
    as empty and stays null; an empty table gives an empty table; repeated rows
    are pages of their own. Other columns pass through; one named as `out` is
    replaced.
    """
    found = materialise(boilerplate_lines(pages, host, text, max_ratio, min_pages), "boilerplate").select(F.col("host").alias("of_host"), F.col("line_keys").alias("keys"))
    rows = pages.select(F.struct(*(pages[c] for c in pages.columns)).alias("row"))  # no name of a column can clash
    joined = rows.join(found, F.col("row").getField(host).eqNullSafe(F.col("of_host")), "left")
    own = F.col("row").getField(text)
    lines = F.split(text_of(own), "\n", -1)
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("keys"), line_key(x)), F.lit(False)))
    kept = F.when(F.col("keys").isNull(), lines).otherwise(kept)
    cleaned = F.struct(
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.col("kept_lines"))).cast("long").alias("n_dropped"),
        F.when(own.isNull(), F.lit(None).cast("string")).otherwise(F.array_join(F.col("kept_lines"), "\n")).alias("text"),
    )
    others = [F.col("row").getField(c).alias(c) for c in pages.columns if c != out]
    return joined.withColumn("kept_lines", kept).select(*others, cleaned.alias(out))
