"""Embedding near-dedup by random-hyperplane sign hashing.

Vectors of a label are hashed into several tables by the signs of their products
with random hyperplanes. Vectors that meet in a bucket are compared by the exact
cosine in double precision; links are counted in the first table where both
meet, and a spanning forest of them goes on to connected components.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.blocks import bucket_blocks
from wakeline.llm.components import connected_components
from wakeline.llm.store import materialise


def label_shapes(reps: DataFrame, cosine: float, bucket_rows: int, miss: float) -> DataFrame:
    """Rows (label, dims, bits, tables) of the labels that one bucket is too small for.

    `bits` makes buckets of about `bucket_rows` rows of that label, whatever the
    others hold; there are so many tables that a pair at `cosine` is missed with
    at most chance `miss`. A label that is not listed is one bucket (no bits, one table).
    """
    sizes = reps.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n"))
    bits = F.least(F.lit(24), F.round(F.log2(F.col("n") / bucket_rows))).cast("int")
    same_sign = 1 - math.acos(cosine) / math.pi
    tables = F.ceil(F.lit(math.log(miss)) / F.log1p(-F.pow(F.lit(same_sign), F.col("bits")))).cast("int")
    return sizes.withColumn("bits", bits).filter("bits > 0").select("label", "dims", "bits", tables.alias("tables"))


def unit_rows(raw, width: int) -> np.ndarray:
    """Packed components as rows of length 1, in double precision."""
    unit = np.frombuffer(b"".join(raw), "<f4" if width == 4 else "<f8").astype(float).reshape(len(raw), -1)
    unit = unit / np.abs(unit).max(axis=1, keepdims=True)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def signs(vectors: np.ndarray, planes: np.ndarray, tables: int) -> np.ndarray:
    """(rows, tables) bucket numbers."""
    bits = planes.shape[1] // tables
    up = (vectors @ planes >= 0).reshape(len(vectors), tables, bits)
    return (up * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Those of the links (a[i], b[i]) that join two trees, taken in order."""
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            root[q] = p
            kept.append((x, y))
    return kept


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """Distinct usable vectors (rep, copies, label, e): no null, empty, zero or non-finite ones, no null label or id.

    Copies (equal label and components) collapse into the smallest id, before
    any comparison; `copies` counts their rows.
    """
    e = F.transform(F.col(embedding), lambda x: x.cast("double"))
    good = F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), e.alias("e"))
    return rows.filter(good & F.col("label").isNotNull() & F.col("vec_id").isNotNull())


def link_vectors(vectors: DataFrame, threshold: float = 0.93, miss: float = 2e-4, bucket_rows: int = 200, seed: int = 7, block_rows: int = 1500, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each input row.

    Two vectors link if their labels are equal and not null and their cosine is
    `threshold` or more. Vectors that are null, empty, zero or hold null or
    non-finite components, and those of other lengths than their partner, link
    with nothing, nor do rows with a null id. Rows that repeat an id with equal
    components are linked as copies; rows of one id with other components share
    the id's links. The number of hyperplanes follows the number of rows of the
    label, that of tables follows from it and from `miss`, the chance to overlook
    a pair just at the threshold; small labels are compared whole. No bucket is
    capped: large ones are compared in blocks.
    """
    rows = usable(vectors, vec_id, embedding, label).withColumn("copy_key", F.xxhash64("e", "label")).withColumn("dims", F.size("e"))
    reps = rows.groupBy("label", "copy_key", "e", "dims").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = materialise(reps, "vectors")

    width = 4 if vectors.schema[embedding].dataType.elementType.simpleString() == "float" else 8
    shapes = materialise(label_shapes(reps, threshold, bucket_rows, miss), "label-shapes")
    shaped = reps.join(shapes, ["label", "dims"], "left").select("label", "dims", "rep", "copies", "e", F.coalesce("bits", F.lit(0)).alias("bits"), F.coalesce("tables", F.lit(1)).alias("tables"))

    def hashed(batches):
        planes: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            for (dims, bits, tables), part in pdf.groupby(["dims", "bits", "tables"]):
                if (dims, bits) not in planes:
                    planes[dims, bits] = np.random.default_rng([seed, bits]).standard_normal((int(dims), int(bits * tables)))
                raw = [np.asarray(e, "<f4" if width == 4 else "<f8").tobytes() for e in part["e"]]
                codes = signs(unit_rows(raw, width), planes[dims, bits], int(tables))
                yield pd.DataFrame({"label": part["label"].to_numpy(), "dims": part["dims"].to_numpy(), "rep": part["rep"].to_numpy(), "copies": part["copies"].to_numpy(), "raw": raw, "codes": [c.tobytes() for c in codes], "buckets": list(codes)})

    kind = reps.schema["label"].dataType.simpleString()
    sketch = materialise(shaped.mapInPandas(hashed, f"label {kind}, dims int, rep long, copies long, raw binary, codes binary, buckets array<int>"), "sketches")
    members = sketch.select("label", "dims", "rep", "copies", "raw", "codes", F.posexplode("buckets").alias("table", "bucket"))
    members = members.withColumn("codes", F.expr("substring(codes, 1, table * 4)"))  # those of the tables before tell where a pair met first
    keys = ["label", "dims", "table", "bucket"]
    blocks = bucket_blocks(members, keys, F.xxhash64("rep"), block_rows, "bucket-sizes")

    def compared(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        table, (i, j) = int(key[2]), (int(key[4]), int(key[5]))
        pdf = pdf.sort_values("rep", ignore_index=True)
        unit, part = unit_rows(pdf["raw"].to_list(), width), pdf["part"].to_numpy()
        codes = np.frombuffer(b"".join(pdf["codes"]), np.int32).reshape(len(pdf), table)
        links, copies = np.zeros(len(pdf), np.int64), pdf["copies"].to_numpy()
        found_a, found_b = [], []
        for begin in range(0, len(pdf), 500):
            near = unit[begin : begin + 500] @ unit.T >= threshold
            a, b = np.nonzero(near)
            a += begin
            fit = (a < b) & ((part[a] != part[b]) if i != j else True)
            a, b = a[fit], b[fit]
            for at in range(0, len(a), 200_000):
                p, q = a[at : at + 200_000], b[at : at + 200_000]
                first = ~(codes[p] == codes[q]).any(axis=1)  # not met in an earlier table
                p, q = p[first], q[first]
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                found_a.append(p), found_b.append(q)
        rep = pdf["rep"].to_numpy()
        tree = forest(len(pdf), np.concatenate([*found_a, np.zeros(0, int)]), np.concatenate([*found_b, np.zeros(0, int)]))
        hit = np.flatnonzero(links)
        extra = [(rep[a], rep[b], 0) for a, b in tree]
        out = pd.DataFrame([(rep[k], rep[k], links[k]) for k in hit] + extra, columns=["a", "b", "n"])
        return out.astype({"a": "int64", "b": "int64", "n": "int64"})

    dealt = blocks.select(*keys, F.col("block.i").alias("i"), F.col("block.j").alias("j"), "part", "rep", "copies", "raw", "codes")
    found = materialise(dealt.groupBy(*keys, "i", "j").applyInPandas(compared, "a long, b long, n long"), "vector-links")
    counts = found.filter("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    components = connected_components(found.filter("a != b"))
    per_rep = reps.select("label", "copy_key", "e", "rep", "copies").join(counts, "rep", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    per_rep = per_rep.select("label", "copy_key", "e", F.coalesce("component", "rep").alias("component"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"))
    given = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.transform(F.col(embedding), lambda x: x.cast("double")).alias("e")).withColumn("copy_key", F.when(F.col("vec_id").isNotNull(), F.xxhash64("e", "label")))
    done = given.join(per_rep, ["label", "copy_key", "e"], "left")
    component = F.coalesce("component", "vec_id")
    return done.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
