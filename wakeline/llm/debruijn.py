"""Substring dedup by compacted paths of a de Bruijn graph of words.

The edges of the graph are the runs of 20 words. Consecutive edges of a document
that share their minimizer (the least hash of the short runs inside) form a
path; equal runs have equal minimizers, so equal text falls into equal paths.
Paths whose minimizer is met once cannot repeat and go first. Equal paths are
compacted to their earliest source by a join; where paths with one minimizer
differ (the graph branches) their single edges are compared. Repeats that go on
along one source are joined to long spans, and the words of each span are
compared with those at its source's coordinates. What is not the earliest source
is removed from the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.hashing import WordHashes, mix, texts, window_hashes
from wakeline.llm.store import materialise, release
from wakeline.llm.text import SPACE_RUN, text_of

#: Words of the short runs among which the minimizer is found.
SHORT = 5
#: A document is known by its id and the fingerprint of its words; null ids come before all others.
DOC = ["doc", "fp"]
#: Edges of a source that one mask tells of.
BLOCK = 62
#: Stands for a null id.
LOWEST = -(2**63)
#: Gives the word hashes for a seed.
Hashes = Callable[[int], WordHashes]


def paths(sizes: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Paths of several documents whose word hashes lie one after the other in `h`.

    Returns for each path its document's number, its first edge's place in that
    document, the number of its edges and its minimizer; and the hashes of the
    edges that begin at each word of `h` (of use only inside a document).
    """
    ends = np.cumsum(sizes)
    edge = window_hashes(h, k)
    if not len(edge):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64), edge
    short = window_hashes(h, SHORT)
    place = np.lib.stride_tricks.sliding_window_view(short, k - SHORT + 1).argmin(axis=1) + np.arange(len(edge))
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(edge)]
    valid = np.arange(len(edge)) + k <= ends[owner]
    new = np.append(True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1]))
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(edge)))
    keep = valid[first]
    first, count = first[keep], count[keep]
    own = owner[first]
    return own, first - (ends - sizes)[own], count, short[place[first]], edge


def batches_of_words(batches: Iterator[pa.RecordBatch], column: str, most: int = 100_000) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of the batches with the words of their texts, about `most` words each."""
    for batch in batches:
        words, held, begin = [], 0, 0
        for i, t in enumerate(texts(batch[column])):
            words.append(t.split())
            held += len(words[-1]) + 1
            if held >= most:
                yield batch.slice(begin, i + 1 - begin), words
                words, held, begin = [], 0, i + 1
        if words:
            yield batch.slice(begin), words


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def fingerprint(words: list[bytes]) -> int:
    """What `xxhash64` of Spark gives for the words joined by single spaces."""
    x = xxhash.xxh64_intdigest(b" ".join(words), 42)
    return x - 2**64 if x >= 2**63 else x


def documents(docs: DataFrame, key: str, text: str, unique: bool) -> DataFrame:
    """Rows (key, doc, fp, text). Where ids repeat, `fp` is `fingerprint` of the words, else 0."""
    words = F.trim(F.regexp_replace(text_of(F.col(text)), SPACE_RUN, " "))
    given = F.col(key).cast("long")
    return docs.select(given.alias("key"), F.coalesce(given, F.lit(LOWEST)).alias("doc"), (F.lit(0).cast("long") if unique else F.xxhash64(words)).alias("fp"), F.col(text).alias("text"))


def path_rows(docs: DataFrame, k: int, hashes: Hashes, seed: int) -> DataFrame:
    """Rows (m, path, doc, fp, at) for all paths.

    `at` packs first edge * 32 + edges. A path's edges overlap, so the hashes of
    its first and last one and their number tell its words.
    """
    names = ["m", "path", *DOC, "at"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hashes(seed)
        for batch, words in batches_of_words(batches, "text"):
            sizes = np.array([len(w) for w in words], np.int64)
            own, start, count, m, edge = paths(sizes, known.of([w for ws in words for w in ws]), k)
            first = (np.cumsum(sizes) - sizes)[own] + start
            path = mix(edge[first] * np.uint64(3) + edge[first + count - 1] * np.uint64(0x9FB21C651E98DF25) + count.astype(np.uint64))
            columns = [pa.array(signed(m)), pa.array(signed(path)), *(batch[x].take(pa.array(own)) for x in DOC), pa.array(start * 32 + count)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(*DOC, "text").mapInArrow(work, "m long, path long, doc long, fp long, at long")


def edge_rows(docs: DataFrame, wanted: DataFrame, k: int, hashes: Hashes, seed: int) -> DataFrame:
    """Rows (m, edge, doc, fp, start): the single edges of the paths (doc, fp, at) in `wanted`."""
    per_doc = wanted.groupBy(*DOC).agg(F.array_sort(F.collect_set("at")).alias("wanted"))  # at most a document's words

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hashes(seed)
        for batch, words in batches_of_words(batches, "text"):
            sizes = np.array([len(w) for w in words], np.int64)
            own, start, count, m, edge = paths(sizes, known.of([w for ws in words for w in ws]), k)
            begin = np.cumsum(sizes) - sizes
            lists = batch["wanted"]
            asked = np.repeat(np.arange(len(words)), lists.value_lengths().to_numpy(zero_copy_only=False))
            at = lists.flatten().to_numpy(zero_copy_only=False) // 32
            # paths are in order of document and start, and so is what is asked for
            rank = np.searchsorted(begin[own] + start, begin[asked] + at)
            own, start, count, m = own[rank], start[rank], count[rank], m[rank]
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            first = np.repeat(begin[own] + start, count) + nth
            whose = [batch[x].take(pa.array(np.repeat(own, count))) for x in DOC]
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.repeat(m, count))), pa.array(signed(edge[first])), *whose, pa.array(np.repeat(start, count) + nth)], names=["m", "edge", *DOC, "start"])

    return docs.join(per_doc, DOC).select(*DOC, "text", "wanted").mapInArrow(work, "m long, edge long, doc long, fp long, start long")


def repeats(docs: DataFrame, k: int, hashes: Hashes, seed: int) -> DataFrame:
    """Rows (doc, fp, start, n, sdoc, sfp, sstart): n edges of a document from `start` on, and the earliest source of the same.

    What each step leaves is written, so that the tables and shuffle files of
    the steps before can go.
    """
    spark = docs.sparkSession
    every = materialise(path_rows(docs, k, hashes, seed), "paths")
    met_again = every.groupBy("m").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("m")
    met_again = materialise(met_again, "minimizers")
    release(spark)
    rows = materialise(every.join(met_again, "m"), "repeated-paths")
    release(spark, every, met_again)
    first = rows.groupBy("m", "path").agg(F.min(F.struct(*DOC, "at")).alias("source"), F.count(F.lit(1)).alias("copies"))
    first = materialise(first, "path-sources")
    release(spark)
    copied = first.filter("copies > 1").select("m", "path", "source")
    later = rows.join(copied, ["m", "path"]).filter(F.struct(*DOC, "at") != F.col("source"))
    later = materialise(later.select(*DOC, F.expr("at div 32").alias("start"), F.expr("at % 32").alias("n"), F.col("source.doc").alias("sdoc"), F.col("source.fp").alias("sfp"), F.expr("source.at div 32").alias("sstart")), "later-paths")
    release(spark, rows)
    # where paths of one minimizer differ, their earliest sources are compared edge by edge
    branching = first.groupBy("m").agg(F.count(F.lit(1)).alias("paths")).filter("paths > 1").select("m")
    heads = materialise(first.join(branching, "m").select("source.*"), "branching-paths")
    edges = materialise(edge_rows(docs, heads, k, hashes, seed), "branch-edges")
    release(spark, first, heads)
    here = F.struct(*DOC, "start")
    sources = edges.groupBy("m", "edge").agg(F.min(here).alias("source"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("m", "edge", "source")
    single = edges.join(sources, ["m", "edge"]).filter(here != F.col("source")).select(*DOC, "start", F.lit(1).cast("long").alias("n"), F.col("source.doc").alias("sdoc"), F.col("source.fp").alias("sfp"), F.col("source.start").alias("sstart"))
    return later.union(single)


def long_spans(rows: DataFrame) -> DataFrame:
    """Rows like those of `repeats`, those that go on along one source joined to one, cut at every BLOCK edges of the source.

    Each row sets bits in a mask of the source's block, so rows are summed up
    before the shuffle. The cuts bound the different spans of a source by its
    own length, however many documents repeat it.
    """
    last = F.col("sstart") + F.col("n")
    cut = rows.withColumn("block", F.explode(F.sequence(F.expr(f"sstart div {BLOCK}"), F.expr(f"(sstart + n - 1) div {BLOCK}"))))
    base = F.col("block") * BLOCK
    low, high = (F.greatest("sstart", base) - base).cast("int"), (F.least(last, base + BLOCK) - base).cast("int")
    cut = cut.select(*DOC, "sdoc", "sfp", (F.col("start") - F.col("sstart")).alias("shift"), "block", low.alias("low"), high.alias("high"))
    mask = F.expr("bit_or(shiftleft(shiftleft(1L, high - low) - 1L, low))")
    masks = cut.groupBy(*DOC, "sdoc", "sfp", "shift", "block").agg(mask.alias("mask"))
    # the lowest run of bits is mostly the only one; then adding its lowest bit carries it away
    low = "(mask & -mask)"
    begins = f"filter(sequence(0, {BLOCK - 1}), i -> getbit(mask & ~shiftleft(mask, 1), i) = 1)"
    ends = f"filter(sequence(0, {BLOCK - 1}), i -> getbit(mask & ~shiftright(mask, 1), i) = 1)"
    one = f"named_struct('begin', bit_count({low} - 1), 'end', bit_count({low} - 1) + bit_count(mask) - 1)"
    several = f"zip_with({begins}, {ends}, (b, e) -> named_struct('begin', b, 'end', e))"
    spans = masks.withColumn("span", F.expr(f"explode(if(((mask + {low}) & mask) = 0, array({one}), {several}))"))
    at = F.col("block") * BLOCK + F.col("span.begin")
    return spans.select(*DOC, (at + F.col("shift")).alias("start"), (F.col("span.end") - F.col("span.begin") + 1).cast("long").alias("n"), "sdoc", "sfp", at.alias("sstart"))


SOURCE = ["sdoc", "sfp", "sstart", "n"]


def without_repeats(docs: DataFrame, spans: DataFrame, k: int, with_text: bool) -> DataFrame:
    """Rows (key, n_words, n_removed, kept_sha256[, kept_text], checks).

    `checks` holds, for each span of a row and each span that others have from
    it, the coordinates of the source and two hashes of the words that stand
    here.
    """
    asked = spans.select(*SOURCE).distinct().select(F.col("sdoc").alias("doc"), F.col("sfp").alias("fp"), F.col("sstart").alias("start"), "n", "sdoc", "sfp", "sstart", F.lit(False).alias("later"))
    both = spans.withColumn("later", F.lit(True)).unionByName(asked)
    per_doc = both.groupBy(*DOC).agg(F.collect_list(F.struct("start", "n", "sdoc", "sfp", "sstart", "later")).alias("found"))  # in proportion to a document's words
    joined = docs.join(per_doc, DOC, "left").select("key", "text", "found")
    names = ["key", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text + ["checks"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["found"]
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            start, n, later = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("start", "n", "later"))
            ends = np.cumsum(sizes)
            n_words, n_removed, digests, kept_texts, hashes = [], [], [], [], []
            for t, lo, hi in zip(texts(batch["text"]), (ends - sizes).tolist(), ends.tolist(), strict=True):
                w = t.split()
                first, stop = start[lo:hi], start[lo:hi] + n[lo:hi] + k - 1
                hashes += [xxhash.xxh3_128_digest(b" ".join(w[a:b])) for a, b in zip(first.tolist(), stop.tolist(), strict=True)]
                gone = np.zeros(len(w) + 1, np.int64)
                np.add.at(gone, first[later[lo:hi]], 1)
                np.add.at(gone, stop[later[lo:hi]], -1)
                left = np.cumsum(gone)[:-1] == 0
                kept = b" ".join(w) if left.all() else b" ".join([w[i] for i in np.flatnonzero(left)])
                n_words.append(len(w)), n_removed.append(int(len(w) - left.sum())), digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_texts.append(kept.decode())
            h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            checks = pa.StructArray.from_arrays([*(flat.field(x) for x in SOURCE), pa.array(h[:, 0]), pa.array(h[:, 1])], names=[*SOURCE, "h0", "h1"])
            checks = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), checks)
            columns = [batch["key"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())] + [pa.array(kept_texts, pa.string())] * with_text + [checks]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    check = "array<struct<" + ", ".join(f"{x}: bigint" for x in [*SOURCE, "h0", "h1"]) + ">>"
    return joined.mapInArrow(work, "key long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text + f", checks {check}")


def dedup_substrings(docs: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", with_text: bool = False, hashes: Hashes = lambda seed: WordHashes(seed=seed), tries: int = 8) -> DataFrame:
    """Rows (key, n_words, n_removed, kept_sha256[, kept_text]), one for each input row.

    Removes every word inside a run of `k` words that also begins earlier: in a
    document with a smaller id, or in the same one at an earlier word. Runs are
    judged on the input. A null text has no words. A null id is smaller than
    all others; rows that repeat an id with other words are documents of their
    own, in the order of a hash of the words; rows that repeat both are one
    document, and each gets its result.

    Repeats are found by hashes and then compared at the coordinates of their
    sources. If words differ there, hashes have clashed, and all is done again
    with another seed, up to `tries` times.
    """
    unique = docs.groupBy(F.coalesce(F.col(key).cast("long"), F.lit(LOWEST))).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    rows = documents(docs, key, text, unique)
    for seed in range(tries):
        spans = materialise(long_spans(repeats(rows, k, hashes, seed)), "repeats")
        release(docs.sparkSession)
        done = materialise(without_repeats(rows, spans, k, with_text), "without-repeats")
        release(docs.sparkSession)
        sides = done.select(F.explode("checks").alias("c")).select("c.*").groupBy(*SOURCE).agg(*(f(x).alias(f"{x}_{f.__name__}") for x in ("h0", "h1") for f in (F.min, F.max)))
        if sides.filter("h0_min <> h0_max or h1_min <> h1_max").isEmpty():
            return done.drop("checks").withColumnRenamed("key", key)
    raise RuntimeError(f"hashes of words clashed under {tries} seeds")
