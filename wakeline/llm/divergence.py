"""Audit of how far the words of sources diverge, source by source and term by term.

A first reading of the texts builds a count-min sketch of the document
frequencies of all terms. Its cells only ever count too much, so a term below
the least number of documents there is below it in truth: a second reading
counts the terms of each source and lets the impossible ones go before the
shuffle. The survivors are counted exactly. Sources are then compared through
the terms they share; what both lack or only one holds is summed up by shares.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.hashing import MULTIPLIER, mix, texts
from wakeline.llm.store import materialise, release
from wakeline.llm.text import text_of

#: What a share of 1 is.
WHOLE = 1_000_000_000
#: Every byte that no term holds becomes a space, A to Z their small letters.
FLAT = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text whose terms are held at once.
STRETCH = 1 << 20
#: Pairs of a document and a term, and different terms, that a task holds before it passes them on.
HELD, HELD_TERMS = 1_500_000, 400_000
#: Rows of a batch passed on.
BATCH = 100_000
#: Cells of the sketch that travel together.
SLICE = 1 << 16
#: Parts in which the tasks' sketches are merged first.
MERGE_PARTS = 16


def term_runs(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, some at a time."""
    flat, at = raw.translate(FLAT), 0
    while at < len(flat):
        end = flat.find(b" ", at + STRETCH)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


class Sketch:
    """Count-min counters that stop at `most`: estimates are never below the true count, up to `most`."""

    def __init__(self, width: int, depth: int, most: int, cells: np.ndarray | None = None):
        if width & (width - 1) or not 1 <= most <= 255:
            raise ValueError("the width must be a power of two, the counters go to 255 at most")
        self.width, self.depth, self.most = width, depth, most
        self.cells = np.zeros(width * depth, np.uint8) if cells is None else cells

    def places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        """The cell of each hash in each row of counters."""
        for r in range(self.depth):
            row = mix(hashes + np.uint64(int(MULTIPLIER) * (r + 1) % 2**64)) & np.uint64(self.width - 1)
            yield row.astype(np.int64) + r * self.width

    def add(self, hashes: np.ndarray) -> None:
        """Count each hash once more, as often as it is listed."""
        for r, place in enumerate(self.places(hashes)):
            row = self.cells[r * self.width : (r + 1) * self.width]
            row[:] = np.minimum(np.bincount(place - r * self.width, minlength=self.width) + row, self.most)

    def estimate(self, hashes: np.ndarray) -> np.ndarray:
        return np.minimum.reduce([self.cells[p] for p in self.places(hashes)]) if len(hashes) else np.zeros(0, np.uint8)


class Numbers(dict):
    """Numbers the terms as they come."""

    def __missing__(self, term: bytes) -> int:
        found = self[term] = len(self)
        return found


def hashes_of(terms: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, n)


def in_lang(hashes: np.ndarray, lang: str) -> np.ndarray:
    """The hashes of terms, made different for each language."""
    return mix(hashes ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode())))


def zstd_slices(cells: np.ndarray) -> Iterator[tuple[int, bytes]]:
    packer = zstandard.ZstdCompressor(level=1)
    for i in range(0, len(cells), SLICE):
        if cells[i : i + SLICE].any():
            yield i // SLICE, packer.compress(cells[i : i + SLICE].tobytes())


SLICES = pa.schema([("slice", pa.int32()), ("cells", pa.binary())])


def merged(parts: DataFrame, most: int, *keys: str) -> DataFrame:
    """The sums of slices with equal keys, each counter stopped at `most`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, packed in zip(batch["slice"].to_pylist(), batch["cells"].to_pylist(), strict=True):
                cells = np.frombuffer(zstandard.decompress(packed), np.uint8).astype(np.uint16)
                sums[n] = np.minimum(sums[n] + cells, most) if n in sums else cells
        packer = zstandard.ZstdCompressor(level=1)
        for n, cells in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([packer.compress(cells.astype(np.uint8).tobytes())], pa.binary())], schema=SLICES)

    return parts.repartition(*keys).mapInArrow(work, "slice int, cells binary")


def frequency_sketch(docs: DataFrame, min_docs: int = 3, width: int = 1 << 22, depth: int = 3) -> Sketch:
    """The merged sketch of the document frequencies of all (lang, term) over rows (lang, text).

    `width` * `depth` bytes, whatever the input: that is all that the driver
    gets and sends. A width far below the number of different terms lets more
    terms pass, never fewer.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held, size = Sketch(width, depth, min_docs), [], 0
        for batch in batches:
            for lang, raw in zip(batch["lang"].to_pylist(), texts(batch["text"]), strict=True):
                seen: set[bytes] = set()
                for run in term_runs(raw):
                    seen.update(run)
                held.append(in_lang(hashes_of(seen, len(seen)), lang))
                size += len(seen)
                if size > HELD:
                    sketch.add(np.concatenate(held))
                    held, size = [], 0
        if held:
            sketch.add(np.concatenate(held))
        for n, packed in zstd_slices(sketch.cells):
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([packed], pa.binary())], schema=SLICES)

    parts = docs.select("lang", "text").mapInArrow(local, "slice int, cells binary").withColumn("part", F.spark_partition_id() % MERGE_PARTS)
    whole = materialise(merged(merged(parts, min_docs, "slice", "part"), min_docs, "slice"), "sketch")
    sketch = Sketch(width, depth, min_docs)
    for row in whole.toLocalIterator():
        cells = np.frombuffer(zstandard.decompress(bytes(row["cells"])), np.uint8)
        sketch.cells[row["slice"] * SLICE : row["slice"] * SLICE + len(cells)] = cells
    release(docs.sparkSession, whole)
    return sketch


def count_terms(docs: DataFrame, sketch: Sketch) -> DataFrame:
    """Rows (lang, source, term, n, docs): occurrences and documents of the terms that the sketch lets pass, summed up within tasks only."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(sketch.cells)  # width * depth bytes
    width, depth, most = sketch.width, sketch.depth, sketch.most
    out = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = Sketch(width, depth, most, sent.value)
        numbers, groups, of, terms, counts, size = Numbers(), Numbers(), [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            """The sums of what is held, by group and term."""
            group = np.repeat(np.array(of, np.int64), [len(t) for t in terms])
            key = group * max(1, len(numbers)) + np.concatenate(terms)
            order = np.argsort(key)
            key, first = np.unique(key[order], return_index=True)
            n = np.add.reduceat(np.concatenate(counts)[order], first)
            in_docs = np.diff(np.append(first, len(order)))
            group, term = np.divmod(key, len(numbers))
            langs, sources = (pa.array([g[i] for g in groups], pa.string()) for i in range(2))
            hashes = hashes_of(numbers, len(numbers))[term]
            for g, (lang, _) in enumerate(groups):
                a, b = np.searchsorted(group, (g, g + 1))
                hashes[a:b] = in_lang(hashes[a:b], lang)
            found = pa.array(list(numbers), pa.string())
            keep = np.flatnonzero(filter_.estimate(hashes) >= most)
            for i in range(0, len(keep), BATCH):
                at = keep[i : i + BATCH]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(group[at])), sources.take(pa.array(group[at])), found.take(pa.array(term[at])), pa.array(n[at]), pa.array(in_docs[at])], schema=out)

        for batch in batches:
            for lang, source, raw in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), texts(batch["text"]), strict=True):
                said = Counter()
                for run in term_runs(raw):
                    said.update(run)
                if said:
                    of.append(groups[lang, source])
                    terms.append(np.fromiter(map(numbers.__getitem__, said), np.int64, len(said)))
                    counts.append(np.fromiter(said.values(), np.int64, len(said)))
                    size += len(said)
                if size > HELD or len(numbers) > HELD_TERMS:
                    yield from flush()
                    numbers, groups, of, terms, counts, size = Numbers(), Numbers(), [], [], [], 0
        if of:
            yield from flush()

    return docs.select("lang", "source", "text").mapInArrow(work, "lang string, source string, term string, n long, docs long")


def share(n: str, total: str, v: str) -> str:
    """SQL of the smoothed share in billionths, exact: long numbers while they last, decimal ones beyond."""
    small = f"{WHOLE} * ({n} + 1) div ({total} + {v})"
    large = f"cast({WHOLE} as decimal(10,0)) * cast({n} + 1 as decimal(20,0)) div cast({total} + {v} as decimal(20,0))"
    return f"1 + case when {n} < 9000000000 then {small} else {large} end"


def excess(p: str, q: str) -> str:
    """SQL of how far share p lies from share q."""
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def source_divergence(docs: DataFrame, min_docs: int = 3, top: int = 200, width: int = 1 << 22, depth: int = 3) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) over rows (lang, source, text).

    Part `pair` has for each source of a language and each other one how far
    the first lies from the second, summed over all terms of the language; part
    `term` the `top` terms that tell a source from its language. A term is kept
    if at least `min_docs` rows of the language hold it. Equal values are
    ranked by the bytes of the item.

    Null lang, source or text count as empty; each row counts as a document,
    also if rows repeat; a source without terms still has its pairs (0 where the
    language keeps no term); an empty table gives no rows; columns other than
    lang, source and text are not read. Values are exact as long as a language
    keeps at most 10^9 terms.
    """
    rows = docs.select(*(text_of(F.col(c)).alias(c) for c in ("lang", "source", "text")))
    found = count_terms(rows, frequency_sketch(rows, min_docs, width, depth))
    # tasks have summed up already: to do it once more before the shuffle would save no rows
    counts = found.repartition("lang", "source", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # a term has a row for each source of its language by now
    w = Window.partitionBy("lang", "term")
    seen = counts.withColumns({"lang_docs": F.sum("docs").over(w), "lang_n": F.sum("n").over(w), "first": F.col("source") == F.min("source").over(w)})
    kept = materialise(seen.filter(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", "first"), "terms")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("v"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "lang_total", "v"])
    groups = materialise(groups.withColumn("p0", F.when(F.col("v") > 0, F.expr(share("0L", "total", "v")))), "sources")
    shares = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", F.expr(share("n", "total", "v")).alias("p"), F.expr(share("lang_n", "lang_total", "v")).alias("q"), "p0")
    shares = materialise(shares, "shares")
    release(docs.sparkSession, kept)
    return term_part(shares, top).unionByName(pair_part(shares, groups))


def ranked(rows: DataFrame, part: str) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.row_number().over(w).alias("rank"))


def term_part(shares: DataFrame, top: int) -> DataFrame:
    """The terms of greatest excess; as only `top` are ranked, each task passes on no more than that of a source."""
    above = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(excess("p", "q")).alias("value"))
    return ranked(above, "term").filter(F.col("rank") <= top)


def pair_part(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """The divergence of each source from each other one.

    All terms count as if neither source held them; to that comes for each
    source, by its few different shares, what its terms change on their own, and
    for terms of both, which the join finds, what they change together.
    """
    one = groups.select("lang", "source", "v", "p0")
    pairs = one.join(one.select("lang", F.col("source").alias("other"), F.col("p0").alias("o0")), "lang").filter("source <> other")
    pairs = materialise(pairs, "pairs")
    base = pairs.select("lang", "source", "other", F.expr(f"coalesce(v * {excess('p0', 'o0')}, 0L)").alias("value"))
    levels = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    own = levels.join(pairs, ["lang", "source"])
    ahead = own.groupBy("lang", "source", "other").agg(F.sum(F.expr(f"m * ({excess('p', 'o0')} - {excess('p0', 'o0')})")).alias("value"))
    behind = own.groupBy("lang", F.col("other").alias("source"), F.col("source").alias("other")).agg(F.sum(F.expr(f"m * ({excess('o0', 'p')} - {excess('o0', 'p0')})")).alias("value"))
    a = shares.select("lang", "term", "source", "p", "p0")
    b = shares.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("o"), F.col("p0").alias("o0"))
    joint = lambda p, q, p0, q0: F.expr(f"{excess(p, q)} - {excess(p, q0)} - {excess(p0, q)} + {excess(p0, q0)}")
    both = a.join(b, ["lang", "term"]).filter("source < other").groupBy("lang", "source", "other").agg(F.sum(joint("p", "o", "p0", "o0")).alias("value"), F.sum(joint("o", "p", "o0", "p0")).alias("back"))
    both = both.select("lang", F.inline(F.array(F.struct("source", "other", "value"), F.struct(F.col("other").alias("source"), F.col("source").alias("other"), F.col("back").alias("value")))))
    every = base.unionByName(ahead).unionByName(behind).unionByName(both)
    return ranked(every.groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value")), "pair")
