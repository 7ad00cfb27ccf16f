"""Near-duplicate documents by DartMinHash.

A document is the weighted set of its five-word shingles. Darts, hashed from the
element alone, fall on the region of each element's weight; each coordinate of
the signature keeps the earliest dart that hits it, so two signatures agree in a
coordinate with the chance of their weighted Jaccard similarity. Bands of
coordinates are joined, signatures compared inside the buckets, and pairs whose
estimate is near the threshold or above it are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.components import connected_components
from wakeline.llm.hashing import WordHashes, fingerprint, mix, texts, window_hashes
from wakeline.llm.store import materialise
from wakeline.llm.vectors import forest

#: Edges of the bands of ranks below 1; above 1 the bands are [1, 2), [2, 4), …, dealt in units.
FRACTIONS = [0.0, 0.125, 0.25, 0.5, 1.0]
CHANCES = {w: np.cumsum([math.exp(-w) * w**i / math.factorial(i) for i in range(20)]) for w in {b - a for a, b in zip(FRACTIONS, FRACTIONS[1:], strict=False)} | {1.0}}


def cells(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Unit cells of weighted sets, with the number of the set: the n-th occurrence of an element is its n-th unit of weight."""
    sizes = [len(x) for x in sets]
    owner = np.repeat(np.arange(len(sets)), sizes)
    s = np.concatenate([np.zeros(0, np.uint64), *map(np.sort, sets)])
    new = np.append(True, (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])) if len(s) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    nth = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    return mix(s + nth.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), owner


def thrown(cell: np.ndarray, width: float, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, rank in the band, number) of the darts that hit cells in a band of ranks: Poisson many, spread evenly, the same for the cell in every document."""
    u = mix(cell ^ salt)
    chance = CHANCES[width]
    uniform = (u >> np.uint64(11)) * 2.0**-53
    hit = np.flatnonzero(uniform >= chance[0])
    n = np.searchsorted(chance, uniform[hit], side="right")
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    number = mix(np.repeat(u[hit], n) + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
    return np.repeat(hit, n), width * ((number >> np.uint64(11)) * 2.0**-53), number * np.uint64(0xE7037ED1A0B428DB)


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """(sets, k) 16-bit coordinates; the sets of shingle hashes must not be empty.

    A set of weight w gets the bands of ranks up to about k (ln k + 2) / w, so
    that k ln k darts or more hit it whatever its size, and more bands while a
    coordinate has no dart.
    """
    cell, owner = cells(sets)
    n = len(sets)
    needs = k * (math.log(k) + 2) / np.array([len(x) for x in sets])
    best = np.zeros(n * k, np.uint16)
    open_ = np.ones(n * k, bool)
    band, low, high = 0, FRACTIONS[0], FRACTIONS[1]
    while True:
        active = (needs > low) | open_.reshape(n, k).any(axis=1)
        if not active.any():
            return best.reshape(n, k)
        mine = np.flatnonzero(active[owner])
        c, own = cell[mine], owner[mine]
        if low < 1:
            at, rank, number = thrown(c, high - low, np.uint64(band + 1))
        else:
            units = np.tile(np.arange(int(low), int(high)), len(c))
            c, own = np.repeat(c, int(high - low)), np.repeat(own, int(high - low))
            at, rank, number = thrown(c, 1.0, mix(units.astype(np.uint64) + np.uint64(1000)))
            rank = rank + units[at]
        place = own[at] * k + ((number >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
        earliest = np.full(n * k, np.inf)
        np.minimum.at(earliest, place, rank)
        wins = np.flatnonzero((rank == earliest[place]) & open_[place])
        best[place[wins]] = (number[wins] >> np.uint64(16)).astype(np.uint16)
        open_ &= np.isinf(earliest)
        band += 1
        low, high = high, FRACTIONS[band + 1] if band + 1 < len(FRACTIONS) else high * 2


def shingle_hashes(w: list[bytes], words: WordHashes, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words; a shorter text is one shingle, an empty one none."""
    h = words.of(w)
    return window_hashes(h, min(size, len(w))) if w else np.zeros(0, np.uint64)


def sketch(docs: DataFrame, k: int, size: int, key: str, text: str) -> DataFrame:
    """Rows (doc, fp, text_key, sig): key, fingerprint of the word sequence, hash of the text, signature (null for a text without words)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()

        def done(keys: list, fps: list[int], raw: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            full = [x for x in sets if len(x)]
            sigs = iter(signatures(full, k)) if full else iter(())
            column = [next(sigs).tobytes() if len(x) else None for x in sets]
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (keys, fps, raw)), pa.array(column, pa.binary())], names=["doc", "fp", "text_key", "sig"])

        keys, fps, raw, sets, held = [], [], [], [], 0
        for batch in batches:
            for doc, t, x in zip(batch[0].to_pylist(), texts(batch[1]), batch[2].to_pylist(), strict=True):
                w = t.split()
                keys.append(doc), fps.append(fingerprint(w)), raw.append(x), sets.append(shingle_hashes(w, words, size))
                held += len(w) + 20
                if held > 100_000:
                    yield done(keys, fps, raw, sets)
                    keys, fps, raw, sets, held = [], [], [], [], 0
        if keys:
            yield done(keys, fps, raw, sets)

    return keyed(docs, key, text).mapInArrow(work, "doc long, fp long, text_key long, sig binary")


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (doc, text, text_key) of the rows with an id."""
    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key")).filter(F.col("doc").isNotNull())


def runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows sorted by `names`: tables with the starts of their groups; only a group cut by the end of a batch is held over."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        starts = group_starts(t, names)
        last = int(starts[-1]) if len(starts) else 0
        if last:
            yield t.slice(0, last).combine_chunks(), starts[:-1]
        rest = t.slice(last)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), group_starts(rest, names)


def group_starts(t: pa.Table, names: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for name in names:
        x = t[name].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def compare(sig: np.ndarray, part: np.ndarray, tree: np.ndarray, band: int, rows: int, within: bool, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, estimate) of the pairs of a block that lie in different trees and meet in no earlier band, with an estimate of `floor` or more."""
    n, k = sig.shape
    if (tree == tree[0]).all():
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    found = []
    for begin in range(0, n, 64):
        same = sig[begin : begin + 64, None, :] == sig[None, begin:, :]
        share = same.sum(axis=2, dtype=np.int32) / k
        a, b = np.nonzero(share >= floor)
        s = share[a, b]
        early = same[a, b, : band * rows].reshape(len(a), band, rows).all(axis=2).any(axis=1) if band else np.zeros(len(a), bool)
        fit = (a < b) & ~early & (tree[a + begin] != tree[b + begin]) & (within | (part[a + begin] != part[b + begin]))
        found.append((a[fit] + begin, b[fit] + begin, s[fit]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


BLOCK = ["band", "bucket", "i", "j"]


def blocks_of(t: pa.Table, starts: np.ndarray, rows: int, floor: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end, a, b, estimate) of each block of a table of whole blocks."""
    part, tree, band, i, j = (t[x].to_numpy() for x in ("part", "tree", "band", "i", "j"))
    sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(t.num_rows, -1)
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
        yield lo, hi, *compare(sig[lo:hi], part[lo:hi], tree[lo:hi], int(band[lo]), rows, bool(i[lo] == j[lo]), floor)


def bucket_members(reps: DataFrame, bands: int, rows: int, *others: str) -> DataFrame:
    """Rows (doc, others, band, bucket)."""
    width = rows * 2
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * width + 1, F.lit(width))))
    return reps.filter(F.col("sig").isNotNull()).select("doc", *others, F.posexplode(keys).alias("band", "bucket"))


def star_links(members: DataFrame, docs: DataFrame, centres: int, similarity: float, size: int, block_rows: int, key: str, text: str) -> DataFrame:
    """Rows (a, b): links of the members (doc, band, bucket) of large buckets to a few centres, checked exactly on the whole texts.

    The centres of a bucket are its members of least hash under `centres` seeds.
    A member is compared with the least of those of all its buckets, so that a
    family agrees on them although its bands fall into many buckets: at most
    `centres` comparisons a text. A centre goes with each part of its members.
    """
    lead = [F.min(F.struct(F.xxhash64("doc", F.lit(s)).alias("h"), "doc")).alias(f"c{s}") for s in range(centres)]
    led = members.join(members.groupBy("band", "bucket").agg(*lead), ["band", "bucket"])
    own = led.groupBy("doc").agg(*(F.min(f"c{s}").alias(f"c{s}") for s in range(centres)))
    pairs = own.select("doc", F.explode(F.array_distinct(F.array(*(F.col(f"c{s}.doc") for s in range(centres))))).alias("centre")).filter("doc <> centre")
    pairs = materialise(pairs, "stars")
    parts = pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
    rays = pairs.join(parts, "centre").select("centre", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("part"), "doc")
    hubs = parts.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("centre").alias("doc"))
    given = keyed(docs, key, text).select("doc", "text")
    block = ["centre", "part"]
    dealt = materialise(rays.union(hubs), "rays").join(given, "doc").select(*block, "doc", "text").repartition(*block).sortWithinPartitions(*block, "doc")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for t, starts in runs(batches, block):
            doc, centre = t["doc"].to_numpy(), t["centre"].to_numpy()
            out: list[tuple[int, int]] = []
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
                sets = [shingle_hashes(x.split(), words, size) for x in texts(t["text"].slice(lo, hi - lo))]
                hub = int(np.flatnonzero(doc[lo:hi] == centre[lo])[0])
                rest = np.flatnonzero(doc[lo:hi] != centre[lo])
                links = linked(np.full(len(rest), hub), rest, np.zeros(len(rest)), sets, np.arange(hi - lo), similarity)
                out += [(int(doc[lo + x]), int(doc[lo + y])) for x, y in links]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(work, "a long, b long")


def candidates(reps: DataFrame, members: DataFrame, rows: int, floor: float, block_rows: int) -> DataFrame:
    """Rows (band, bucket, i, j, part, tree, doc, text_key, sig): the texts of each block that meet there one of another tree with an estimate of `floor` or more.

    `reps` and `members` carry the `tree` of the text: what checked links connect
    already. In each bucket all pairs of texts of different trees are compared by
    their signatures, blocks of it at a time, each pair in the first band where
    it meets. The texts of the bucket's largest tree meet the others alone, so a
    bucket of n texts of one tree and m others costs (n + m) * m comparisons.
    Texts go on, not pairs, so their number does not grow with the square of a bucket.
    """
    trees = members.groupBy("band", "bucket", "tree").agg(F.count(F.lit(1)).alias("n"))
    sizes = trees.groupBy("band", "bucket").agg(F.max(F.struct("n", "tree")).alias("top"), F.sum("n").alias("n")).filter("n > top.n")
    large = F.col("n") > block_rows
    others = F.when(large, F.ceil((F.col("n") - F.col("top.n")) / block_rows)).otherwise(1).cast("int")
    sizes = sizes.select("band", "bucket", others.alias("others"), F.when(large, F.ceil(F.col("top.n") / block_rows)).otherwise(0).cast("int").alias("tops"), F.when(large, F.col("top.tree")).alias("top"))
    sizes = materialise(sizes, "bucket-sizes")
    meets = members.join(sizes, ["band", "bucket"]).groupBy("doc").agg(F.collect_set(F.struct("band", "bucket", "others", "tops", "top")).alias("meets"))  # at most `bands` a text
    dealt = reps.join(meets, "doc").select("doc", "text_key", "sig", "tree", F.explode("meets").alias("m")).select("doc", "text_key", "sig", "tree", "m.*")
    in_top = F.col("tree").eqNullSafe(F.col("top"))
    salt = F.xxhash64("doc")
    part = F.when(in_top, F.col("others") + F.pmod(salt, F.greatest("tops", F.lit(1)))).otherwise(F.pmod(salt, F.col("others"))).cast("int")
    last = F.when(in_top, F.col("others")).otherwise(F.col("others") + F.col("tops")) - 1
    blocks = F.transform(F.sequence(F.lit(0), last), lambda q: F.struct(F.least("part", q).alias("i"), F.greatest("part", q).alias("j")))
    dealt = dealt.withColumn("part", part).withColumn("block", F.explode(blocks)).select("band", "bucket", "block.i", "block.j", "part", "tree", "doc", "text_key", "sig")
    dealt = dealt.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "doc")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in runs(batches, BLOCK):
            hit = np.zeros(t.num_rows, bool)
            for lo, _, a, b, _ in blocks_of(t, starts, rows, floor):
                hit[lo + a] = hit[lo + b] = True
            yield from t.filter(pa.array(hit)).combine_chunks().to_batches()

    return dealt.mapInArrow(work, dealt.schema)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of the multisets of two arrays."""
    (x, _), (y, _) = cells([a]), cells([b])
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def linked(a: np.ndarray, b: np.ndarray, s: np.ndarray, sets: list[np.ndarray], tree: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of a block that connect all that the true ones among the pairs (a, b) connect; what shares a `tree` is connected before.

    A forest of the pairs, most alike first, is checked on the shingles; then each
    pair whose ends are not yet connected, so that no pair is given up for
    another that fails. Every link is checked, however high its estimate.
    """
    cell, owner = cells(sets)
    _, cell = np.unique(cell, return_inverse=True)
    ends = np.cumsum(np.bincount(owner, minlength=len(sets)))
    own = np.split(cell, ends[:-1])
    size = np.diff(ends, prepend=0)
    mark = np.zeros(cell.max(initial=-1) + 1, bool)
    label = np.unique(tree, return_inverse=True)[1]
    kept: list[tuple[int, int]] = []

    def check(x: int, ys: np.ndarray) -> None:
        mark[own[x]] = True
        both = np.add.reduceat(mark[np.concatenate([own[y] for y in ys])], np.cumsum(size[ys]) - size[ys], dtype=np.int64)
        mark[own[x]] = False
        for y in ys[both / (size[x] + size[ys] - both) >= similarity].tolist():
            if label[x] != label[y]:
                label[label == label[y]] = label[x]
                kept.append((x, y))

    order = np.argsort(-s, kind="stable")
    for x, y in forest(len(sets), a[order], b[order]):
        if label[x] != label[y]:
            check(x, np.array([y]))
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    first = np.append(np.flatnonzero(np.diff(a, prepend=-1)), len(a)).tolist()
    for lo, hi in zip(first, first[1:], strict=False):
        x, ys = int(a[lo]), b[lo:hi]
        open_ = label[ys] != label[x]
        if open_.any():
            check(x, ys[open_])
    return kept


def verified(met: DataFrame, docs: DataFrame, rows: int, similarity: float, floor: float, size: int, key: str, text: str) -> DataFrame:
    """Rows (a, b): links that connect in each block what is alike enough by the exact measure on the whole texts."""
    given = keyed(docs, key, text)
    full = met.join(given, ["doc", "text_key"]).select(*BLOCK, "part", "tree", "doc", "text_key", "sig", "text")
    full = full.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "doc", "text_key")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for t, _ in runs(batches, BLOCK):
            t = t.take(group_starts(t, [*BLOCK, "doc", "text_key"])).combine_chunks()  # rows that repeat id and text: one of them
            doc, tree, starts = t["doc"].to_numpy(), t["tree"].to_numpy(), group_starts(t, BLOCK)
            out: list[tuple[int, int]] = []
            for lo, hi, a, b, s in blocks_of(t, starts, rows, floor):
                if len(a):
                    sets = [shingle_hashes(x.split(), words, size) for x in texts(t["text"].slice(lo, hi - lo))]
                    out += [(int(doc[lo + x]), int(doc[lo + y])) for x, y in linked(a, b, s, sets, tree[lo:hi], similarity)]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return full.mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, size: int = 5, bands: int = 25, rows: int = 6, margin: float = 0.1, block_rows: int = 1000, centres: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, class_id), one for each input row: the smallest id of the row's class.

    Two documents link if their word sequences are equal or the weighted Jaccard
    similarity of their shingles is `similarity` or more; classes are connected
    components. Pairs with an estimate of similarity - `margin` (three standard
    deviations of bands * rows coordinates) or more are compared exactly on the
    whole texts, unless checked links of their block connect them already: an
    estimate alone is no link. Members of buckets of
    more than `block_rows` texts are first checked against `centres` of them, so
    that a large family of near copies is connected in work that grows with its
    rows; only pairs that this leaves unconnected are compared. Texts without
    words are copies of each other. Rows that repeat an id count as one document
    and have one class, rows with a null id are in no class (null); an empty
    table gives an empty one.
    """
    k = bands * rows
    rows_ = materialise(sketch(docs, k, size, key, text), "signatures")
    reps = rows_.groupBy("fp").agg(F.min(F.struct("doc", "text_key", "sig")).alias("r")).select("fp", "r.doc", "r.text_key", "r.sig")
    reps = materialise(reps, "distinct-texts")
    floor = similarity - margin
    members = bucket_members(reps, bands, rows)
    large = materialise(members.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_rows), "large-buckets")
    stars = materialise(star_links(members.join(large, ["band", "bucket"]), docs, centres, similarity, size, block_rows, key, text), "star-links")
    trees = materialise(connected_components(stars).withColumnRenamed("node", "doc"), "trees")
    placed = materialise(reps.join(trees, "doc", "left").select("doc", "text_key", "sig", F.coalesce("component", "doc").alias("tree")), "placed-texts")
    members = bucket_members(placed, bands, rows, "tree")
    met = materialise(candidates(placed, members, rows, floor, block_rows), "candidates")
    links = verified(met, docs, rows, similarity, floor, size, key, text).union(stars)
    # the smallest id with a text stands for its copies, so that they are no links of one hub
    copies = rows_.select("doc", "fp").join(reps.select("fp", F.col("doc").alias("rep")), "fp").select("doc", "rep")
    ids = materialise(copies.groupBy("doc").agg(F.min("rep").alias("rep"), F.max("rep").alias("other")), "ids")
    # an id repeated with another text ties the classes of its texts together
    several = ids.filter("rep <> other").select("doc", F.col("rep").alias("a"))
    tied = copies.join(several, "doc").select("a", F.col("rep").alias("b"))
    components = connected_components(links.union(tied))
    classes = ids.join(components.withColumnRenamed("node", "rep"), "rep", "left").select("doc", F.coalesce("component", "rep").alias("class_id"))
    return docs.select(F.col(key).cast("long").alias("doc")).join(classes, "doc", "left").select(F.col("doc").alias(key), "class_id")
