"""Toxicity by compression distance.

Two Zstandard dictionaries are trained on raw labelled text, one on ordinary and
one on toxic documents. A text is cut into overlapping windows, each window is
compressed under both dictionaries, and the differences of the two lengths,
calibrated on labelled documents that the dictionaries have not seen, give the
score.

Three things keep the differences clear of noise. Near copies count once in the
sample, so that a passage which happens to be copied in one class does not mark
it. The trainer is given those stretches of toxic text whose bytes are met in
clearly more toxic than ordinary documents, and windows of ordinary text without
such stretches; what both classes share would fill either dictionary alike. And
the toxic dictionary follows the ordinary one, in the place of which the other
compressor has as many bytes that match nothing: so ordinary text costs the same
under both.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.hashing import WordHashes, mix, texts, window_hashes
from wakeline.llm.store import materialise

#: Bytes of a window and from one window to the next.
WINDOW, STEP = 64, 48
#: Bytes of the runs that are counted, and bits of the table of their counts.
RUN, TABLE_BITS = 6, 20
#: Counters in one row of the table while it is summed up.
BLOCK_BITS = 12
#: Digits and signs that are written for letters, and the letters.
LOOKALIKES = str.maketrans("430157@$", "aeoistas")
#: Ends each window and both dictionaries: a block that is sure to compress is never stored raw, so that short windows have exact lengths.
PRIMER = bytes(range(128, 176))
#: Occurs in no text and matches nothing.
FILLER = b"\xff"
BANDS = 3


#: Marks put between the letters of a word, and letters that stand alone one after the other.
INSIDE = re.compile("(?<=[^\\W_])[-._*~'’·\u00ad\u200b-\u200d\u2060]+(?=[^\\W_])")
SPELLED = re.compile(r"(?<!\S)[^\W_](?: [^\W_]){2,}(?!\S)")


def canonical(text: str) -> bytes:
    """Lower case, lookalikes as letters, no marks inside words, spelled words put together, single spaces; a space at both ends."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = INSIDE.sub("", " ".join(text.lower().translate(LOOKALIKES).split()))
    return f" {SPELLED.sub(lambda m: m[0].replace(' ', ''), text)} ".encode()


def windows(data: bytes) -> list[bytes]:
    """Overlapping windows of the whole text, one at least."""
    return [data[i : i + WINDOW] for i in range(0, max(1, len(data) - (WINDOW - STEP)), STEP)]


def runs_of(data: bytes) -> np.ndarray:
    """The table places of all runs of RUN bytes."""
    a = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    if len(a) < RUN:
        return np.zeros(0, np.int64)
    return (window_hashes(a, RUN) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """The two dictionaries (raw content) and the calibration of the features."""

    toxic: bytes
    ordinary: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


def compressor(ordinary: bytes, toxic: bytes) -> Callable[[bytes], bytes]:
    """Compresses a window under both contents, one after the other."""
    import zstandard as z

    options = z.ZstdCompressionParameters(window_log=18, hash_log=16, chain_log=16, search_log=5, min_match=6, strategy=z.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False)
    content = z.ZstdCompressionDict(ordinary + toxic + PRIMER, dict_type=z.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(compression_params=options)
    return z.ZstdCompressor(compression_params=options, dict_data=content).compress


FEATURES = ["strongest", "total", "mean_gain", "density", "best_four", "log_density"]


class Gains:
    """Computes the features of a text from the windows' compressed lengths."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic = compressor(ordinary, toxic)
        self.ordinary = compressor(ordinary, FILLER * len(toxic))

    def of(self, text: str) -> tuple[float, ...]:
        """Features in bytes that the toxic dictionary saves: in the strongest window; beyond two a window in all; the mean gain; the mean beyond two; in the four strongest windows."""
        toxic, ordinary = self.toxic, self.ordinary
        gain = np.array([len(ordinary(w)) - len(toxic(w)) for w in (x + PRIMER for x in windows(canonical(text)))], float)
        over = np.maximum(gain - 2, 0).sum()
        n = len(gain) + 8
        four = np.maximum(np.sort(gain)[-4:], 0).sum()
        return float(np.log1p(max(0.0, gain.max()))), float(np.log1p(over)), float(gain.sum() / n), float(over / n), float(np.log1p(four)), float(np.log1p(50 * over / n))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def similarity_keys(text: str, words: WordHashes, size: int = 5) -> list[int]:
    """Keys of which texts that share most of their word runs have one in common, nearly surely."""
    w = text.encode().split()
    h = window_hashes(words.of(w), min(size, len(w))) if w else np.zeros(1, np.uint64)
    least = [int(mix(h ^ np.uint64(xxhash.xxh3_64_intdigest(b"%d" % i))).min()) for i in range(2 * BANDS)]
    return [xxhash.xxh3_64_intdigest(b"%d %d %d" % (i, least[2 * i], least[2 * i + 1])) - 2**63 for i in range(BANDS)]


def labelled_texts(docs: DataFrame, labels: DataFrame, max_rows: int, folds: int) -> tuple[DataFrame, dict[int, int]]:
    """(rows (id, text, toxic, part), all labelled rows by class): at most `max_rows` labelled documents that are not held out, up to a third of them toxic.

    They are taken by a hash of the id; the bound is that of what is broadcast to
    find their texts. Equal texts are one row (toxic if one of them is), and of
    texts that share a similarity key the first by hash stays. `part` is the fold, from 0.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("doc_id")
    taken = known.filter("toxic = 1").orderBy(order).limit(max_rows // 3).union(known.filter("toxic = 0").orderBy(order).limit(max_rows - max_rows // 3))
    taken = materialise(taken, "labels")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(taken), "doc_id")
    rows = rows.groupBy(F.xxhash64("text").alias("id")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            keys = [similarity_keys(t.decode(), words) for t in texts(batch["text"])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], names=["id", "text", "toxic", "keys"])

    rows = materialise(rows.mapInArrow(keyed, "id long, text string, toxic int, keys array<long>"), "labelled")
    by_key = rows.select("id", F.explode("keys").alias("key"))
    later = by_key.join(by_key.groupBy("key").agg(F.min("id").alias("first")), "key").filter("first <> id").select("id").distinct()
    distinct = rows.join(later, "id", "left_anti").select("id", "text", "toxic", F.pmod(F.col("id"), F.lit(folds)).cast("int").alias("part"))
    return materialise(distinct, "distinct-labelled"), counts


def telling_runs(rows: DataFrame, folds: int, min_docs: int, min_evidence: float, min_ratio: float) -> list[np.ndarray]:
    """Tables of flags, for dictionaries without fold 0, 1, … and from all: the runs met in clearly more toxic documents.

    A run is flagged if `min_docs` toxic documents or more hold it, their share
    is `min_ratio` times that of ordinary ones and chi-square is `min_evidence`
    or more. Counts are summed up in each task before the shuffle.
    """
    sizes = {(r["part"], r["toxic"]): r["n"] for r in rows.groupBy("part", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    block = 1 << BLOCK_BITS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for t, toxic, part in zip(texts(batch["text"]), batch["toxic"].to_pylist(), batch["part"].to_pylist(), strict=True):
                table = tables.setdefault((part, toxic), np.zeros(1 << TABLE_BITS, np.int32))
                table[np.unique(runs_of(canonical(t.decode())))] += 1
        for (part, toxic), table in tables.items():
            n = len(table) // block
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(n), pa.int32()), "part": pa.array([part] * n, pa.int32()), "toxic": pa.array([toxic] * n, pa.int32()), "counts": [x.tobytes() for x in table.reshape(n, block)]})

    def judged(t: pa.Table) -> pa.Table:
        n = np.zeros((folds, 2, block))
        for part, toxic, counts in zip(t["part"].to_pylist(), t["toxic"].to_pylist(), t["counts"].to_pylist(), strict=True):
            n[part, toxic] += np.frombuffer(counts, np.int32)
        flags = []
        for left_out in range(folds + 1):
            parts = [p for p in range(folds) if p != left_out]
            b, a = n[parts].sum(axis=0)
            n0, n1 = (max(1, sum(sizes.get((p, toxic), 0) for p in parts)) for toxic in (0, 1))
            expected = np.maximum((a + b) * n1 / (n0 + n1), 1e-9)
            chi = (a - expected) ** 2 * (1 / expected + 1 / np.maximum(a + b - expected, 1e-9))
            ratio = ((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))
            flags.append(np.packbits((a >= min_docs) & (ratio >= min_ratio) & (chi >= min_evidence)).tobytes())
        return pa.table({"block": t["block"].slice(0, 1), **{f"flags{i}": [f] for i, f in enumerate(flags)}})

    counts = rows.mapInArrow(counted, "block int, part int, toxic int, counts binary")
    columns = ", ".join(f"flags{i} binary" for i in range(folds + 1))
    found = counts.groupBy("block").applyInArrow(judged, f"block int, {columns}").collect()  # a bit a table for each place
    tables = [np.zeros(1 << TABLE_BITS, bool) for _ in range(folds + 1)]
    for r in found:
        for i, table in enumerate(tables):
            table[r["block"] * block : (r["block"] + 1) * block] = np.unpackbits(np.frombuffer(r[f"flags{i}"], np.uint8)).astype(bool)
    return tables


def stretches(data: bytes, flag: np.ndarray, margin: int = 1) -> list[bytes]:
    """The stretches of a text that flagged runs cover, with `margin` bytes on both sides."""
    hit = np.flatnonzero(flag[runs_of(data)])
    if not len(hit):
        return []
    first = np.append(True, np.diff(hit) > RUN)
    start, end = hit[first], hit[np.append(first[1:], True)] + RUN
    return [data[max(0, a - margin) : b + margin] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def training_samples(rows: DataFrame, flags: list[np.ndarray], max_samples: int) -> DataFrame:
    """Rows (model, toxic, sample): what each pair of dictionaries is trained on, about `max_samples` at most for each, taken and mixed by hash."""
    packed = [np.packbits(f).tobytes() for f in flags]
    n_windows = rows.filter("toxic = 0").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = min(1.0, max_samples * WINDOW / max(1, n_windows))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.unpackbits(np.frombuffer(p, np.uint8)).astype(bool) for p in packed]
        for batch in batches:
            out: list[tuple[int, int, int, bytes]] = []
            for doc, t, toxic, part in zip(batch["id"].to_pylist(), texts(batch["text"]), batch["toxic"].to_pylist(), batch["part"].to_pylist(), strict=True):
                data = canonical(t.decode())
                some = [] if toxic else [(w, runs_of(w)) for w in windows(data) if xxhash.xxh3_64_intdigest(w) < share * 2**64]
                for model, table in enumerate(tables):
                    if model == part:
                        continue
                    kept = stretches(data, table) if toxic else [w for w, runs in some if not table[runs].any()]
                    out += [(model, toxic, xxhash.xxh3_64_intdigest(b"%d %d" % (doc, i)) - 2**63, s) for i, s in enumerate(kept)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["model", "toxic", "at", "sample"])

    found = materialise(rows.mapInArrow(work, "model int, toxic int, at long, sample binary"), "dictionary-samples")
    sizes = found.groupBy("model", "toxic").agg(F.count(F.lit(1)).alias("n"))  # a row for each dictionary
    return found.join(F.broadcast(sizes), ["model", "toxic"]).filter(F.pmod(F.col("at"), F.lit(2**32)) * F.col("n") < F.lit(max_samples * 2**32)).drop("n")


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """Content chosen by the Zstandard trainer; where there is too little to train on, the samples themselves."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples, k=32, d=6).as_bytes()
    except z.ZstdError:
        return b"".join(samples)[-size:]


def train_dictionaries(rows: DataFrame, folds: int, toxic_bytes: int, ordinary_bytes: int, max_samples: int, min_docs: int, min_evidence: float, min_ratio: float) -> list[tuple[bytes, bytes]]:
    """(toxic, ordinary) dictionaries without fold 0, 1, … and from all. The trainer sees `max_samples` short samples at most for each."""
    flags = telling_runs(rows, folds, min_docs, min_evidence, min_ratio)

    def trained(t: pa.Table) -> pa.Table:
        toxic = t["toxic"][0].as_py()
        samples = t.sort_by([("at", "ascending"), ("sample", "ascending")])["sample"].to_pylist()
        return pa.table({"model": t["model"].slice(0, 1), "toxic": t["toxic"].slice(0, 1), "content": [train_dictionary(samples, toxic_bytes if toxic else ordinary_bytes)]})

    found = training_samples(rows, flags, max_samples).groupBy("model", "toxic").applyInArrow(trained, "model int, toxic int, content binary")
    content = {(r["model"], r["toxic"]): bytes(r["content"]) for r in found.collect()}  # a dictionary a row
    return [(content.get((m, 1), b""), content.get((m, 0), b"")) for m in range(len(flags))]


def gain_rows(rows: DataFrame, dictionaries: list[tuple[bytes, bytes]]) -> DataFrame:
    """Rows (carried, one column for each of FEATURES) of rows (carried, part, text), under the dictionaries number `part`."""
    names = ["carried", *FEATURES]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = [Gains(*d) for d in dictionaries]
        for batch in batches:
            found = [gains[part].of(t.decode()) for part, t in zip(batch["part"].to_pylist(), texts(batch["text"]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["carried"], *(pa.array([x[i] for x in found], pa.float64()) for i in range(len(FEATURES)))], names=names)

    return rows.select(F.col("carried").cast("long").alias("carried"), "part", "text").mapInArrow(work, "carried long, " + ", ".join(f"{f} double" for f in FEATURES))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the constant) by Newton steps with a ridge penalty."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 18_000,
    folds: int = 6,
    toxic_bytes: int = 4096,
    ordinary_bytes: int = 32_768,
    max_samples: int = 40_000,
    min_docs: int = 3,
    min_evidence: float = 30.0,
    min_ratio: float = 3.0,
    toxic_weight: float = 6.0,
) -> Model:
    """Fit on at most `max_rows` labelled documents that are not held out.

    The dictionaries are trained on all of these; the calibration sees each of
    them through dictionaries that are trained without its fold. A missed toxic
    document counts `toxic_weight` times as much as a false alarm. Rows that repeat a text count
    once; labels other than 0 and 1, and rows with a null id, teach nothing.
    With one class alone every score is the same, below a half.
    """
    rows, counts = labelled_texts(docs, labels, max_rows, folds)
    *without, (toxic, ordinary) = train_dictionaries(rows, folds, toxic_bytes, ordinary_bytes, max_samples, min_docs, min_evidence, min_ratio)
    gains = gain_rows(rows.select(F.col("toxic").alias("carried"), "part", "text"), without)
    found = gains.toPandas().to_numpy(float).reshape(-1, 1 + len(FEATURES))  # at most max_rows
    y, x = found[:, 0], found[:, 1:]
    if not len(y) or y.min() == y.max():
        return Model(toxic, ordinary, (0.0,) * len(FEATURES), (1.0,) * len(FEATURES), (0.0,) * len(FEATURES) + (-3.0,))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    # the sample's classes count as much as they have in all labelled rows
    share = {c: counts.get(c, 0) / max(1, (y == c).sum()) for c in (0, 1)}
    weight = np.where(y == 1, toxic_weight * share[1], share[0])
    w = fit_logistic((x - mean) / scale, y, weight * len(y) / weight.sum())
    return Model(toxic, ordinary, tuple(mean), tuple(scale), tuple(w))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each input row; only the text makes the score.

    A null text is an empty one; a null id is not held out; rows that repeat id
    or text are scored each on its own, equal texts alike; an empty table gives
    an empty one.
    """
    rows = docs.select(F.col("doc_id").alias("carried"), F.lit(0).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    found = gain_rows(rows, [(model.toxic, model.ordinary)])
    linear = F.lit(float(model.weights[-1]))
    for f, mean, scale, w in zip(FEATURES, model.mean, model.scale, model.weights, strict=False):
        linear = linear + (F.col(f) - float(mean)) / float(scale) * float(w)
    p = 1 / (1 + F.exp(-linear))
    return found.select(F.col("carried").alias("doc_id"), F.coalesce(held_out(F.col("carried")), F.lit(False)).alias("held_out"), p.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
