"""Best-fit packing of token pieces into fixed-length sequences.

Minimum bin slack: for each bin a bitset subset-sum dynamic programme over the
lengths still available finds the fullest feasible combination, which is then
removed. Only the histogram of lengths (at most `capacity` counters) takes part,
so the plan is made once for all rows, and a combination is used as often as its
lengths last. Spark then deals the pieces to the places of the plan by their
rank among the pieces of the same length.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.store import materialise

#: Texts of other characters go to the slower library whole: for these few
#: the character classes of both libraries' patterns are known to agree.
PLAIN = re.compile("[\t\n\x0b\x0c\r\x20-\x7e¡-©«-¬®-±´¶-¸»¿-ɏ–—‘-„†-•…]*")


@functools.lru_cache(maxsize=4)
def load_encoder(json_path: str, ranks_path: str):
    """Function from a text to its ids (numpy, unsigned 32 bits), as the tokenizer in `json_path` gives them.

    `ranks_path` holds the same vocabulary for the faster library, which does
    all texts of plain characters; the special tokens are those of `json_path`.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    slow.no_truncation()
    slow.no_padding()
    special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)

    def encode(text: str) -> np.ndarray:
        if PLAIN.fullmatch(text):
            return fast.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; a remainder comes first."""
    head = n % capacity
    starts = ([0] if head else []) + list(range(head, n, capacity))
    return list(zip(starts, [b - a for a, b in zip(starts, [*starts[1:], n], strict=True)], strict=True))


def token_pieces(docs: DataFrame, json_path: str, ranks_path: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows (key, piece, start, length, ids_crc32[, ids]), one for each piece of each document.

    A null or empty text has the end id alone. Texts are tokenised whole. Other
    columns are left out, whatever their names; an empty table gives an empty one.
    """
    fields = [(key, pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    out = pa.schema([pa.field(*f) for f in fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = load_encoder(json_path, ranks_path), int(end_id).to_bytes(4, "little")
        for batch in batches:
            keys, pieces, starts, lengths, sums, held = [], [], [], [], [], []
            for k, t in zip(batch[0].to_pylist(), batch[1], strict=True):
                ids = encode(t.as_py() or "").astype("<u4", copy=False).tobytes() + end
                for i, (a, n) in enumerate(cut(len(ids) // 4, capacity)):
                    keys.append(k), pieces.append(i), starts.append(a), lengths.append(n), sums.append(zlib.crc32(ids[4 * a : 4 * (a + n)]))
                    if with_ids:
                        held.append(np.frombuffer(ids, "<i4")[a : a + n])
            columns = [keys, pieces, starts, lengths, sums] + [held] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, out, strict=True)], schema=out)

    return docs.select(F.col(key).cast("long").alias(key), F.col(text)).mapInArrow(work, f"`{key}` long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, each used at most as often as counted, whose sum is the largest one up to `room`."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        n, part = min(counts[length], room // length), 1
        while n > 0:  # binary parts: any number of uses from 0 to n is a sum of them
            take = min(part, n)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            n, part = n - take, part * 2
        if reach >> room & 1:
            break
    left, used = reach.bit_length() - 1, []
    for before, length, take in reversed(steps):
        if not before >> left & 1:
            used += [length] * take
            left -= length * take
    return used


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins), until no piece is left.

    Each bin starts with the largest length left; the others are the fullest
    combination for the rest of it. Every entry uses up a length or repeats as
    often as it can, so there are not many more entries than lengths.
    """
    counts, plan = {k: v for k, v in histogram.items() if v > 0}, []
    while counts:
        largest = max(counts)
        counts[largest] -= 1
        bin_ = [largest, *fullest({k: v for k, v in counts.items() if v}, capacity - largest)]
        counts[largest] += 1
        times = min(counts[x] // bin_.count(x) for x in set(bin_))
        for x in bin_:
            counts[x] -= times
        counts = {k: v for k, v in counts.items() if v}
        plan.append((bin_, times))
    return plan


def with_rank(pieces: DataFrame, group_rows: int = 1_000) -> DataFrame:
    """Add `rank`, 0, 1, … among the pieces of the same length.

    Pieces of a length are dealt to so many salted groups that each has about
    `group_rows` rows, and ranked there; the groups' sizes, summed, give each
    group its first rank.
    """
    groups = F.greatest(F.lit(1), F.ceil(F.col("n") / group_rows)).cast("int")
    per_length = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).select("length", groups.alias("__groups"))
    salted = pieces.join(F.broadcast(per_length), "length")  # a row for each length up to the capacity
    salted = salted.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "__copy"), F.col("__groups")).cast("int")).drop("__groups")
    sizes = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32", "__copy")
    ranked = salted.withColumn("__at", F.row_number().over(inside) - 1)
    return ranked.join(sizes.select("length", "__salt", before.alias("__before")), ["length", "__salt"]).withColumn("rank", F.col("__at") + F.col("__before")).drop("__salt", "__at", "__before")


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add sequence_id and offset to rows (doc_id, piece, start, length, ids_crc32).

    Needs lengths from 1 to `capacity`; further columns (`ids`) stay. Full pieces
    are sequences of their own, numbered after the packed ones; they take no part
    in ranking. Repeated rows are pieces of their own, told apart by `__copy`; an
    empty table gives an empty one.
    """
    spark = pieces.sparkSession
    columns = pieces.columns
    pieces = materialise(pieces.withColumn("__copy", F.monotonically_increasing_id()), "pieces")
    full, pieces = pieces.filter(F.col("length") == capacity), pieces.filter(F.col("length") < capacity)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    rows, base, used = [], 0, dict.fromkeys(histogram, 0)
    for bin_, times in minimum_bin_slack(histogram, capacity):
        offsets: dict[int, list[int]] = {}
        at = 0
        for x in bin_:
            offsets.setdefault(x, []).append(at)
            at += x
        for x, places in offsets.items():
            rows.append((x, used[x], used[x] + times * len(places), base, places))
            used[x] += times * len(places)
        base += times
    plan = spark.createDataFrame(rows, "length long, lo long, hi long, base long, places array<long>")
    by_length = plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "base", "places"))).alias("runs"))  # a row for each length
    placed = with_rank(pieces).join(F.broadcast(by_length), "length")
    placed = placed.withColumn("run", F.get(F.filter("runs", lambda r: (r["lo"] <= F.col("rank")) & (F.col("rank") < r["hi"])), F.lit(0)))
    nth, per_bin = F.col("rank") - F.col("run.lo"), F.size("run.places")
    placed = placed.withColumn("sequence_id", F.col("run.base") + F.floor(nth / per_bin)).withColumn("offset", F.get("run.places", (nth % per_bin).cast("int")))
    alone = full.select(*columns, (F.lit(base) + F.col("__copy")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.select(*columns, "sequence_id", "offset").union(alone)
