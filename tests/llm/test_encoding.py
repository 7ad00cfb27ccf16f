import hashlib
import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wakeline.llm import chunk_bpe, packing

WORD, BYTE, RANKS = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
AWKWARD = [
    None,
    "",
    " ",
    "it's you're WE'LL 'S don't",
    "a  b\n\n c \t d  ",
    "x y  z",
    "² ¼ 3½ 1²3",
    "<|endoftext|> a<|endoftext|><|startoftext|>b c<|",
    "é é e ́",
    "日本語 abc 123",
    "__a_b__ 12ab ½_",
    "\x1c a\x1d",
    "ª º µ ß ẞ ÿ Ÿ İ ǅ ΑΣ ΣΑΣ",
    "naïve — “quoted” ‘x’… 99€ 😀👍🏽",
    "\r\n\r\n x",
    "q" * 5000,
    "x" * 3000 + " " + "yz" * 2000,
    "ab " * 20_000,
]
DOCS = "doc_id long, text string"


def texts(spark):
    return AWKWARD + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]


def test_encode_decode(spark):
    t = Tokenizer.from_file(WORD)
    given = texts(spark) + AWKWARD[3:5]
    df = spark.createDataFrame(list(enumerate(given)), DOCS)
    got = {r["doc_id"]: r for r in chunk_bpe.encode_decode(df, WORD, mean_bytes=64, with_ids=True).collect()}
    for i, text in enumerate(given):
        ids = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        r = got[i]
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == decoded, text
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_chunks_are_reused():
    codec = chunk_bpe.ChunkCodec(WORD, mean_bytes=64)
    passage = " ".join(f"word{i} and" for i in range(300))
    codec.encode_batch([("start " + passage).encode()])
    before = len(codec.chunks)
    codec.encode_batch([("another longer beginning " + passage).encode()])
    assert before > 20 and len(codec.chunks) - before <= 3


def test_joins_are_encoded_again():
    codec, t = chunk_bpe.ChunkCodec(WORD, mean_bytes=16), Tokenizer.from_file(WORD)
    text = " ".join(f"Überlänge{i}-don't {i}x<|endoftext|>日本語" for i in range(200))
    chunks, through = codec.cut(text.encode())
    assert b"".join(chunks) == text.encode() and any(through)
    assert all(len(c.split()) > 1 and c.decode() for c in chunks)
    assert codec.encode_batch([text.encode()] * 2)[1][0] == " ".join(map(str, t.encode(text, add_special_tokens=False).ids)).encode()
    assert codec.chunks_met == 2 * len(chunks) and codec.chunks_encoded == len(set(chunks))


@pytest.mark.parametrize("text", ["", " ", "a", " \n" * 5000, "z" * 100_000, "z" * 5000 + " " * 5000 + "y", " a" * 3, "é" * 3000 + " é"])
def test_cuts_of_awkward_texts(text):
    codec, t = chunk_bpe.ChunkCodec(WORD, mean_bytes=16), Tokenizer.from_file(WORD)
    assert b"".join(codec.cut(text.encode())[0]) == text.encode()
    assert codec.encode_batch([text.encode()])[0][0] == " ".join(map(str, t.encode(text, add_special_tokens=False).ids)).encode()


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x")] * 2, "doc_id long, text string, n_tokens int, piece string")
    got = chunk_bpe.encode_decode(df, WORD).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0]["n_tokens"] == 2
    assert chunk_bpe.encode_decode(df.limit(0), WORD).count() == 0
    placed = packing.pack(packing.token_pieces(df, BYTE, BYTE.replace(".json", ".tiktoken"))).collect()
    assert len(placed) == 2 and {r["offset"] for r in placed} == {0, placed[0]["length"]}
    assert packing.pack(packing.token_pieces(df.limit(0), BYTE, BYTE.replace(".json", ".tiktoken"))).count() == 0


def test_tables_stay_bounded():
    codec = chunk_bpe.ChunkCodec(WORD, mean_bytes=64, max_words=50, max_chunk_bytes=1000)
    t = Tokenizer.from_file(WORD)
    for i in range(20):
        text = " ".join(f"w{i}x{j}" for j in range(40))
        assert codec.encode_batch([text.encode()])[0][0] == " ".join(map(str, t.encode(text, add_special_tokens=False).ids)).encode()
        assert len(codec.words) <= 90


def test_pieces(spark):
    t = Tokenizer.from_file(BYTE)
    given = texts(spark)
    df = spark.createDataFrame(list(enumerate(given)), DOCS)
    pieces = {}
    for r in packing.token_pieces(df, BYTE, RANKS, capacity=100).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, text in enumerate(given):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        at = 0
        for n, p in enumerate(sorted(pieces[i], key=lambda p: p["piece"])):
            assert (p["piece"], p["start"]) == (n, at) and p["ids_crc32"] == zlib.crc32(raw[4 * at : 4 * (at + p["length"])])
            assert p["length"] == 100 or n == 0
            at += p["length"]
        assert at == len(ids)


def check_packed(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pack_is_tight_and_whole(spark):
    rng = random.Random(1)
    rows = [(i, 0, 0, rng.choice([7, 64, 100, rng.randrange(1, 101)]), i % 5) for i in range(900)] + [(5, 0, 0, 33, 1)] * 3 + [(None, 0, 0, 60, 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(df, 100).collect()
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, rows))
    # no two pieces over half the room share a sequence
    least = max(-(-sum(r[3] for r in rows) // 100), sum(r[3] > 50 for r in rows))
    assert check_packed(got, 100) <= 1.02 * least + 1
    assert packing.pack(df.limit(0), 100).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_fullest_is_exact(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(6)}
    room = rng.randrange(20, 60)
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * k for s in sums for k in range(n + 1)}
    used = packing.fullest(counts, room)
    assert sum(used) == max(s for s in sums if s <= room) and all(used.count(x) <= counts[x] for x in set(used))
    plan = packing.minimum_bin_slack(counts, 60)
    assert sum(len(b) * n for b, n in plan) == sum(counts.values()) and all(sum(b) <= 60 for b, _ in plan)
