"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts texts into chunks, so that passages shared by
documents fall into equal chunks wherever they stand. A chunk is encoded once
in a task and its result reused. What a cut may have spoilt is repaired at the
joins: the words around a cut are encoded again, as a stretch of text that grows
to both sides until its ids begin as those of the left chunk and end as those of
the right one.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes after which no token and no normalisation reaches across.
BREAKS = b" \t\n\x0b\x0c\r"


#: Words of these characters are encoded by the faster library. For them case
#: folding and character classes of both libraries agree, and no normal form matters.
PLAIN = re.compile("[!-~¡-©«-±´¶-¸»¿-ÿ–—‘-„†-•…]*")
NUMBERS = re.compile("[²³¹¼-¾]|<\\|")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")
#: Stands for the end of a word; it occurs in no text, as it is no part of UTF-8.
WORD_END = b"\xff"


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in order from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.lru_cache(maxsize=4)
def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@functools.lru_cache(maxsize=4)
def load_words(path: str):
    """Function from a list of words (bytes, without breaks) to the ids of each, as the tokenizer gives them."""
    import tiktoken

    slow, to_byte = load_tokenizer(path), byte_of_char()
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    end, special = model["end_of_word_suffix"], {t.content for t in slow.get_added_tokens_decoder().values()}
    ranks = {}
    for token, i in model["vocab"].items():
        if token not in special:
            ended = token.endswith(end)
            ranks[bytes(to_byte[c] for c in (token.removesuffix(end) if ended else token)) + WORD_END * ended] = i
    ranks.setdefault(WORD_END, max(ranks.values()) + 1)
    single = tiktoken.Encoding("words", pat_str=r"[^\s]+", mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)._core_bpe.encode_single_piece

    def encode(words: list[bytes]) -> list[list[int]]:
        found, rest = [], []
        for i, w in enumerate(words):
            text = w.decode()
            if PLAIN.fullmatch(text) and not NUMBERS.search(text):
                ids = []
                for piece in PIECE.findall(text.lower()):
                    ids += single(piece.encode() + WORD_END)
                found.append(ids)
            else:
                found.append([])
                rest.append(i)
        if rest:
            for i, e in zip(rest, slow.encode_batch_fast([words[i].decode() for i in rest], add_special_tokens=False), strict=True):
                found[i] = e.ids
        return found

    size = slow.get_vocab_size()
    return encode, [(b"%d " % i, (slow.decode([i], skip_special_tokens=False) + " ").encode()) for i in range(size)]


def chunk_ends(data: np.ndarray, mean_bytes: int, window: int = 16) -> np.ndarray:
    """Ends of content-defined chunks of a byte array: after each byte where the hash of the last `window` bytes is 0 mod `mean_bytes`."""
    if len(data) < window:
        return np.array([len(data)])
    h, width, base = data.astype(np.uint64) + np.uint64(1), 1, np.uint64(0x9E3779B97F4A7C15)
    while width < window:  # hashes of 2, 4, 8 and 16 bytes from those of half as many
        h = h[:-width] * base + (h[width:] ^ (h[width:] >> np.uint64(29)))
        base, width = base ^ np.uint64(width * 0x632BE59BD9B4E019 % 2**64), width * 2
    ends = np.flatnonzero((h >> np.uint64(20)) % np.uint64(mean_bytes) == 0) + window
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


Pair = tuple[bytes, bytes]


class Chunk:
    """The words of a chunk, as cut, and its encoding: of the first word, of those between, of the last one."""

    __slots__ = ("words", "first", "body", "last")

    def __init__(self, words: list[bytes], known: dict[bytes, Pair]):
        self.words = words
        self.first, self.last = known[words[0]], known[words[-1]]
        self.body = joined([known[w] for w in words[1:-1]])


def joined(pairs: list[Pair]) -> Pair:
    return b"".join([x[0] for x in pairs]), b"".join([x[1] for x in pairs])


class ChunkCodec:
    """Encodes and decodes texts; what it has seen of words, joins and chunks is reused.

    A result is a pair of bytes: the decimal ids and the decoded tokens, each
    followed by a space. Memory is bounded: a full table is emptied.
    """

    def __init__(self, path: str, mean_bytes: int = 512, max_words: int = 400_000, max_chunk_bytes: int = 64_000_000):
        self.encode_words, self.tokens = load_words(path)
        self.mean_bytes, self.max_words, self.max_chunk_bytes = mean_bytes, max_words, max_chunk_bytes
        self.words: dict[bytes, Pair] = {}
        self.chunks: dict[bytes, Chunk] = {}
        self.chunk_bytes = self.chunks_encoded = self.chunks_met = self.joins_grown = 0

    def learn(self, words: set[bytes]) -> None:
        """Encode words, or stretches of words around a join, that are not known yet."""
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > self.max_words:
            self.words.clear()
            new = list(words)
        for w, ids in zip(new, self.encode_words(new), strict=True):
            found = [self.tokens[i] for i in ids]
            self.words[w] = (b"".join([x[0] for x in found]), b"".join([x[1] for x in found]))

    def cut(self, text: bytes) -> tuple[list[bytes], list[bool]]:
        """(chunks, whether the cut after each goes through a word); chunks of less than two words are part of the one before or after."""
        ends = chunk_ends(np.frombuffer(text, np.uint8), self.mean_bytes).tolist()
        chunks, begin, at = [], 0, 0
        word = gap = False  # whether the chunk so far holds a word, and ends after it with a break
        for end in ends:
            while end < len(text) and text[end] & 0xC0 == 0x80:  # not inside a character
                end += 1
            part = text[at:end]
            n, at = len(part.split(None, 2)), max(at, end)
            if n > 1 or (n == 1 and word and (gap or part[0] in BREAKS)):
                chunks.append(text[begin:at])
                begin, word, gap = at, False, False
            elif n == 1:
                word, gap = True, part[-1] in BREAKS
            elif part:
                gap = word
        if begin < len(text):
            rest = text[begin:]
            chunks = [*chunks[:-1], chunks[-1] + rest] if chunks else [rest]
        return chunks, [a[-1] not in BREAKS and b[0] not in BREAKS for a, b in zip(chunks, chunks[1:], strict=False)]

    @staticmethod
    def stretch(left: Chunk, right: Chunk, through: bool, n: int) -> bytes:
        """The text around a join: the last `n` + 1 words of the left chunk and the first `n` + 1 of the right one."""
        a, b = left.words[-n - 1 :], right.words[: n + 1]
        middle = [a[-1] + b[0]] if through else [a[-1], b[0]]
        return b" ".join([*a[:-1], *middle, *b[1:]])

    def repaired(self, left: Chunk, right: Chunk, through: bool) -> Pair:
        """What stands for the two words at a join: the stretch around it is encoded again, and grows until it begins as the left chunk goes on and ends as the right one does."""
        n = 1
        while True:
            text = self.stretch(left, right, through, n)
            if text not in self.words:
                self.learn({text})
            ids, tokens = self.words[text]
            before, after = left.words[-n - 1 : -1], right.words[1 : n + 1]
            if any(w not in self.words for w in (*before, *after)):
                self.learn({text, *before, *after})
            (i, t), (j, u) = joined([self.words[w] for w in before]), joined([self.words[w] for w in after])
            if ids.startswith(i) and ids.endswith(j) and len(ids) >= len(i) + len(j):
                return ids[len(i) : len(ids) - len(j)], tokens[len(t) : len(tokens) - len(u)]
            if n >= max(len(left.words), len(right.words)):
                raise ValueError("chunks do not agree with what is encoded around their join")
            self.joins_grown += 1
            n *= 2

    def encode_batch(self, texts: list[bytes]) -> list[Pair]:
        """(ids, tokens) of each text; equal chunks of all texts are encoded once."""
        cuts = [self.cut(text) for text in texts]
        keys = [[hashlib.blake2b(c, digest_size=16).digest() for c in chunks] for chunks, _ in cuts]
        todo: dict[bytes, list[bytes]] = {}
        for (chunks, _), own in zip(cuts, keys, strict=True):
            for chunk, key in zip(chunks, own, strict=True):
                if key not in self.chunks and key not in todo:
                    todo[key] = chunk.split()
            self.chunks_met += len(own)
        words = {w for ws in todo.values() for w in ws}
        if not words <= self.words.keys():
            self.learn(words)
        for key, ws in todo.items():
            if ws:
                self.chunks[key] = chunk = Chunk(ws, self.words)
                self.chunk_bytes += sum(map(len, ws)) + 34 * len(ws) + len(chunk.body[0]) + len(chunk.body[1]) + 400
        self.chunks_encoded += len(todo)
        found = [[self.chunks[k] for k in own if k in self.chunks] for own in keys]
        around = {self.stretch(a, b, through, 1) for own, (_, throughs) in zip(found, cuts, strict=True) for a, b, through in zip(own, own[1:], throughs, strict=False)}
        if not around <= self.words.keys():
            self.learn(around)
        done = []
        for own, (_, throughs) in zip(found, cuts, strict=True):
            if not own:
                done.append((b"", b""))
                continue
            parts = [own[0].first]
            for left, right, through in zip(own, own[1:], throughs, strict=False):
                parts += [left.body, self.repaired(left, right, through)]
            parts += [own[-1].body, own[-1].last] if len(own) > 1 or len(own[0].words) > 1 else []
            ids, tokens = joined(parts)
            done.append((ids[:-1], tokens[:-1]))
        if self.chunk_bytes > self.max_chunk_bytes:
            self.chunks.clear()
            self.chunk_bytes = 0
        return done


def slices(column: pa.Array, most_bytes: int) -> Iterator[pa.Array]:
    """Runs of rows of about `most_bytes` of text."""
    begin = size = 0
    for i, t in enumerate(column):
        size += len(t.as_buffer()) if t.is_valid else 0
        if size >= most_bytes:
            yield column[begin : i + 1]
            begin, size = i + 1, 0
    if begin < len(column):
        yield column[begin:]


def encode_decode(docs: DataFrame, tokenizer_path: str, mean_bytes: int = 512, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows (key, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]), one a document.

    Ids are those of the tokenizer without special tokens added, decoded text is
    that of its decode() with special tokens kept. A null text counts as empty:
    no ids, decoded ''. Texts are encoded whole, repeated rows each on its own.
    """
    fields = [(key, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if with_ids else []
    out = pa.schema([pa.field(*f) for f in fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ChunkCodec(tokenizer_path, mean_bytes)
        for batch in batches:
            at = 0
            for part in slices(batch[1], 4_000_000):
                done = codec.encode_batch([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part])
                columns = [
                    batch[0].slice(at, len(part)),
                    pa.array([i.count(b" ") + 1 if i else 0 for i, _ in done], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i, _ in done]),
                    pa.array([hashlib.sha256(t).hexdigest() for _, t in done]),
                ]
                if with_ids:
                    columns += [pa.array([list(map(int, i.split())) for i, _ in done], pa.list_(pa.int32())), pa.array([t.decode() for _, t in done])]
                at += len(part)
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    extra = ", ids array<int>, decoded string" if with_ids else ""
    return docs.select(F.col(key).cast("long").alias(key), F.col(text)).mapInArrow(work, f"`{key}` long, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
