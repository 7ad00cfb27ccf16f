"""Dictionary-compressed WARC archives.

Each archive begins with a skippable frame that holds a Zstandard dictionary
built from records of that archive; every record follows as a frame of its own,
compressed with the dictionary, so that any record can be read alone. Responses
are written first; revisits follow in archives of their own, as they name the
record that they refer to.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.store import materialise, new_path

#: Fixed values of the file format: magic number of the skippable frame with a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Gives the file system of a URI and the path in it; for stores that `pyarrow` does not know, pass one that does.
Opener = Callable[[str], tuple[fs.FileSystem, str]]

ROLES = "page_id long, url string, payload binary, payload_digest string, payload_bytes long, refers_to long, referred boolean"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def plan_records(pages: DataFrame, min_revisit_bytes: int = 1000, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows of ROLES: what each page's record holds; refers_to is set for revisits, referred for responses that revisits may name.

    Of pages with equal payloads of at least `min_revisit_bytes` the largest id
    is the response. Null html is an empty payload; a null id is below all
    others; rows that repeat the response's id are responses too. The digests'
    largest ids are summed up before the shuffle, and Spark splits the join on a
    digest that very many pages share.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    shared = rows.filter(F.col("payload_bytes") >= min_revisit_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    shared = materialise(shared.filter("n > 1").select(F.col("payload_digest").alias("digest"), "keeper"), "shared-payloads")
    joined = rows.join(shared, F.col("payload_digest") == F.col("digest"), "left")
    refers = F.when(F.col("keeper").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("keeper"))), F.col("keeper"))
    revisit = refers.isNotNull()
    referred = F.coalesce(F.col("page_id") == F.col("keeper"), F.lit(False))
    return joined.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_digest", "payload_bytes", refers.alias("refers_to"), referred.alias("referred"))


def new_record_id(page_id: int | None) -> str:
    """An id that no other record has, also of the same page; it tells the page."""
    return f"<urn:page:{'' if page_id is None else page_id}:{uuid.uuid4()}>"


def page_of(record: str) -> int | None:
    number = record.split(":")[2]
    return int(number) if number else None


def to_record(row: dict, record_id: str, date: str) -> bytes:
    """One WARC record: response with the payload, or revisit without it that names the record `refers_to`."""
    digest = "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    fields = {"WARC-Type": "response", "WARC-Record-ID": record_id, "WARC-Date": date, "WARC-Payload-Digest": digest}
    if row["url"] is not None:
        fields["WARC-Target-URI"] = row["url"].replace("\r", "%0D").replace("\n", "%0A")
    if row["refers_to"] is not None:
        fields |= {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": row["refers_to"]}
    block = head + (row["payload"] or b"")
    fields |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields.items()), b"", block, b"", b""]
    return b"\r\n".join(lines)


def headers(block: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in block.decode().split("\r\n")[1:] if ": " in line)


def from_record(record: bytes) -> dict:
    """What a record says; a response's payload is digested again and has to agree."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = headers(head)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size = int(headers(http)["Content-Length"])
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    refers = fields.get("WARC-Refers-To")
    return {"page_id": page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": refers and page_of(refers)}


#: Bytes of a training sample; the trainer takes no longer ones.
PIECE = 65536


def build_dictionary(records: list[bytes], dictionary_bytes: int, sample_bytes: int):
    """A dictionary from whole records spread evenly over the archive, about `sample_bytes` of them, long ones in pieces; raw content where there is too little to train on."""
    import zstandard

    step = max(1, round(sum(map(len, records)) / sample_bytes))
    samples = [r[i : i + PIECE] for r in records[::step] for i in range(0, len(r), PIECE)]
    try:
        return zstandard.train_dictionary(dictionary_bytes, samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-dictionary_bytes:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_bytes(records: list[bytes], level: int, dictionary_bytes: int, sample_bytes: int) -> bytes:
    import zstandard

    dictionary = build_dictionary(records, dictionary_bytes, sample_bytes)
    packer = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True)
    raw = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes())
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(raw)), raw, *map(packer.compress, records)])


def read_archive(file) -> Iterator[bytes]:
    """The records of an archive, one at a time, from a file object."""
    import zstandard

    magic, size = struct.unpack("<II", file.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    content = zstandard.ZstdDecompressor().decompress(file.read(size))
    trained = content[:4] == b"\x37\xa4\x30\xec"
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    unpacker, data, at = zstandard.ZstdDecompressor(dict_data=dictionary), memoryview(file.read()), 0
    while at < len(data):
        one = unpacker.decompressobj()
        record = one.decompress(data[at : at + 65536])
        end = at + 65536
        while not one.eof:
            record += one.decompress(data[end : end + 1_048_576])
            end += 1_048_576
        at = min(end, len(data)) - len(one.unused_data)
        yield record


#: What a list of archives tells of each; `referred` holds the records in it that revisits may name.
ARCHIVES = "path string, n_records long, bytes long, referred array<struct<payload_digest: string, record_id: string>>"
REFERRED = pa.list_(pa.struct([("payload_digest", pa.string()), ("record_id", pa.string())]))


def store_records(records: DataFrame, folder: str, archive_mb: float, level: int, dictionary_bytes: int, sample_bytes: int, date: str, opener: Opener) -> DataFrame:
    """Write the records of one task after the other into archives; rows of ARCHIVES, written before they are returned."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stored(held: list[bytes], referred: list[dict]) -> pa.RecordBatch:
            system, path = opener(folder)
            system.create_dir(path, recursive=True)
            name = f"{uuid.uuid4().hex}.warc.zst"
            content = archive_bytes(held, level, dictionary_bytes, sample_bytes)
            with system.open_output_stream(f"{path}/{name}", compression=None) as out:
                out.write(content)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": pa.array([len(held)], pa.int64()), "bytes": pa.array([len(content)], pa.int64()), "referred": pa.array([referred], REFERRED)})

        held, referred, size = [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                record_id = new_record_id(row["page_id"])
                held.append(to_record(row, record_id, date))
                if row["referred"]:
                    referred.append({"payload_digest": row["payload_digest"], "record_id": record_id})
                size += len(held[-1])
                if size >= archive_mb * 1_000_000:
                    yield stored(held, referred)
                    held, referred, size = [], [], 0
        if held:
            yield stored(held, referred)

    return materialise(records.mapInArrow(work, ARCHIVES), "archives")


def write_archives(
    records: DataFrame, folder: str, archive_mb: float = 16, level: int = 6, dictionary_bytes: int = 65536, sample_bytes: int = 2_000_000, date: str = "2024-01-01T00:00:00Z", opener: Opener = fs.FileSystem.from_uri
) -> DataFrame:
    """Write rows of ROLES as archives of at most about `archive_mb` of records each; return their list, rows of ARCHIVES.

    Every record has an id of its own, also where page ids repeat or are null,
    so a revisit can only be written when the record that it refers to has got
    its id: the list of the responses' archives is written first and tells them.
    Of several responses with the payload and id of a page, revisits name the one
    of the smallest record id. A task that runs again writes other files with
    other ids, and only those of the attempt that counted are in the list, so a
    lost executor leaves nothing behind that would be read or referred to. An
    empty table gives an empty list. `opener` runs in the tasks.
    """
    options = (folder, archive_mb, level, dictionary_bytes, sample_bytes, date, opener)
    responses = store_records(records.filter("refers_to is null").withColumn("refers_to", F.lit(None).cast("string")), *options)
    named = responses.select(F.explode("referred").alias("r")).groupBy(F.col("r.payload_digest").alias("digest")).agg(F.min("r.record_id").alias("record_id"))
    later = records.filter("refers_to is not null").drop("payload").join(named, F.col("payload_digest") == F.col("digest"))
    later = later.select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "payload_digest", "payload_bytes", F.col("record_id").alias("refers_to"), "referred")
    return responses.unionByName(store_records(later, *options))


def read_archives(archives: DataFrame, opener: Opener = fs.FileSystem.from_uri) -> DataFrame:
    """Rows of RECORDS from the archives listed in `archives`, one archive at a time in a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch["path"].to_pylist():
                system, path = opener(uri)
                with system.open_input_stream(path, compression=None) as file:
                    rows = [from_record(r) for r in read_archive(io.BytesIO(file.read()))]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    n = max(1, archives.sparkSession.sparkContext.defaultParallelism)
    return archives.select("path").repartition(n * 4, "path").mapInArrow(work, RECORDS)


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Write the pages into archives in the shared folder; return the list of archives."""
    return write_archives(plan_records(pages), new_path(pages.sparkSession, "warc"), **options)
