"""WARC archives compressed with Zstandard: a writer by Spark's text sink and a reader.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the compression dictionary;
each record is a frame of its own. Spark's writer puts the frames one after another, with an empty
skippable frame between them, so archives are committed like any other output and land on whatever
file system the path names.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.shared import shared_path, staged

DICTIONARY_MAGIC = 0x184D2A5D
#: An empty skippable frame, which readers pass over.
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0)
FRAME_MAGIC = 0xFD2FB528
#: A dictionary is made from at most so many first records of an archive, and bytes of each.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 96, 16_384, 32_768
#: Records of an archive, and their bytes before compression (one record at least); a task with more writes several. A reader holds an archive whole.
RECORDS_PER_ARCHIVE, ARCHIVE_BYTES = 4096, 128 << 20
#: Payloads from this size on are stored once.
REVISIT_BYTES = 100
#: Digests of repeated payloads that are broadcast at most, at 80 bytes each.
BROADCAST_DIGESTS = 250_000
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"


def record_bytes(page_id, uri: str | None, payload: bytes, digest: str, length: int, refers_to, date: str) -> bytes:
    """A response record, or a revisit record (headers only) if ``refers_to`` is set."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID_PREFIX}{page_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in uri))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def make_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the samples' own beginnings where there are too few to train on."""
    cut = [s[:SAMPLE_BYTES] for s in samples]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, cut, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(cut)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"


def parse_record(raw: bytes) -> dict:
    """Header fields and block of a record; ValueError where a header or length is wrong."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"header line without a colon: {line[:60]!r}")
        fields[name.strip().lower().decode()] = value.strip().decode()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name} header")
    if len(rest) != int(fields["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("block length differs from Content-Length")
    return fields | {"block": rest[:-4]}


def payload_of(record: dict) -> tuple[bytes | None, int, str]:
    """Payload (None for a revisit), its full length and digest; ValueError where they do not agree."""
    http, gap, body = record["block"].partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no HTTP header")
    length = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    digest = record.get("warc-payload-digest", "").removeprefix("sha256:")
    if record["warc-type"] == "revisit":
        if body or length is None:
            raise ValueError("a revisit record has no body but its length")
        return None, length, digest
    if length != len(body) or hashlib.sha256(body).hexdigest() != digest:
        raise ValueError("payload differs from its length or digest")
    return body, length, digest


def frames(data: memoryview) -> Iterator[tuple[int, memoryview]]:
    """(magic, frame) of each frame; for a skippable one its content."""
    at = 0
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError("frame cut off")
        (magic,) = struct.unpack_from("<I", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            (size,) = struct.unpack_from("<I", data, at + 4)
            if at + 8 + size > len(data):
                raise ValueError("skippable frame cut off")
            yield magic, data[at + 8 : at + 8 + size]
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError("no Zstandard frame")
        end = at + zstandard.frame_header_size(data[at : at + 18])
        while True:
            if end + 3 > len(data):
                raise ValueError("block cut off")
            head = int.from_bytes(data[end : end + 3], "little")
            end += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
            if head & 1:
                break
        end += 4 * zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
        if end > len(data):
            raise ValueError("frame cut off")
        yield magic, data[at:end]
        at = end


def read_archive(data: bytes) -> Iterator[dict]:
    """Records of an archive in order."""
    decoder = zstandard.ZstdDecompressor()
    for k, (magic, frame) in enumerate(frames(memoryview(data))):
        if magic == DICTIONARY_MAGIC and k == 0:
            raw = bytes(frame)
            if raw[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may be compressed itself
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        elif magic == FRAME_MAGIC:
            yield parse_record(decoder.decompress(frame))


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", uri: str = "url", text: str = "html", date: str = "1970-01-01T00:00:00Z", most: int = RECORDS_PER_ARCHIVE, most_bytes: int = ARCHIVE_BYTES
) -> None:
    """Write a record per row to archives in folder ``path``, with up to ``most`` records each, and ``most_bytes`` or a single record; an empty table gives none.

    Payloads are whole texts of any length in UTF-8; null counts as empty. Columns are named, so others may have any names. Of rows with equal payloads of at least
    ``REVISIT_BYTES`` the one with the smallest id is a response and the others revisit it (a row
    repeated under that id is a response again). Other columns are not looked at.

    Only digests that repeat meet the pages again: broadcast if there are at most
    ``BROADCAST_DIGESTS``, else by a shuffled join, in which Spark splits large groups of copies.
    """
    filled = F.coalesce(F.col(text), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(uri).cast("string").alias("uri"), filled.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("length", F.octet_length("html"))
    copies = rows.filter(F.col("length") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    copies = staged(copies.filter("n > 1").drop("n"), "copies")
    if copies.count() <= BROADCAST_DIGESTS:
        copies = F.broadcast(copies)
    refers = F.when(F.col("first") != F.col("page_id"), F.col("first"))
    rows = rows.join(copies, "digest", "left").select("page_id", "uri", "html", "digest", "length", refers.alias("refers_to"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[bytes] = []
        coder, head, written, size = None, b"", 0, 0

        def coded(raws: list[bytes]) -> pa.RecordBatch:
            """Frames of records, with the dictionary before each archive's first, where Spark begins a new file."""
            nonlocal written, size
            out = []
            for raw in raws:
                if written % most and size + len(raw) > most_bytes:
                    # empty rows, which become empty frames, up to where Spark begins a new file
                    left = most - written % most
                    out += [b""] * left
                    written += left
                if not written % most:
                    out.append(head)
                    size = 0
                size += len(raw)
                out.append(coder.compress(raw))
                written += 1
            return pa.record_batch([pa.array(out, pa.binary())], ["frame"])

        def begin() -> None:
            nonlocal coder, head
            dictionary = make_dictionary(pending)
            coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
            head = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                for r in batch.slice(lo, 64).to_pylist():
                    payload = r["html"].encode() if r["refers_to"] is None else b""
                    pending.append(record_bytes(r["page_id"], r["uri"], payload, r["digest"], r["length"], r["refers_to"], date))
                if not coder and len(pending) >= SAMPLE_RECORDS:
                    begin()
                if coder:
                    yield coded(pending)
                    pending = []
        if pending:
            begin()
            yield coded(pending)

    made = rows.mapInArrow(archive, "frame binary").select(F.col("frame").cast("string").alias("value"))
    made.write.option("lineSep", EMPTY_FRAME.decode("ascii")).option("maxRecordsPerFile", most + 1).text(path)


RECORDS = "record_type string, page_id long, uri string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record of the archives in ``path``; a task fails where headers, lengths or digests are wrong.

    Null ids and addresses come back as null, repeated rows as often as they were written, null texts as empty payloads; without archives there are no rows.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        number = lambda x: int(x.strip("<>").removeprefix(ID_PREFIX)) if x and not x.endswith("None>") else None

        def emit(rows):
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for record in read_archive(content.as_py()):
                    payload, length, digest = payload_of(record)
                    kept = payload if with_payload else None
                    rows.append((record["warc-type"], number(record["warc-record-id"]), record.get("warc-target-uri"), number(record.get("warc-refers-to")), length, digest, kept))
                    size += len(kept or b"")
                    if len(rows) >= 4096 or size > 1 << 23:
                        yield emit(rows)
                        rows, size = [], 0
                if rows:
                    yield emit(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0").select("content")
    return files.mapInArrow(records, RECORDS)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    path = shared_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
