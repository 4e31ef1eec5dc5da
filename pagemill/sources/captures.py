"""Captured HTTP exchanges as a Spark data source, ``format("captures")``: scan, stream and sink.

A capture file is a Zstandard stream of exchanges, each a request line with the address asked for, the response's status line,
its headers and a body of ``Content-Length`` bytes. Tasks write files of bounded size; the driver's commit lists them in a
manifest, with the range of hosts and times of each, and only listed files are read: a failed or repeated task leaves nothing
behind that counts. Manifests are numbered, which gives a stream its offsets. Bounds of hosts and times leave out whole files.

Paths are those of ``pyarrow.fs`` (``file://``, ``hdfs://``, ``s3://``, ``gs://``).
"""

from __future__ import annotations

import datetime as dt
import io
import json
import re
import uuid
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from pagemill.functions.urls import host

SCHEMA = "host string, url string, final_url string, fetched_at timestamp, status_code int, content_type string, html string, error string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Statuses that count as a refusal, with the text of the error.
REFUSED = {403, 503}
DENIED = "Access denied (HTTP {})"
#: Bytes of bodies in a file, and rows of an Arrow batch when reading; bytes of bodies of such a batch.
FILE_BYTES, BATCH_ROWS, BATCH_BYTES = 64 << 20, 1024, 16 << 20
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Written(NamedTuple):
    """What a task wrote: path, rows, bytes, least and greatest host, least and greatest time in microseconds (null times: none)."""

    path: str
    rows: int
    bytes: int
    hosts: tuple[str, str]
    times: tuple[int, int] | None


class _Message(WriterCommitMessage):
    def __init__(self, files: list[dict]):
        self.files = files


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


# ---------------------------------------------------------------- exchanges


def _line(x: str) -> str:
    """A header's value on one line: what would break it is escaped."""
    return re.sub(r"[%\r\n]", lambda m: f"%{ord(m[0]):02X}", x)


def _unline(x: str) -> str:
    return re.sub(r"%(25|0D|0A)", lambda m: chr(int(m[1], 16)), x)


def write_exchange(out, url: str | None, final_url: str | None, fetched: int | None, status: int | None, content_type: str | None, html: str | None) -> int:
    """Append an exchange; returns the bytes of its body. Nulls are told apart from empty values."""
    body = (html or "").encode("utf-8", "surrogatepass")
    head = [f"GET {_line(url)} HTTP/1.1" if url is not None else "GET HTTP/1.1", f"HTTP/1.1 {status if status is not None else '-'}"]
    if final_url is not None:
        head.append(f"Content-Location: {_line(final_url)}")
    if fetched is not None:
        head.append(f"Date-Micros: {fetched}")
    if content_type is not None:
        head.append(f"Content-Type: {_line(content_type)}")
    if html is not None:
        head.append("Body: yes")
    head.append(f"Content-Length: {len(body)}")
    out.write(("\r\n".join(head) + "\r\n\r\n").encode())
    out.write(body)
    return len(body)


def _charset(content_type: str | None) -> str:
    found = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type or "", re.I)
    return found[1] if found else "utf-8"


def read_exchanges(raw) -> Iterator[tuple]:
    """url, final url, microseconds, status, content type and text of each exchange; a file that is cut off raises ValueError.

    Bodies are decoded by the charset of their type, UTF-8 where it names none that is known; bytes that do not fit are replaced.
    """
    stream = io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True), 1 << 16)
    while request := stream.readline():
        asked = re.fullmatch(r"GET (?:(.*) )?HTTP/1\.1", request.decode().rstrip("\r\n"))
        answer = re.fullmatch(r"HTTP/1\.1 (-|\d+)", stream.readline().decode().rstrip("\r\n"))
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name.lower()] = value
        if not asked or not answer or "content-length" not in headers:
            raise ValueError("no HTTP exchange where one should begin")
        size = int(headers["content-length"])
        body = stream.read(size)
        if len(body) != size:
            raise ValueError(f"a body of {size} bytes ends after {len(body)}")
        kind = headers.get("content-type")
        kind = _unline(kind) if kind is not None else None
        try:
            text = body.decode(_charset(kind), "replace" if _charset(kind).lower() not in ("utf-8", "utf8") else "surrogatepass")
        except (LookupError, UnicodeDecodeError):
            text = body.decode("utf-8", "replace")
        micros, final = headers.get("date-micros"), headers.get("content-location")
        yield (
            _unline(asked[1]) if asked[1] is not None else None,
            _unline(final) if final is not None else None,
            int(micros) if micros is not None else None,
            None if answer[1] == "-" else int(answer[1]),
            kind,
            text if "body" in headers else None,
        )


def host_of(url: str | None) -> str:
    """As ``functions.urls.host``."""
    found = re.match(r"[a-z][a-z0-9+.-]*://([^/?#]*)", (url or "").lower())
    return re.sub(r"^www\.", "", found[1]) if found else ""


# ---------------------------------------------------------------- manifests


def _manifests(path: str) -> list[int]:
    store, root = _open(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/_manifests", allow_not_found=True))
    return sorted(int(f.base_name[:-5]) for f in found if re.fullmatch(r"\d{12}\.json", f.base_name))


def _listed(path: str, numbers: Sequence[int]) -> list[_Written]:
    store, root = _open(path)
    out = []
    for n in numbers:
        with store.open_input_stream(f"{root}/_manifests/{n:012d}.json", compression=None) as f:
            out += [_Written(x["path"], x["rows"], x["bytes"], tuple(x["hosts"]), tuple(x["times"]) if x["times"] else None) for x in map(json.loads, f.read().decode().splitlines())]
    return out


class _Bounds:
    """Which files may hold rows of the hosts and times that are asked for."""

    def __init__(self, options: dict) -> None:
        hosts, since, until = (options.get(k) for k in ("hosts", "since", "until"))
        self.hosts = set(json.loads(hosts)) if hosts is not None else None
        self.low, self.high = (int(x) if x is not None else None for x in (since, until))

    def may_hold(self, x: _Written) -> bool:
        if self.hosts is not None and not any(x.hosts[0] <= h <= x.hosts[1] for h in self.hosts):
            return False
        if self.low is None and self.high is None:
            return True
        return x.times is not None and (self.low is None or x.times[1] >= self.low) and (self.high is None or x.times[0] < self.high)


def _micros(t: dt.datetime) -> int:
    """Microseconds since 1970; a time without zone is in UTC."""
    t = t.replace(tzinfo=dt.timezone.utc) if t.tzinfo is None else t
    return (t - _EPOCH) // dt.timedelta(microseconds=1)


# ---------------------------------------------------------------- reading


def _batches(path: str, file: str) -> Iterator[pa.RecordBatch]:
    store, root = _open(path)
    rows: list[tuple] = []
    size = 0
    kinds = [pa.string(), pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.int32(), pa.string(), pa.string(), pa.string()]

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], COLUMNS)

    with store.open_input_stream(f"{root}/{file}", compression=None) as raw:
        for url, final, micros, status, kind, text in read_exchanges(raw):
            error = DENIED.format(status) if status in REFUSED else None
            rows.append((host_of(url), url, final, micros, status, kind, text, error))
            size += len(text or "")
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield batch()
                rows, size = [], 0
    if rows:
        yield batch()


class _Reader(DataSourceReader):
    def __init__(self, path: str, bounds: _Bounds):
        self.path, self.bounds = path, bounds

    def partitions(self) -> Sequence[InputPartition]:
        return [_File(x.path) for x in _listed(self.path, _manifests(self.path)) if self.bounds.may_hold(x)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is not None and partition.value:
            yield from _batches(self.path, partition.value)


class _Stream(DataSourceStreamReader):
    """Offsets are numbers of manifests; a batch is what lies between two of them."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"after": -1}

    def latestOffset(self) -> dict:
        return {"after": max(_manifests(self.path), default=-1)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        between = [n for n in _manifests(self.path) if start["after"] < n <= end["after"]]
        return [_File(x.path) for x in _listed(self.path, between)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from _batches(self.path, partition.value)

    def commit(self, end: dict) -> None:
        pass


# ---------------------------------------------------------------- writing


class _Writer(DataSourceArrowWriter):
    """Each task writes files of at most ``FILE_BYTES`` (one row at least); the commit lists them in the next manifest."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _open(self.path)
        store.create_dir(f"{root}/data")
        files: list[dict] = []
        out = raw = None

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()  # ends the Zstandard frame and the file below it
                out = None

        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() if c in batch.schema.names else [None] * batch.num_rows for c in COLUMNS[1:-1] if c != "fetched_at"]
            place = batch.schema.get_field_index("fetched_at")
            times = batch.column(place).cast(pa.timestamp("us", batch.schema.field(place).type.tz)).cast(pa.int64()).to_pylist() if place >= 0 else [None] * batch.num_rows
            for (url, final, status, kind, html), at in zip(zip(*columns, strict=True), times, strict=True):
                if out is None:
                    name = f"data/{uuid.uuid4().hex}.http.zst"
                    raw = store.open_output_stream(f"{root}/{name}", compression=None)
                    out = zstandard.ZstdCompressor(level=3).stream_writer(raw)
                    files.append({"path": name, "rows": 0, "bytes": 0, "hosts": None, "times": None})
                own, site = files[-1], host_of(url)
                own["bytes"] += write_exchange(out, url, final, at, status, kind, html)
                own["rows"] += 1
                own["hosts"] = [min(own["hosts"][0], site), max(own["hosts"][1], site)] if own["hosts"] else [site, site]
                if at is not None:
                    own["times"] = [min(own["times"][0], at), max(own["times"][1], at)] if own["times"] else [at, at]
                if own["bytes"] >= FILE_BYTES:
                    close()
        close()
        return _Message(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _open(self.path)
        had = _manifests(self.path)
        store.create_dir(f"{root}/_manifests")
        lines = [json.dumps(f) for m in messages if m is not None for f in m.files]
        number = max(had, default=-1) + 1
        name = f"{root}/_manifests/{number:012d}.json"
        with store.open_output_stream(f"{name}.part", compression=None) as f:
            f.write("\n".join(lines).encode())
        store.move(f"{name}.part", name)
        if self.overwrite:
            for n in had:
                store.delete_file(f"{root}/_manifests/{n:012d}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _open(self.path)
        for m in messages:
            for f in m.files if m is not None else []:
                store.delete_file(f"{root}/{f['path']}")


class Captures(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], _Bounds(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("captures")`` known to the session."""
    spark.dataSource.register(Captures)


def read_captures(spark: SparkSession, path: str, hosts: Sequence[str] | None = None, since: dt.datetime | None = None, until: dt.datetime | None = None) -> DataFrame:
    """All captures, or those of some hosts or of times from ``since`` on and before ``until``; files that hold none of these are not opened.

    Bounds are options of the source and not filters pushed down to it: Spark 4.1 keeps what a pushed filter left of a Python source
    for later queries on the same DataFrame, which then lack rows.
    """
    register(spark)
    source, kept = spark.read.format("captures").option("path", path), F.lit(True)
    if hosts is not None:
        source, kept = source.option("hosts", json.dumps(list(hosts))), kept & F.col("host").isin(*hosts)
    for name, at in (("since", since), ("until", until)):
        if at is not None:
            source, limit = source.option(name, str(_micros(at))), F.timestamp_micros(F.lit(_micros(at)))
            kept = kept & ((F.col("fetched_at") >= limit) if name == "since" else (F.col("fetched_at") < limit))
    return source.load().filter(kept)


def write_captures(pages: DataFrame, path: str, files: int | None = None, mode: str = "append") -> None:
    """Write pages (``url`` and any of the other columns but ``host`` and ``error``) as captures, hosts near each other so that files can be left out by them.

    A host with many pages is dealt over several files by its addresses. Columns of other names are not kept; a null text stays null; an empty table makes an empty manifest.
    """
    register(pages.sparkSession)
    kinds = dict(x.split() for x in SCHEMA.split(", "))
    have = [F.col(c).cast(t).alias(c) if c in pages.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items() if c not in ("host", "error")]
    rows = pages.select(F.coalesce(host(F.col("url")), F.lit("")).alias("host"), *have, F.lit(None).cast("string").alias("error"))
    order = ["host", F.xxhash64("url", "html")]
    dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    dealt.sortWithinPartitions("host").write.format("captures").option("path", path).mode(mode).save()
