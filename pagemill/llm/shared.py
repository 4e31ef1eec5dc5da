"""Shared storage and vectorised text kernels used by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------- shared storage

#: What lies in the shared folder: session, label and path.
_staged: list[tuple[SparkSession, str, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where a local session names none (as in tests) a temporary folder is set as its checkpoint folder;
    a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local-cluster")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pagemill-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there is deleted when Python ends, or by ``drop_staged``."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _staged.append((spark, label, path))
    return path


def staged(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back, which cuts its lineage.

    A lost executor then costs at most the tasks it ran, not the jobs before them.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def staged_so_far() -> int:
    return len(_staged)


def drop_staged(since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete what was put into the shared folder after the first ``since`` tables, but those with a label in ``keep``.

    Nothing that is still to be read may hang on what is deleted.
    """
    kept = _staged[:since] + [x for x in _staged[since:] if x[1] in keep]
    gone = [x for x in _staged[since:] if x[1] not in keep]
    _staged[:] = kept
    for spark, _, path in gone:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may have ended; the folder is then left to its owner
            return


atexit.register(drop_staged)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    while name in df.columns:
        name = "_" + name
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator is about to add under these names."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in names))


def pressed(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the texts as Zstandard frames of their UTF-8 bytes, for shuffles; null stays null."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == text else f for f in df.schema.fields])

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            k = batch.schema.get_field_index(text)
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                frames = pa.array([coder.compress(x.as_buffer()) if x.is_valid else None for x in part.column(k)], pa.binary())
                yield pa.record_batch([frames if i == k else c for i, c in enumerate(part.columns)], schema.names)

    return df.mapInArrow(press, schema)


def unpressed(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts from ``pressed``; null counts as empty."""
    coder = zstandard.ZstdDecompressor()
    texts = [coder.decompress(x.as_buffer()) if x.is_valid else b"" for x in column]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)])


# ---------------------------------------------------------------- text kernels

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_K1, _K2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)

#: Bytes that belong to words. SPACED: all but blank, tab to carriage return. ALNUM: digits, Latin letters, non-ASCII.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Folding of bytes: LOWER takes A-Z to a-z.
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 32

SLICE_BYTES = 4 << 20
BLOCK_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that any of their bits can be used."""
    x = (x ^ (x >> np.uint64(30))) * _K1
    x = (x ^ (x >> np.uint64(27))) * _K2
    return x ^ (x >> np.uint64(31))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of ordered pairs of hashes."""
    x = a * _K2 + b
    x = (x ^ (x >> np.uint64(29))) * _K1
    return x ^ (x >> np.uint64(32))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, without a copy of its texts where none is null; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offs = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def row_slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together (one row at least)."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """Words of consecutive texts: hash, first and last byte of each; ``offs`` has the first word of each text."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, letters: np.ndarray, fold: np.ndarray):
        hashes, starts, ends = [], [], []
        lo, end = int(offs[0]), int(offs[-1])
        first = np.zeros(end - lo + 1, bool)
        first[offs[:-1] - lo] = True
        base = lo
        while lo < end:
            hi = min(lo + BLOCK_BYTES, end)
            if hi < end and not first[hi - base]:  # cut between words
                gaps = np.flatnonzero(~letters[buf[lo:hi]])
                if len(gaps):
                    hi = lo + int(gaps[-1]) + 1
                else:
                    while hi < end and letters[buf[hi]] and not first[hi - base]:
                        hi += 1
            h, s, e = _block(buf[lo:hi], first[lo - base : hi - base], letters, fold)
            hashes.append(h)
            starts.append(s + lo)
            ends.append(e + lo)
            lo = hi
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.hash, self.start, self.end = join(hashes, np.uint64), join(starts, np.int64), join(ends, np.int64)
        self.offs = np.searchsorted(self.start, offs, side="left")
        self.count = np.diff(self.offs)
        self.row = np.repeat(np.arange(len(offs) - 1), self.count)
        #: words from this one to the end of its text
        self.left = self.offs[1:][self.row] - np.arange(len(self.hash)) if len(self.hash) else np.zeros(0, np.int64)

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; wrong where fewer are left in the text."""
        size, have, out, done = 1, self.hash, None, 0
        while True:
            if n & size:
                part = _shift(have, done)
                out = part if out is None else combine(out, part)
                done += size
            size *= 2
            if size > n:
                return out
            have = combine(have, _shift(have, size // 2))


def _shift(x: np.ndarray, n: int) -> np.ndarray:
    if not n:
        return x
    out = np.zeros_like(x)
    out[: len(x) - n] = x[n:]
    return out


_tables: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """The multiplier's powers and their inverses, n of each."""
    if not _tables or len(_tables[0]) < n:
        _tables.clear()
        for base in (_MULT, _INV):
            table = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
            table[0] = 1
            _tables.append(np.cumprod(table))
    return [x[:n] for x in _tables]


def _block(raw: np.ndarray, first: np.ndarray, letters: np.ndarray, fold: np.ndarray):
    inside = letters[raw]
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    before &= ~first
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros_like(inside)
    after[:-1] = inside[1:] & ~first[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    powers, back = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_CODES[fold[raw]] * powers[:-1], out=sums[1:])
    # the start's power is divided out, so that equal words hash alike anywhere
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)), starts, ends


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the ``width`` values from each place on (shorter at the end)."""
    have, size = x, 1
    while size * 2 <= width:
        have = np.minimum(have, _pad(have, size))
        size *= 2
    return np.minimum(have, _pad(have, width - size)) if size < width else have


def _pad(x: np.ndarray, n: int) -> np.ndarray:
    out = np.full_like(x, np.iinfo(x.dtype).max)
    if n < len(x):
        out[: len(x) - n] = x[n:]
    return out
