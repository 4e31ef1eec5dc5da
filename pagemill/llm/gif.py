"""GIF media columns: byte payloads stored as timed greyscale frames, decoded to frames and histograms."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.shared import fresh, row_slices, without

WIDTH = 64
FRAME_ROWS = 1024
DELAY_CS = 10
BINS = 8
MAX_CODE = 4096


# ------------------------------------------------------------ LZW


def _widths(bits: int, n: int) -> np.ndarray:
    """Bits of the 1st, 2nd ... code after a clear code; the table grows by one with each but the first."""
    following = (1 << bits) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.clip(np.floor(np.log2(following)).astype(np.int64) + 1, bits + 1, 12)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths and bit places of the codes after a clear code."""
    if bits not in _TABLES:
        w = _widths(bits, MAX_CODE + 64)
        _TABLES[bits] = (w, np.concatenate([[0], np.cumsum(w)[:-1]]))
    return _TABLES[bits]


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """LZW code stream of samples under 2**bits, of variable width up to 12 bits."""
    clear, end = 1 << bits, (1 << bits) + 1
    codes, ages = [clear], [0]
    following, emitted = end + 1, []
    put = emitted.append
    below: list[dict[int, int] | None] = [None] * MAX_CODE  # of each code: the codes that lengthen it
    rest = iter(data)
    prefix = next(rest, -1)
    longer = None
    for b in rest:
        if longer is not None:
            code = longer.get(b)
            if code is not None:
                prefix = code
                longer = below[code]
                continue
        put(prefix)
        if following < MAX_CODE:
            if longer is None:
                below[prefix] = {b: following}
            else:
                longer[b] = following
            following += 1
        else:
            put(clear)
            codes += emitted
            ages += range(len(emitted))
            emitted.clear()
            below = [None] * MAX_CODE
            following = end + 1
        prefix = b
        longer = below[b]
    if prefix >= 0:
        emitted.append(prefix)
    emitted.append(end)
    codes += emitted
    ages += range(len(emitted))
    widths = _table(bits)[0][np.array(ages)]
    widths[0] = bits + 1
    grid = (np.array(codes, np.uint16)[:, None] >> np.arange(12, dtype=np.uint16)) & np.uint16(1)
    return np.packbits(grid[np.arange(12) < widths[:, None]].astype(np.uint8), bitorder="little").tobytes()


def lzw_decode(stream: bytes, bits: int, size: int) -> bytes:
    """The first ``size`` samples of a code stream; ValueError where it is damaged or too short."""
    clear, end = 1 << bits, (1 << bits) + 1
    widths, places = _table(bits)
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.uint32)
    total, at = 8 * len(stream), 0
    out = bytearray()
    while len(out) < size:
        if at + bits + 1 > total:
            raise ValueError("code stream cut off")
        n = min(len(places), (total - at) // (bits + 1) + 1)
        bit = places[:n] + at
        n = int(np.searchsorted(bit + widths[:n], total, side="right"))
        bit, wide = bit[:n], widths[:n]
        byte = bit >> 3
        word = raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16
        codes = (word >> (bit & 7).astype(np.uint32)) & ((1 << wide) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        m = int(stops[0]) if len(stops) else n
        _expand(codes[:m].tolist(), end + 1, out)
        if m == n or codes[m] == end:
            break
        at = int(bit[m] + wide[m])
    if len(out) < size:
        raise ValueError("code stream cut off")
    return bytes(out[:size])


def _expand(codes: list[int], first: int, out: bytearray) -> None:
    """Append what codes between two clear codes stand for.

    The k-th entry is the text of the k-th code and the first sample of the next one, which stand
    side by side in the output, so entries are kept as places there.
    """
    starts: list[int] = []
    put = starts.append
    for code in codes:
        at = len(out)
        put(at)
        if code < first:
            if code >= first - 2:
                raise ValueError("control code inside a run")
            out.append(code)
        else:
            k = code - first
            if k + 1 >= len(starts):
                raise ValueError("code before its entry")
            a, b = starts[k], starts[k + 1] + 1
            out += out[a:b]
            if b > at:  # the entry that this very code makes
                out.append(out[a])


# ------------------------------------------------------------ files

GREY = bytes(v for v in range(256) for _ in range(3))


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_gif(payload: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """Samples as rows of ``width``, ``frame_rows`` to a timed frame, with the palette that keeps their values.

    Each frame is cleared after its time, so that a shorter last one does not stand before the rest of the one before."""
    rows = len(payload) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, frame_rows), 0xF7, 0, 0), GREY]
    out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0")
    for lo in range(0, rows, frame_rows):
        part = payload[lo * width : (lo + frame_rows) * width]
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 2 << 2, delay_cs, 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, width, len(part) // width, 0) + b"\x08" + _blocks(lzw_encode(part)))
    return b"".join([*out, b"\x3b"])


def _read_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def decode_gif(data: bytes, canvas: bool = True) -> Iterator[dict]:
    """Frames in order: place, size, delay, disposal, ``samples`` (palette numbers) and, if ``canvas``, the
    composed RGBA picture after palettes, transparency and the disposal of earlier frames."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("no GIF")
    width, height, flags, background = struct.unpack_from("<HHBB", data, 6)
    at, common = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        common = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(-1, 3)
        at += 3 * n
    screen = np.zeros((height, width, 4), np.uint8) if canvas else None
    delay, disposal, clear_index = 0, 0, None
    while True:
        if at >= len(data):
            raise ValueError("GIF cut off")
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at + 1]
            body, at = _read_blocks(data, at + 2)
            if label == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear_index = packed >> 2 & 7, index if packed & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("unknown GIF block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = common
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(-1, 3)
            at += 3 * n
        bits = data[at]
        stream, at = _read_blocks(data, at + 1)
        samples = lzw_decode(stream, bits, w * h)
        if flags & 0x40:  # rows in four passes
            rows = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            grid = np.empty((h, w), np.uint8)
            grid[rows] = np.frombuffer(samples, np.uint8).reshape(h, w)
            samples = grid.tobytes()
        frame = {"left": left, "top": top, "width": w, "height": h, "delay_ms": delay * 10, "disposal": disposal, "samples": samples}
        if canvas:
            if palette is None:
                raise ValueError("no palette")
            grid = np.frombuffer(samples, np.uint8).reshape(h, w)
            before = screen.copy() if disposal == 3 else None
            area = screen[top : top + h, left : left + w]
            grid = grid[: area.shape[0], : area.shape[1]]
            full = np.zeros((256, 4), np.uint8)
            full[: len(palette), :3], full[: len(palette), 3] = palette[:256], 255
            if clear_index is None:
                area[...] = full[grid]
            else:
                shown = grid != clear_index
                area[shown] = full[grid[shown]]
            frame["canvas"] = screen.copy()
            if disposal == 2:
                area[...] = 0
            elif disposal == 3:
                screen = before
        yield frame
        delay, disposal, clear_index = 0, 0, None


def histogram(canvas: np.ndarray, bins: int = BINS) -> list[int]:
    """Counts of visible pixels by red, then green, then blue, ``bins`` each."""
    shown = canvas[canvas[..., 3] > 0]
    step = 256 // bins
    return [int(n) for c in range(3) for n in np.bincount(shown[:, c] // step, minlength=bins)]


# ------------------------------------------------------------ columns

_NUMBERS = ("number", "left", "top", "width", "height", "delay_ms", "disposal")
FRAMES = T.ArrayType(T.StructType([*(T.StructField(n, T.IntegerType()) for n in _NUMBERS), T.StructField("histogram", T.ArrayType(T.IntegerType()))]))
_FRAME_TYPE = pa.list_(pa.struct([*((n, pa.int32()) for n in _NUMBERS), ("histogram", pa.list_(pa.int32()))]))


def add_gif(docs: DataFrame, text: str = "text", unit: int = WIDTH) -> DataFrame:
    """Add ``n_bytes`` and ``media``: the text's UTF-8 bytes, filled up with bytes 0 to a positive multiple of
    ``unit``, as a GIF. A null text counts as an empty one; equal texts, and so repeated rows, give equal media; all rows
    and other columns stay, but columns of the two names give way; an empty table gives no rows."""
    filled = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rest, payload = without(docs, "n_bytes", "media"), fresh(docs, "_payload")
    rest = rest.withColumn(payload, filled).withColumn("n_bytes", F.octet_length(payload).cast("long"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.schema.get_field_index(payload)
            sizes = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))]).astype(np.int64)
            for lo, hi in row_slices(sizes):
                part = batch.slice(lo, hi - lo)
                media = []
                for x in part.column(column):
                    raw = x.as_py()
                    media.append(encode_gif(raw + b"\0" * (-len(raw) % unit if raw else unit), unit))
                arrays = [part.column(i) for i in range(part.num_columns) if i != column]
                names = [n for i, n in enumerate(part.schema.names) if i != column]
                yield pa.record_batch([*arrays, pa.array(media, pa.binary())], [*names, "media"])

    schema = T.StructType([*rest.drop(payload).schema.fields, T.StructField("media", T.BinaryType())])
    return rest.mapInArrow(coded, schema)


def add_frames(df: DataFrame, media: str = "media") -> DataFrame:
    """Add ``payload`` (the samples of all frames, in order) and ``frames`` (timed, with colour histograms), decoded
    from a column of GIFs. A null medium gives null; a damaged one fails the task; columns of the two names give way;
    an empty table gives no rows."""
    df = without(df, "payload", "frames")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(media))
            sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            for lo, hi in row_slices(sizes):
                part = batch.slice(lo, hi - lo)
                payloads, frames = [], []
                for x in column.slice(lo, hi - lo):
                    if not x.is_valid:
                        payloads.append(None)
                        frames.append(None)
                        continue
                    samples, found = [], []
                    for k, f in enumerate(decode_gif(x.as_py())):
                        samples.append(f.pop("samples"))
                        found.append({"number": k, "histogram": histogram(f.pop("canvas")), **f})
                    payloads.append(b"".join(samples))
                    frames.append(found)
                yield pa.record_batch([*part.columns, pa.array(payloads, pa.binary()), pa.array(frames, _FRAME_TYPE)], [*part.schema.names, "payload", "frames"])

    return df.mapInArrow(decoded, T.StructType([*df.schema.fields, T.StructField("payload", T.BinaryType()), T.StructField("frames", FRAMES)]))


def op5_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as GIFs, read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = add_frames(add_gif(docs).drop("text"))
    shown = F.transform("frames", lambda f: F.concat_ws(":", f["delay_ms"].cast("string"), F.array_join(F.slice(f["histogram"], 1, BINS), "-")))
    return done.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -WIDTH, WIDTH)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.array_join(shown, ";").alias("feature"),
    )
