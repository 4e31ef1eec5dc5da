"""Stupid-backoff scores from n-gram count tables that are partitioned by hash.

Documents are dealt into blocks by a hash of their id and text. A block counts its n-grams and sends each
hash partition its sorted distinct n-grams; the partition adds up the blocks' counts, which is the
count table, and sends every block the totals of its own n-grams; the block joins them to the n-grams
of its documents and sums each document's logarithms. Rows carry packed columns of n-grams, 6 to 7
bytes for each, as single rows for every n-gram of every document would take several times the
text's size. However common an n-gram is, it sends one entry per block.

A document is scored by the counts of all other documents: its own are taken off, so that an n-gram
found nowhere else backs off.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.shared import ALNUM, LOWER, Words, mix, pressed, unpressed

BLOCK_BYTES = 6 << 20
ORDER = 3
BACKOFF = 0.4


def _key_hashes(words: Words, order: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the n-grams of an order, and their hashes."""
    at = np.flatnonzero(words.left >= order)
    return at, mix(words.grams(order)[at] + np.uint64((order + 1) * 0xD1B54A32D192ED03 % (1 << 64)))


#: Stands for the number of all words.
_ALL = mix(np.array([0xD1B54A32D192ED03], np.uint64))


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Partitions are even ranges of the hashes, so sorted keys (all 64 bits of the hashes) are sorted by partition too."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted distinct keys: the first one, then steps of as many bytes as the largest needs, whose highest bytes are compressed."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    cells = steps.astype("<u8").view(np.uint8).reshape(-1, 8)
    press = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    high = press.compress(cells[:, width - 1].tobytes()) + press.flush()
    return bytes([width]) + int(keys[0]).to_bytes(8, "little") + cells[:, : width - 1].tobytes() + high + len(steps).to_bytes(8, "little")


def _unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width, n = data[0], int.from_bytes(data[-8:], "little")
    low = n * (width - 1)
    cells = np.zeros((n, 8), np.uint8)
    cells[:, : width - 1] = np.frombuffer(data, np.uint8, low, 9).reshape(n, width - 1)
    cells[:, width - 1] = np.frombuffer(zlib.decompress(data[9 + low : -8], -15), np.uint8)
    return np.cumsum(np.concatenate([np.frombuffer(data, "<u8", 1, 1), cells.view("<u8")[:, 0]]), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts as bytes, those from 255 on apart."""
    large = counts >= 255
    return zlib.compress(np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype("<u8").tobytes() + int(large.sum()).to_bytes(8, "little"), 1)


def _unpack_counts(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data)
    n = int.from_bytes(raw[-8:], "little")
    small = np.frombuffer(raw[: len(raw) - 8 - 8 * n], np.uint8)
    out = small.astype(np.int64)
    out[small == 255] = np.frombuffer(raw[len(raw) - 8 - 8 * n : -8], "<u8")
    return out


def _block_words(table: pa.Table) -> Words:
    return Words(*unpressed(table["text"]), ALNUM, LOWER)


_COUNTED = "part long, block long, keys binary, counts binary"
SCORES = "doc_id long, n_words long, log_score double, n_backed_off long"


def stupid_backoff(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, backoff: float = BACKOFF, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Log score of every document under the n-gram counts of all others.

    Words are runs of digits, Latin letters and bytes from 128 on, A-Z lower-cased. A word's score is
    count(n-gram) / count(the n-gram without its last word) for the longest n-gram (up to ``order``
    words, within the text) that another document has, times ``backoff`` for every word by which it is
    shorter than it could be; a single word counts against all words, and one found nowhere else
    as 1 against all words and one more.

    Returns ``doc_id``, ``n_words``, ``log_score`` (sum of natural logarithms, 0 without words) and
    ``n_backed_off`` (words scored by a shorter n-gram). Null and empty texts have no words; each of
    repeated rows is a document of its own, which the other supports; null ids stay null; an empty table gives no
    rows; other columns are not looked at.
    """
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    rows = pressed(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.pmod(F.xxhash64(doc_id, text), F.lit(blocks)).alias("block")), "text")
    parts = blocks

    def count(key: tuple, table: pa.Table) -> pa.Table:
        words = _block_words(table)
        keys, counts = np.unique(np.concatenate([_key_hashes(words, n)[1] for n in range(1, order + 1)]), return_counts=True)
        at = int(np.searchsorted(keys, _ALL[0]))
        keys, counts = np.insert(keys, at, _ALL), np.insert(counts, at, len(words.hash))
        part = _part_of(keys, parts)
        first = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1]) if len(part) else np.zeros(0, int)
        spans = list(zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True)) if len(part) else []
        columns = [part[first], np.full(len(first), key[0].as_py()), [_pack(keys[a:b]) for a, b in spans], [_pack_counts(counts[a:b]) for a, b in spans]]
        return _table(columns)

    def add_up(key: tuple, table: pa.Table) -> pa.Table:
        found = [_unpack(x) for x in table["keys"].to_pylist()]
        ends = np.cumsum([len(x) for x in found])
        counts = np.concatenate([_unpack_counts(x) for x in table["counts"].to_pylist()])
        _, back = np.unique(np.concatenate(found), return_inverse=True)
        totals = np.bincount(back, weights=counts).astype(np.int64)[back]
        out = [_pack_counts(x) for x in np.split(totals, ends[:-1])]
        return _table([table["part"], table["block"], [b""] * len(out), out])

    def score(table: pa.Table, totals: pa.Table) -> pa.Table:
        words = _block_words(table)
        grams = []
        for k in range(1, order + 1):
            at, hashes = _key_hashes(words, k)
            grams.append((at, *np.unique(hashes, return_inverse=True)))
        distinct = np.unique(np.concatenate([_ALL, *(u for _, u, _ in grams)]))
        totals = totals.sort_by("part")
        known = np.concatenate([_unpack_counts(x) for x in totals["counts"].to_pylist()]) if totals.num_rows else np.zeros(0, np.int64)
        if len(known) != len(distinct):
            raise ValueError("the totals of a block do not belong to its n-grams")
        # counts of the other documents: each n-gram's total without the document's own
        n = len(words.hash)
        everything = known[np.searchsorted(distinct, _ALL[0])] - words.count[words.row]
        begin = [everything]  # of each order: counts by the n-gram's first word
        for at, u, back in grams:
            _, own, own_count = np.unique(back * len(words.count) + words.row[at], return_inverse=True, return_counts=True)
            c = np.zeros(n + order, np.int64)
            c[at] = known[np.searchsorted(distinct, u)][back] - own_count[own]
            begin.append(c)
        del grams, known, distinct
        place = np.arange(n) - words.offs[:-1][words.row]
        longest = np.minimum(place + 1, order)
        value = np.log(1 / (everything + 1.0)) + np.log(backoff) * (longest - 1)
        used = np.zeros(n, np.int64)
        for k in range(1, order + 1):
            hit = np.flatnonzero(longest >= k)
            count = begin[k][hit - k + 1]
            hit, count = hit[count > 0], count[count > 0]
            against = everything[hit] if k == 1 else begin[k - 1][hit - k + 1]
            value[hit] = np.log(count / against) + np.log(backoff) * (longest[hit] - k)
            used[hit] = k
        sums = np.bincount(words.row, weights=value, minlength=table.num_rows) if n else np.zeros(table.num_rows)
        short = np.bincount(words.row, weights=used < longest, minlength=table.num_rows).astype(np.int64) if n else np.zeros(table.num_rows, np.int64)
        return pa.table([table["doc_id"].cast(pa.int64()), pa.array(words.count, pa.int64()), pa.array(sums), pa.array(short)], names=[c.split()[0] for c in SCORES.split(", ")])

    counted = rows.groupBy("block").applyInArrow(count, _COUNTED)
    totals = counted.groupBy("part").applyInArrow(add_up, _COUNTED).drop("keys")
    return rows.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(score, SCORES)


def _table(columns: list) -> pa.Table:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table([c.cast(k) if isinstance(c, pa.ChunkedArray) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _COUNTED.split(", ")])


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by trigrams with backoff."""
    out = stupid_backoff(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), "n_backed_off")
