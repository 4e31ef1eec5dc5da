"""Importance resampling towards a target set: hashed n-grams, and an exact cutoff by weighted medians.

Documents and target texts are bags of words and word pairs, hashed into buckets. The gain of a bucket is the
logarithm of how much commoner it is in the target; a document's weight is the mean gain of its features, and
Gumbel noise on it makes the best scores a draw without replacement. The cutoff of the best is found without a
sort: every partition gives the median of the keys that are still open and how many they are; the weighted median
of these has at least a quarter of the open keys on either side, one of which is given up for good. Once few
keys are open they are looked at directly. Only the winners are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.shared import ALNUM, LOWER, Words, row_slices, staged, text_buffers

#: Buckets of features, share of the eligible documents that is drawn (percent), fewest words of an eligible document, and the seed of the noise.
BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 25, 20, 7
#: Open keys that are sent to the driver at most (24 bytes each).
OPEN_KEYS = 20_000
#: Winners of a partition when they are sorted.
SORTED_ROWS = 1_000_000

# ---------------------------------------------------------------- hashed features

_CRC = np.array([*range(256)], np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)
#: Words of this many bytes or more are added to a CRC one by one, others by tables.
LONG_WORD = 128


def _shift_tables() -> np.ndarray:
    """For each length below ``LONG_WORD`` and each byte of a CRC: the CRC after so many more zero bytes."""
    out = np.zeros((LONG_WORD, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, LONG_WORD):
        out[n] = _CRC[out[n - 1] & 255] ^ (out[n - 1] >> 8)
    return out


_SHIFT = _shift_tables()


def feature_hashes(words: Words, folded: bytes, base: int) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of each word and of each pair (word, blank, next word; 0 where the text ends). ``folded`` begins at byte ``base``."""
    _, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
    spans = zip((words.start[first] - base).tolist(), (words.end[first] - base).tolist(), strict=True)
    one = np.fromiter((zlib.crc32(folded[a:b]) for a, b in spans), np.uint32, len(first))[back] if len(first) else np.zeros(0, np.uint32)
    two = np.zeros(len(one), np.uint32)
    if len(one) > 1:
        state = ~one[:-1]
        begun = ~(_CRC[(state ^ np.uint32(0x20)) & 255] ^ (state >> 8))  # with the blank
        size = (words.end - words.start)[1:]
        n = np.minimum(size, LONG_WORD - 1)
        moved = _SHIFT[n, 0, begun & 255] ^ _SHIFT[n, 1, begun >> 8 & 255] ^ _SHIFT[n, 2, begun >> 16 & 255] ^ _SHIFT[n, 3, begun >> 24]
        two[:-1] = moved ^ one[1:]
        for i in np.flatnonzero((size >= LONG_WORD) & (words.left[:-1] > 1)).tolist():
            two[i] = zlib.crc32(folded[words.start[i + 1] - base : words.end[i + 1] - base], int(begun[i]))
    return one, two


def _features(column: pa.Array, buckets: int) -> Iterator[tuple[int, int, Words, np.ndarray, np.ndarray]]:
    """For slices of rows: first row, end, words, and (row in the slice, bucket) of every feature."""
    buf, offs = text_buffers(column)
    for lo, hi in row_slices(offs):
        words = Words(buf, offs[lo : hi + 1], ALNUM, LOWER)
        one, two = feature_hashes(words, LOWER[buf[offs[lo] : offs[hi]]].tobytes(), int(offs[lo]))
        pair = words.left > 1
        yield lo, hi, words, np.concatenate([words.row, words.row[pair]]), np.concatenate([one, two[pair]]) % np.uint32(buckets)


def bucket_counts(rows: DataFrame, text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; each task adds up its own before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, bucket in _features(batch.column(0), buckets):
                total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    found = rows.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # bounded by buckets
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy(int)] = found["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares, target over source, rounded down."""
    k, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(b) + 1) * (s + k) / ((int(a) + 1) * (t + k)))) for a, b in zip(source, target, strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, doc: str, text: str) -> DataFrame:
    """``doc``, ``n_words``, ``n_features`` and ``weight`` (mean gain of the features, rounded down; 0 without) per row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words, row, bucket in _features(batch.column(1), len(sent.value)):
                n = words.count.astype(np.int64)
                size = n + np.maximum(n - 1, 0)
                total = np.bincount(row, weights=sent.value[bucket], minlength=hi - lo).astype(np.int64)  # whole numbers far below 2**53
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(size), pa.array(total // np.maximum(size, 1))], ["doc", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(weigh, "doc long, n_words long, n_features long, weight long")


def noisy(weight: Column, doc: Column, seed: int = SEED) -> Column:
    """The weight with Gumbel noise drawn by the document's id; null ids draw as the text ``null``."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit("null"))), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return weight + F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))


# ---------------------------------------------------------------- the cutoff


Key = tuple[int, int, int, int]
#: A key orders documents, best first: score downwards, rows with an id first, id upwards, row number.
KEY = ("k0", "k1", "k2", "k3")


def _medians(keys: DataFrame, low: Key | None, high: Key | None, at: Key | None) -> list[tuple[int, Key, int]]:
    """From each partition, of its keys over ``low`` and under ``high``: (side, median, keys of that side); sides are 0 below ``at`` and 1 from it on."""

    def over(table: np.ndarray, key: Key) -> np.ndarray:
        out = np.zeros(len(table), bool)
        for k in range(3, -1, -1):
            out = (table[:, k] > key[k]) | ((table[:, k] == key[k]) & out)
        return out

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.zeros((0, 4), np.int64)]
        for batch in batches:
            t = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            if low is not None:
                t = t[over(t, low)]
            if high is not None:
                t = t[~over(t, high) & (t != high).any(axis=1)]
            parts.append(t)
        t = np.concatenate(parts)
        side = np.zeros(len(t), int) if at is None else (over(t, at) | (t == at).all(axis=1)).astype(int)
        rows = []
        for s in (0, 1):
            own = t[side == s]
            if len(own):
                middle = own[np.lexsort(own.T[::-1])[(len(own) - 1) // 2]]
                rows.append((s, *middle.tolist(), len(own)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["side", *KEY, "n"])

    found = keys.mapInArrow(look, "side long, k0 long, k1 long, k2 long, k3 long, n long").collect()  # two rows a partition at most
    return [(r[0], (r[1], r[2], r[3], r[4]), r[5]) for r in found]


def cutoff(keys: DataFrame, wanted: int, open_keys: int = OPEN_KEYS) -> Key | None:
    """The ``wanted``-th smallest key; keys (four longs) are distinct. None for 0.

    Every round is one pass over the keys: it splits the open ones at the weighted median and brings the partitions' medians of both sides.
    """
    if not wanted:
        return None
    low = high = None
    at, found = None, _medians(keys, None, None, None)
    while True:
        if at is not None:
            below = sum(n for s, _, n in found if s == 0)
            if wanted <= below:
                high, found = at, [x for x in found if x[0] == 0]
            else:
                wanted -= below
                # the split key itself is on the upper side; it stays open by opening the bound just under it
                low, found = (at[0], at[1], at[2], at[3] - 1), [x for x in found if x[0] == 1]
        total = sum(n for *_, n in found)
        if total <= max(open_keys, 1):
            break
        found.sort(key=lambda x: x[1])
        half, seen = (total + 1) // 2, 0
        for _, middle, n in found:
            seen += n
            if seen >= half:
                break
        if middle == at or (low is not None and middle == (low[0], low[1], low[2], low[3] + 1)):
            middle = (middle[0], middle[1], middle[2], middle[3] + 1)  # the least open key: split off behind it
        at = middle
        found = _medians(keys, low, high, at)
    inside = _between(low, high)
    rest = sorted(tuple(r) for r in keys.filter(inside).select(*KEY).collect())  # open_keys at most
    return rest[wanted - 1]


def _beyond(key: Key, strictly: bool) -> Column:
    out = F.lit(not strictly)
    for name, k in list(zip(KEY, key, strict=True))[::-1]:
        out = (F.col(name) > k) | ((F.col(name) == k) & out)
    return out


def _between(low: Key | None, high: Key | None) -> Column:
    out = F.lit(True)
    if low is not None:
        out = out & _beyond(low, True)
    return out & ~_beyond(high, False) if high is not None else out


# ---------------------------------------------------------------- the operator


def resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    open_keys: int = OPEN_KEYS,
) -> DataFrame:
    """Draw ``percent`` of the documents with ``least_words`` words or more, likelier ones the more they resemble the target.

    Returns a row per document: ``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` (1 for the highest score, by ascending
    id where scores are equal; null if not drawn), all long. Null and empty texts have no features and the weight 0; texts of any
    length are read whole. Each of repeated rows is a document of its own; rows of one id and score are drawn in the order in which
    they were read. Null ids are drawn after others of their score. An empty table gives no rows, an empty target smoothed shares;
    other columns are not looked at.
    """
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets))
    rows = weighed(docs, gain, doc_id, text).withColumn("score", noisy(F.col("weight"), F.col("doc"), seed))
    rows = rows.withColumns({"k0": -F.col("score"), "k1": F.col("doc").isNull().cast("long"), "k2": F.coalesce("doc", F.lit(0).cast("long")), "k3": F.monotonically_increasing_id()})
    table = staged(rows, "scores")
    eligible = table.filter(F.col("n_words") >= least_words)
    wanted = percent * eligible.count() // 100
    last = cutoff(eligible.select(*KEY), wanted, open_keys)
    columns = [F.col("doc").alias(doc_id), "n_features", "weight", "score"]
    if last is None:
        return table.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_words") >= least_words) & ~_beyond(last, True)
    parts = max(1, -(-wanted // SORTED_ROWS), min(wanted // 1000, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ordered = table.filter(drawn).repartitionByRange(parts, *KEY).sortWithinPartitions(*KEY)
    # the id of a row holds its partition and its place there
    won = staged(ordered.withColumn("_at", F.monotonically_increasing_id()), "winners")
    part = F.shiftright("_at", 33).cast("int")
    sizes = dict(won.groupBy(part.alias("part")).count().collect())  # a row a partition
    before = np.cumsum([0, *(sizes.get(p, 0) for p in range(max(sizes)))]).tolist()
    rank = F.get(F.array(*map(F.lit, before)), part) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return won.select(*columns, rank.cast("long").alias("rank")).unionByName(table.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of all documents with 20 words or more, towards the benchmark's texts."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target)
