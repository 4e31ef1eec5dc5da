"""Removal of passages that repeat, by level-wise doubling of window lengths.

Windows that repeat at one length are extended to twice that length and compared again, until the
wished length is reached or no candidates survive. The first level looks only at winnowed places:
of the seed-length hashes inside every full window the smallest is its anchor, so two equal windows
have equal anchors at the same place in them.

Texts are dealt into blocks by a hash. A block settles the repeats inside itself, level by level (of
equal windows only the earliest goes on), and sends the distinct anchors of the rest. Anchors that no
other block has end there; only those that some other block has too go back to their blocks, which then
send the hashes of the full windows over them. So a passage sends one row for each block, however many
documents hold it, and text that stands alone sends its anchors only. The texts are shuffled once; the
two levels and the removal read the same exchange.

The second level deals windows over tasks by their anchor, those of hot anchors (many rows, such as a
common header before different texts) by their own hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagemill.llm.shared import SAME, SPACED, Words, mix, sliding_min, text_buffers

PARTITION_BYTES = 24 << 20
BLOCK_BYTES = 4 << 20
#: A seed with so many rows is hot.
HOT_ROWS = 5000


def _repeated(values: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    twin = np.zeros(len(v), bool)
    if len(v) > 1:
        equal = v[1:] == v[:-1]
        twin[1:] |= equal
        twin[:-1] |= equal
    out = np.empty(len(v), bool)
    out[order] = twin
    return out


def _later(values: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which values occur earlier too, where they stand in order of document, then place."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    head = np.ones(len(v), bool)
    head[1:] = v[1:] != v[:-1]
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(v)), 0))]
    out = np.zeros(len(v), bool)
    # rows repeated under one id have equal places, and none is the earlier
    out[order] = (doc[order] != doc[first]) | (place[order] != place[first])
    return out


def _runs(doc: np.ndarray, same: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring places (given in order): document, its hash, first place, length."""
    if not len(doc):
        return doc, same, place, place
    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (same[1:] != same[:-1]) | (place[1:] != place[:-1] + 1)) + 1
    at = np.concatenate([[0], cut])
    return doc[at], same[at], place[at], np.diff(np.concatenate([at, [len(doc)]]))


_ROW = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("same", pa.int64()), ("place", pa.int64()), ("mask", pa.int64()), ("tail", pa.binary())])
_ROW_DDL = "key long, doc long, same long, place long, mask long, tail binary"


class _Block:
    """Windows of the texts of a block: ``gone`` are repeats inside it; each of the ``full`` ones that go on (first words) has its
    smallest seed, ``low``, at the place ``at``, ``back`` words after the window's first. Ordered by ``at``, then ``back``."""

    def __init__(self, table: pa.Table, window: int, seed: int):
        table = table.select(["doc", "same", "text"]).filter(table["doc"].is_valid()).sort_by([("doc", "ascending"), ("same", "ascending")])
        self.window = window
        self.words = words = Words(*text_buffers(table["text"]), SPACED, SAME)
        self.doc, self.same = table["doc"].to_numpy()[words.row], table["same"].to_numpy()[words.row]
        self.place = np.arange(len(words.hash)) - words.offs[:-1][words.row]
        full = np.flatnonzero(words.left >= window)
        found, length = full, seed
        while len(found) and length < window:
            found = found[_repeated(words.grams(length)[found])]
            length = min(2 * length, window)
        self.hash = words.grams(window)
        self.gone = found[_later(self.hash[found], self.doc[found], self.place[found])] if len(found) else found
        stay = np.ones(len(words.hash), bool)
        stay[self.gone] = False
        full = full[stay[full]]
        seeds = np.where(words.left >= seed, words.grams(seed), np.uint64(0xFFFFFFFFFFFFFFFF))
        width = window - seed + 1
        low = sliding_min(seeds, width)[full]
        back = np.full(len(full), -1)
        for k in range(width - 1, -1, -1):
            back[seeds[full + k] == low] = k
        order = np.lexsort((back, full + back))
        self.full, self.back, self.low = full[order], back[order], low[order]
        self.at = self.full + self.back

    def keep(self, which: np.ndarray) -> None:
        self.full, self.back, self.low, self.at = self.full[which], self.back[which], self.low[which], self.at[which]

    def heads(self) -> np.ndarray:
        """The first window of each anchor's place."""
        return np.concatenate([[0], np.flatnonzero(self.at[1:] != self.at[:-1]) + 1]) if len(self.at) else self.at

    def rows(self, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The repeats inside, and what the second level needs; windows of ``hot`` seeds (sorted) have a row each."""
        if len(self.gone):
            d, s, p, n = _runs(self.doc[self.gone], self.same[self.gone], self.place[self.gone])
            yield _batch(mix(d.astype(np.uint64)).view(np.int64), d, s, p, -n, [b""] * len(d))
        own = _is_in(self.low, hot)
        if own.any():
            a, hashes = self.at[own], self.hash[self.full[own]]
            key = _window_hashes(self.low[own], self.back[own], hashes)
            yield _batch(key.view(np.int64), self.doc[a], self.same[a], self.place[a], np.int64(1) << self.back[own], _cut(hashes, np.arange(len(a))))
            self.keep(~own)
        if len(self.at):
            first = self.heads()
            a = self.at[first]
            mask = np.add.reduceat(np.int64(1) << self.back, first)
            yield _batch(self.low[first].view(np.int64), self.doc[a], self.same[a], self.place[a], mask, _cut(self.hash[self.full], first))


def _is_in(values: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values


def _window_hashes(key: np.ndarray, back: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """What tells windows apart: all bits of their seed, its place in them and their hash."""
    return mix(key + back.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ hashes


def _cut(hashes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Bytes of the hashes from each of ``first`` to the next."""
    raw = hashes.astype("<u8").tobytes()
    return [raw[x:y] for x, y in zip((first * 8).tolist(), [*(first[1:] * 8).tolist(), len(raw)], strict=False)]


def _batch(key, doc, same, place, mask, tail) -> pa.RecordBatch:
    arrays = [pa.array(x, t.type) for x, t in zip((key, doc, same, place, mask), _ROW, strict=False)]
    return pa.record_batch([*arrays, pa.array(tail, pa.binary())], schema=_ROW)


_RUN = pa.schema([("doc", pa.int64()), ("same", pa.int64()), ("place", pa.int64()), ("n", pa.int64())])


def _matched(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Runs of windows of a partition that occur earlier elsewhere."""
    key, doc, same, place, mask = (table[c].to_numpy() for c in ("key", "doc", "same", "place", "mask"))
    local = mask < 0
    if local.any():
        yield pa.record_batch([pa.array(x[local], f.type) for x, f in zip((doc, same, place, -mask), _RUN, strict=True)], schema=_RUN)
    alive = np.flatnonzero(~local)
    alive = alive[_repeated(key[alive])]  # the first level: seeds that stand alone end here
    if not len(alive):
        return
    alive = alive[np.lexsort((place[alive], doc[alive]))]
    tail = table["tail"].combine_chunks().take(pa.array(alive))
    key, doc, same, place, mask = (x[alive] for x in (key, doc, same, place, mask))
    count = np.zeros(len(mask), np.int64)
    for k in range(int(mask.max()).bit_length()):
        count += mask >> k & 1
    row = np.repeat(np.arange(len(mask)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    back, seen, wanted = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), mask[row]
    for k in range(int(mask.max()).bit_length()):
        bit = wanted >> k & 1
        back[(bit == 1) & (seen == nth)] = k
        seen += bit
    hashes = np.frombuffer(b"".join(tail.to_pylist()), "<u8")
    value = _window_hashes(key[row].view(np.uint64), back, hashes)
    d, s, p = doc[row], same[row], place[row] - back
    gone = np.flatnonzero(_later(value, d, p))
    gone = gone[np.lexsort((p[gone], s[gone], d[gone]))]
    runs = _runs(d[gone], s[gone], p[gone])
    yield pa.record_batch([pa.array(x, f.type) for x, f in zip(runs, _RUN, strict=True)], schema=_RUN)


def _dealt(docs: DataFrame, doc_id: str, text: str, block_bytes: int) -> tuple[DataFrame, int, int]:
    """``doc, same, block, text, rest`` (the other columns); how many bytes of text, and how many blocks."""
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("same"), F.col(text).alias("text"), rest.alias("rest"))
    return rows.select("doc", "same", _block_of(blocks), "text", "rest"), total, blocks


def _block_of(blocks: int):
    return F.pmod(F.xxhash64("doc", "same"), F.lit(blocks)).alias("block")


def _found_runs(rows: DataFrame, total: int, window: int, seed: int, partition_bytes: int, hot_rows: int) -> DataFrame:
    if not 0 < seed <= window <= 62:
        raise ValueError("0 < seed <= window <= 62")

    def anchors(key: tuple, table: pa.Table) -> pa.Table:
        block = _Block(table, window, seed)
        keys, n = np.unique(block.low[block.heads()], return_counts=True)
        return pa.table({"key": keys.view(np.int64), "block": np.full(len(keys), key[0].as_py()), "n": n})

    sent = rows.groupBy("block").applyInArrow(anchors, "key long, block long, n long")
    # counts are added up in the tasks first, and the join may split a key, so that an anchor of all blocks is no task's own
    counts = sent.groupBy("key").agg(F.count("*").alias("_blocks"), F.sum("n").alias("_rows")).filter("_blocks > 1")
    shared = sent.select("key", "block").join(counts, "key").select("key", "block", (F.col("_rows") >= hot_rows).alias("hot"))

    def windows(table: pa.Table, shared: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _ROW.empty_table()
        key = shared["key"].to_numpy().view(np.uint64)
        block = _Block(table, window, seed)
        block.keep(_is_in(block.low, np.sort(key)))
        return pa.Table.from_batches(block.rows(np.sort(key[shared["hot"].to_numpy()])), _ROW)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if parts:
            yield from _matched(pa.Table.from_batches(parts))

    dealt = rows.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(windows, _ROW_DDL)
    return dealt.repartition(max(1, -(-total // partition_bytes)), "key").mapInArrow(match, "doc long, same long, place long, n long")


def repeated_runs(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = 20,
    seed: int = 10,
    block_bytes: int = BLOCK_BYTES,
    partition_bytes: int = PARTITION_BYTES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Runs of windows whose words occur earlier: ``doc, same, place`` (of the first window's first word), ``n`` windows.

    ``same``, the 64-bit hash of the text, tells apart rows of one id. Earlier: a smaller id, or the same id and an earlier place.
    Null texts have no words, null ids take no part, an empty table gives no rows, and other columns are not looked at.
    """
    rows, total, _ = _dealt(docs.select(doc_id, text), doc_id, text, block_bytes)
    return _found_runs(rows, total, window, seed, partition_bytes, hot_rows)


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = 20,
    seed: int = 10,
    block_bytes: int = BLOCK_BYTES,
    partition_bytes: int = PARTITION_BYTES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Remove every word that a window covers which occurs earlier, and put single blanks between the rest.

    All columns stay, ``text`` holds what is kept, and ``n_words`` and ``n_removed`` are added (columns that
    have these names give way). Words are runs of other bytes than blank and tab to carriage return; windows
    are judged on the input. A null text has no words and becomes empty; texts are read whole, and one longer than
    ``block_bytes`` makes its block so much larger; a null id takes no part and keeps its words. Of equal windows in
    different texts of one id one stays, or those that stand at equal places; rows that repeat an id and text are treated
    alike, so neither removes the other's words. An empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    docs = docs.select(*(F.col(f"`{c}`") for c in names))
    rows, total, blocks = _dealt(docs, doc_id, text, block_bytes)
    runs = _found_runs(rows, total, window, seed, partition_bytes, hot_rows).select("doc", "same", "place", "n", _block_of(blocks))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    others = [c for c in names if c != text]

    def clean(table: pa.Table, runs: pa.Table) -> pa.Table:
        runs = runs.sort_by([("doc", "ascending"), ("same", "ascending")])
        doc, same, place, n = (runs[c].to_numpy() for c in ("doc", "same", "place", "n"))
        head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (same[1:] != same[:-1])])) if len(doc) else np.zeros(0, np.int64)
        ends = [*head[1:].tolist(), len(doc)]
        spans = {(d, s): slice(a, b) for d, s, a, b in zip(doc[head].tolist(), same[head].tolist(), head.tolist(), ends, strict=False)}
        kept, n_words, n_removed = [], [], []
        ids = zip(table["doc"].to_pylist(), table["same"].to_pylist(), strict=True)
        for x, span in zip(table["text"], map(spans.get, ids), strict=True):
            words = (x.as_py() or "").encode().split()
            n_words.append(len(words))
            if span:
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, place[span], 1)
                np.add.at(step, place[span] + n[span] + window - 1, -1)
                words = list(compress(words, (np.cumsum(step)[:-1] == 0).tolist()))
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode())
        rest = dict(zip(others, table["rest"].combine_chunks().flatten(), strict=True)) if table.num_rows else {}
        new = {text: pa.array(kept, pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
        return pa.table({c: new.get(c, rest.get(c)) for c in schema.names}) if table.num_rows else to_arrow_schema(schema).empty_table()

    return rows.groupBy("block").cogroup(runs.groupBy("block")).applyInArrow(clean, schema)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of windows that occur earlier."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))
