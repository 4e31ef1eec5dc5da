"""Ranked lexical search by two trees, exact, many items at once.

Documents that hold the same rare terms of the items are brought together, and each task builds a tree over
blocks of them; the items have a tree of their own. A node of either tree holds the largest value of every
coordinate (term) below it, so the product of two nodes bounds every score of any item below one against any
document below the other. Where that bound lies below the weakest kth score that any item of the node has so
far, the whole batch of pairs is dropped; pairs of leaves that remain are scored exactly. A first pass over the
most promising leaf of each block gives kth scores that hold for all documents, so that most nodes are dropped everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.decontaminate import words_of
from pagemill.llm.shared import ALNUM, LOWER, Words, drop_staged, row_slices, staged, staged_so_far, text_buffers

#: Terms of items that are held by every task at once (about 20 bytes each), and items of a search pass; more go in several passes.
GROUP_TERMS, BATCH_ITEMS = 2_000_000, 512
#: Documents of a task (as many tasks as shuffle partitions at least), and documents and (document, term) pairs of a block of it.
TASK_ROWS, BLOCK_ROWS, BLOCK_PAIRS = 65_536, 4096, 1 << 20
#: Documents and items below a leaf, children of a node, cells of a dense matrix.
DOC_LEAF, ITEM_LEAF, FANOUT, CELLS = 64, 8, 4, 1 << 22
#: Terms by which documents are brought together: the rarest of the items' terms that they hold.
SIGNATURE = 3
#: Largest sum of products that a float64 holds exactly.
EXACT = 1 << 53


class Items(NamedTuple):
    """Items of a search pass: their numbers, and terms (columns) and weights of each in CSR form."""

    numbers: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray


# ---------------------------------------------------------------- vectors and statistics


def _term_hashes(terms: list[str]) -> np.ndarray:
    buf, offs = text_buffers(pa.array(terms, pa.string()))
    return Words(buf, offs, ALNUM, LOWER).hash


def vectors(docs: DataFrame, hashes: np.ndarray, doc: str, text: str) -> DataFrame:
    """A row per document: ``doc``, ``n`` (terms with repeats), ``terms`` (places in ``hashes``, ascending) and ``tfs``.

    Terms are known by 64 bits of hash.
    """
    order = np.argsort(hashes)
    known = spark_broadcast(docs, (hashes[order], order.astype(np.int32)))
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorted_hashes, place = known.value
        for batch in batches:
            buf, offs = text_buffers(batch.column(1))
            for lo, hi in row_slices(offs):
                words = Words(buf, offs[lo : hi + 1], ALNUM, LOWER)
                at = np.minimum(np.searchsorted(sorted_hashes, words.hash), max(len(sorted_hashes) - 1, 0))
                hit = np.flatnonzero(sorted_hashes[at] == words.hash) if len(sorted_hashes) else np.zeros(0, int)
                pair, tf = np.unique(words.row[hit].astype(np.int64) << 32 | place[at[hit]], return_counts=True)
                ends = np.searchsorted(pair >> 32, np.arange(hi - lo + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in ((pair & 0xFFFFFFFF).astype(np.int32), tf.astype(np.int32))]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(words.count.astype(np.int64)), *lists], ["doc", "n", "terms", "tfs"])

    return rows.mapInArrow(read, "doc long, n long, terms array<int>, tfs array<int>")


def spark_broadcast(df: DataFrame, value: object):
    return df.sparkSession.sparkContext.broadcast(value)


def document_frequencies(found: DataFrame, terms: int) -> np.ndarray:
    """Documents that hold each term; every task adds up its own before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            flat = batch.column(0).flatten()
            total += np.bincount(flat.to_numpy(zero_copy_only=False), minlength=terms) if len(flat) else 0
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "df"])

    rows = found.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()  # bounded by GROUP_TERMS
    out = np.zeros(terms, np.int64)
    out[rows["term"].to_numpy(int)] = rows["df"].to_numpy(np.int64)
    return out


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def values(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """A term's share of the score of a document of n terms, without the term's weight."""
    sizes, back = np.unique(n, return_inverse=True)
    m = np.array([10 + 90 * int(x) * documents // max(length, 1) for x in sizes], np.int64)[back] if len(sizes) else n  # beyond 64 bits where needed
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


# ---------------------------------------------------------------- trees


def _dense(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Largest value of each cell; each row has a column once at most if rows aren't shared."""
    out = np.zeros(shape[0] * shape[1])
    np.maximum.at(out, rows * shape[1] + cols, vals)
    return out.reshape(shape)


def _levels(leaves: np.ndarray) -> list[np.ndarray]:
    """From the leaves' maxima to the root's: each level holds the maxima of ``FANOUT`` nodes of the one before."""
    out = [leaves]
    while len(out[-1]) > 1:
        x = out[-1]
        pad = -len(x) % FANOUT
        x = np.concatenate([x, np.zeros((pad, x.shape[1]))]) if pad else x
        out.append(x.reshape(-1, FANOUT, x.shape[1]).max(axis=1))
    return out


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """a times b transposed, as whole numbers. Where sums may pass 2**53, columns are taken in parts that can't."""
    if exact:
        return a @ b.T
    out, step = np.zeros((len(a), len(b)), np.int64), 100_000
    for lo in range(0, a.shape[1], step):
        out += (a[:, lo : lo + step] @ b[:, lo : lo + step].T).astype(np.int64)
    return out


class Best:
    """The k best (score, document) of each item so far, and the score below which no pair matters."""

    def __init__(self, floor: np.ndarray, k: int):
        self.score, self.doc = np.zeros((k, len(floor)), np.int64), np.zeros((k, len(floor)), np.int64)
        self.null, self.floor = np.zeros((k, len(floor)), bool), floor

    def needed(self) -> np.ndarray:
        return np.maximum(np.maximum(self.floor, self.score[-1]), 1)

    def add(self, items: np.ndarray, scores: np.ndarray, docs: np.ndarray, null: np.ndarray) -> None:
        """scores: a row per document, a column for each of items."""
        some = np.flatnonzero((scores >= self.needed()[items]).any(axis=0))
        if not len(some):
            return
        at, k = items[some], len(self.score)
        keep = (scores[:, some] >= self.needed()[at]).any(axis=1)
        score = np.concatenate([self.score[:, at], scores[np.ix_(keep, some)].astype(np.int64)])
        doc = np.concatenate([self.doc[:, at], np.repeat(docs[keep, None], len(at), 1)])
        lost = np.concatenate([self.null[:, at], np.repeat(null[keep, None], len(at), 1)])
        order = np.lexsort((doc, lost, -score), axis=0)[:k]
        self.score[:, at], self.doc[:, at], self.null[:, at] = (np.take_along_axis(x, order, 0) for x in (score, doc, lost))

    def table(self, numbers: np.ndarray) -> pa.RecordBatch:
        k, item = np.nonzero(self.score)
        doc = pa.array(self.doc[k, item], pa.int64(), mask=self.null[k, item])
        return pa.record_batch([pa.array(numbers[item], pa.int64()), doc, pa.array(self.score[k, item])], ["item", "doc", "score"])


def search_block(items: Items, order: np.ndarray, doc: np.ndarray, null: np.ndarray, ends: np.ndarray, terms: np.ndarray, vals: np.ndarray, best: Best, first_only: bool) -> int:
    """Search a block of documents (CSR: ``ends``, ``terms``, ``vals``) for all items; returns the pairs that were scored.

    ``order`` brings alike items together. With ``first_only`` each item sees only the leaves that promise most to one of its batch.
    """
    if not len(terms) or not len(items.terms):
        return 0
    # columns are the terms that both sides hold
    column = np.full(max(int(terms.max()), int(items.terms.max())) + 1, -1)
    here = np.zeros(len(column), bool)
    here[terms] = True
    cols = np.unique(items.terms[here[items.terms]])
    if not len(cols):
        return 0
    column[cols] = np.arange(len(cols))
    wanted, at = here[items.terms], column[terms]
    row = np.repeat(np.arange(len(doc)), np.diff(ends))[at >= 0]
    vals, at = vals[at >= 0], at[at >= 0]
    n, width = len(doc), len(cols)
    # the items' tree over these columns
    item_row = np.repeat(np.argsort(order), np.diff(items.starts))[wanted]
    item_at, w = column[items.terms[wanted]], items.weights[wanted]
    exact = float(np.bincount(item_row, weights=w, minlength=1).max()) * 1e6 < EXACT
    tall = max(1, min(ITEM_LEAF, len(order)))
    item_levels = _levels(_dense(item_row // tall, item_at, w, (-(-len(order) // tall), width)))
    # the documents' tree: leaves are longer where a row of maxima is very wide
    leaf = max(DOC_LEAF, -(-n // max(1, CELLS // width)))
    doc_levels = _levels(_dense(row // leaf, at, vals, (-(-n // leaf), width)))
    need = best.needed()[order]
    low = [np.minimum.reduceat(need, np.arange(0, len(need), tall))]
    for level in item_levels[1:]:
        pad = np.full(len(level) * FANOUT - len(low[-1]), np.iinfo(np.int64).max)
        low.append(np.concatenate([low[-1], pad]).reshape(-1, FANOUT).min(axis=1))
    # both trees are gone down together; the shorter one waits at its root
    depth = max(len(item_levels), len(doc_levels))
    alive = np.ones((1, 1), bool)
    for step in range(depth - 1, -1, -1):
        i, d = min(step, len(item_levels) - 1), min(step, len(doc_levels) - 1)
        a, b = item_levels[i], doc_levels[d]
        if step < depth - 1:
            alive = np.repeat(alive, FANOUT, 0)[: len(a)] if step < len(item_levels) - 1 else alive
            alive = np.repeat(alive, FANOUT, 1)[:, : len(b)] if step < len(doc_levels) - 1 else alive
        rows, columns = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(rows):
            return 0
        bound = np.zeros(alive.shape, float if exact else np.int64)
        bound[np.ix_(rows, columns)] = _products(a[rows], b[columns], exact)
        alive &= bound >= low[i][:, None]
    scored, item_of = 0, np.argsort(item_row, kind="stable")
    item_starts = np.searchsorted(item_row[item_of], np.arange(len(order) + 1))
    doc_starts = np.searchsorted(row, np.arange(n + 1))
    narrow = np.full(width, -1)
    for g in np.flatnonzero(alive.any(axis=1)):
        # the last step down: single items against the leaves that are left
        chosen = np.arange(g * tall, min((g + 1) * tall, len(order)))
        pick = item_of[item_starts[chosen[0]] : item_starts[chosen[-1] + 1]]
        used = np.unique(item_at[pick])
        narrow[used] = np.arange(len(used))
        left = _dense(item_row[pick] - chosen[0], narrow[item_at[pick]], w[pick], (len(chosen), len(used)))
        leaves = np.flatnonzero(alive[g])
        single = _products(left, doc_levels[0][np.ix_(leaves, used)], exact)
        own, many = order[chosen], 1
        if first_only:
            waiting = np.unique(single.argmax(axis=1))
        else:
            waiting = np.argsort(-single.max(axis=0), kind="stable")
        while len(waiting):
            # best leaves first, more at a time as the weakest scores settle
            waiting = waiting[(single[:, waiting] >= best.needed()[own][:, None]).any(axis=0)]
            now, waiting = waiting[:many], waiting[many:]
            many = min(2 * many, FANOUT * FANOUT)
            rows = np.concatenate([np.arange(d * leaf, min((d + 1) * leaf, n)) for d in leaves[now]]) if len(now) else np.zeros(0, int)
            step = max(1, CELLS // max(1, len(used)))
            for lo in range(0, len(rows), step):
                part = rows[lo : lo + step]
                size = doc_starts[part + 1] - doc_starts[part]
                entry = np.repeat(doc_starts[part] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                c = narrow[at[entry]]
                hit = c >= 0
                right = _dense(np.repeat(np.arange(len(part)), size)[hit], c[hit], vals[entry][hit], (len(part), len(used)))
                best.add(own, _products(right, left, exact), doc[part], null[part])
                scored += len(part) * len(own)
        narrow[used] = -1
    return scored


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of a task in blocks of at most ``BLOCK_ROWS`` and ``BLOCK_PAIRS`` (one row at least)."""
    for batch in batches:
        ends, lo = batch.column(2).offsets.to_numpy().astype(np.int64), 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(ends, ends[lo] + BLOCK_PAIRS, side="right")) - 1
            hi = min(max(hi, lo + 1), lo + BLOCK_ROWS, batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi


def _search(laid: DataFrame, items: Items, floor: np.ndarray, k: int, documents: int, length: int, first_only: bool) -> DataFrame:
    strongest = np.array([items.terms[a : b][np.argmax(items.weights[a:b])] if b > a else -1 for a, b in zip(items.starts[:-1], items.starts[1:], strict=True)])
    sent = spark_broadcast(laid, (items, np.argsort(strongest, kind="stable"), floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, order, least = sent.value
        best = Best(least, k)
        for block in _blocks(batches):
            lists = block.column(2)
            ends = lists.offsets.to_numpy().astype(np.int64)
            ends -= ends[0]
            terms, tf = (block.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
            n = block.column(1).to_numpy(zero_copy_only=False)
            v = values(tf, np.repeat(n, np.diff(ends)), documents, length)
            null = block.column(0).is_null().to_numpy(zero_copy_only=False)
            doc = block.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            search_block(own, order, doc, null, ends, terms, v, best, first_only)
        yield best.table(own.numbers)

    return laid.select("doc", "n", "terms", "tfs").mapInArrow(run, "item long, doc long, score long")


# ---------------------------------------------------------------- the operator


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The k documents of the highest scores above 0 for each item: ``item_id``, ``rank`` int, ``doc_id`` long, ``score`` long.

    Terms are the words of ``words_of``; scores and weights are those of ``weight`` and ``values``, the sum of both over an
    item's distinct terms, in whole numbers. Equal scores are ranked by ascending document id, null ids last; each of repeated
    rows, of documents or items, counts as one of its own. Null and empty texts have no terms and are in no result; texts are
    read whole, of any length; without documents or items there are no rows; other columns are not looked at.

    Items may be many: their terms are collected in groups of about ``GROUP_TERMS``, and each pass over the documents' vectors
    takes ``BATCH_ITEMS`` of them.
    """
    spark = docs.sparkSession
    began = staged_so_far()
    words = items.select(F.col(item_id).alias("item_id"), F.array_distinct(words_of(F.col(item_text))).alias("terms"))
    listed = staged(words.withColumn("item", F.monotonically_increasing_id()), "items")
    total = listed.agg(F.sum(F.size("terms").cast("long"))).first()[0] or 0
    groups = -(-total // GROUP_TERMS)
    found = []
    for g in range(groups):
        own = listed.filter(F.pmod(F.xxhash64("item"), F.lit(groups)) == g).select("item", "terms").orderBy("item").toPandas()
        found += _grouped(docs, own, k, doc_id, text)
    if not found:
        kind = listed.schema["item_id"].dataType
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])).withColumnsRenamed({"item_id": item_id, "doc_id": doc_id})
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    out = staged(rows.join(listed.select("item", "item_id"), "item").select(F.col("item_id").alias(item_id), "rank", F.col("doc").alias(doc_id), "score"), "ranked")
    drop_staged(began, ("ranked",))
    return out


def _grouped(docs: DataFrame, own, k: int, doc_id: str, text: str) -> list[DataFrame]:
    """Results for a group of items: pandas with ``item`` and ``terms``."""
    vocabulary = sorted({t for x in own["terms"] for t in x})
    if not vocabulary:
        return []
    hashes = _term_hashes(vocabulary)
    place = {t: i for i, t in enumerate(vocabulary)}
    found = staged(vectors(docs, hashes, doc_id, text), "vectors")
    totals = found.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    documents, length, rows = totals
    df = document_frequencies(found, len(vocabulary))
    weights = np.array([weight(int(x), documents) for x in df], np.int64)
    rank = np.empty(len(df), np.int32)  # the rarest term first
    rank[np.lexsort((np.arange(len(df)), -weights))] = np.arange(len(df))
    laid = staged(_brought_together(found.filter(F.size("terms") > 0), rank, rows), "laid")
    out = []
    for lo in range(0, len(own), BATCH_ITEMS):
        part = own.iloc[lo : lo + BATCH_ITEMS]
        terms = [np.array([place[t] for t in x if df[place[t]]], np.int64) for x in part["terms"]]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in terms])]).astype(np.int64)
        flat = np.concatenate(terms)
        items = Items(part["item"].to_numpy(np.int64), starts, flat, weights[flat])
        floor = np.zeros(len(part), np.int64)
        seeds = _ranked(_search(laid, items, floor, k, documents, length, True), k).filter(F.col("rank") == k).select("item", "score").toPandas()
        floor[np.searchsorted(items.numbers, seeds["item"].to_numpy(np.int64))] = seeds["score"].to_numpy(np.int64)
        out.append(staged(_ranked(_search(laid, items, floor, k, documents, length, False), k), "found"))
    return out


def _brought_together(found: DataFrame, rank: np.ndarray, rows: int) -> DataFrame:
    """Vectors in the order of their rarest terms; a range of many rows with the same ones is split by id."""
    sent = spark_broadcast(found, rank)
    names = [f"s{i}" for i in range(SIGNATURE)]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(2).offsets.to_numpy().astype(np.int64)
            own = sent.value[batch.column(2).flatten().to_numpy(zero_copy_only=False)]
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            order = np.lexsort((own, row))
            at = np.arange(len(own)) - np.repeat(ends[:-1] - ends[0], np.diff(ends))
            keys = np.full((SIGNATURE, batch.num_rows), len(sent.value), np.int32)
            for i in range(SIGNATURE):
                hit = at == i
                keys[i, row[hit]] = own[order][hit]
            yield pa.record_batch([*batch.columns, *map(pa.array, keys)], [*batch.schema.names, *names])

    signed = found.mapInArrow(sign, "doc long, n long, terms array<int>, tfs array<int>, " + ", ".join(f"{n} int" for n in names))
    tasks = max(-(-rows // TASK_ROWS), int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key: list[Column] = [F.col(n) for n in names] + [F.xxhash64("doc", "n")]
    return signed.repartitionByRange(tasks, *key).sortWithinPartitions(*names).drop(*names)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all documents for each benchmark item."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return rank_documents(docs, items)
