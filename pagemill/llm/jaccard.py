"""Jaccard self-join on word n-grams, by chosen paths.

The join splits all documents recursively: at every node each document picks a few of its n-grams by
a hash that the node seeds, so that documents which share many n-grams pick a common one, and each
picked n-gram leads to a bucket. Small buckets are compared by brute force, large ones are split
again; the whole is repeated in so many runs that a link is found with the wished probability.
Buckets compare sketches of min-hashes and yield stars of candidates; the documents of one star
component then meet with their texts, and the exact similarity of all their pairs decides.

No step emits the pairs of a group: buckets and components above ``BLOCK`` documents are cut into
blocks, each pair of blocks is a group of its own, and groups return counts and stars. Copies of a
text are counted but take part once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.components import components
from pagemill.llm.shared import ALNUM, LOWER, Words, combine, drop_staged, mix, row_slices, staged, staged_so_far, text_buffers

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.997
DEPTH = 3
BLOCK = 768
#: In a large bucket every document is held against one of them, the leader: it is a candidate from NEAR on, and
#: from CLOSE on it is not split further. By the triangle inequality of the Jaccard distance, what is linked (0.8) to
#: a document that is CLOSE (0.7) has a similarity of 0.5 or more to the leader, so it is NEAR even if the sketch is
#: two deviations off; each bucket has its own leader. All pairs of those who are candidates of one leader are compared later.
CLOSE, NEAR = 0.7, 0.375
#: Min-hashes of a sketch, a byte each; candidates agree in CANDIDATE of them, four deviations below what 0.8 gives.
SKETCH, CANDIDATE = 64, 0.6
#: Shingles are told apart by so many bits; the rest of a word holds the row.
HASH_BITS = 44


def runs_for(recall: float, depth: int = DEPTH) -> int:
    """Runs after which a link at the threshold is found with probability ``recall``, even if all its buckets are split ``depth`` times.

    A pair at the threshold picks a common n-gram once per node on average.
    """
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each text (sorted, scrambled to ``HASH_BITS`` bits) and where each text's begin.

    A text of fewer words, but not none, has all of them as its one n-gram.
    """
    at = np.flatnonzero(words.left >= n)
    row, value = [words.row[at]], [words.grams(n)[at]]
    for k in range(1, n):
        few = np.flatnonzero(words.count == k)
        if len(few):
            row.append(few)
            value.append(combine(words.grams(k)[words.offs[few]], np.full(len(few), k, np.uint64)))
    key = np.concatenate(row).astype(np.uint64) << np.uint64(HASH_BITS) | mix(np.concatenate(value)) >> np.uint64(64 - HASH_BITS)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    starts = np.searchsorted(key >> np.uint64(HASH_BITS), np.arange(len(words.count) + 1, dtype=np.uint64))
    return key & np.uint64((1 << HASH_BITS) - 1), starts


def _seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(salt))


def sketches(values: np.ndarray, starts: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """A byte of each of ``size`` min-hashes; rows without n-grams get zeros."""
    out = np.zeros((len(starts) - 1, size), np.uint8)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        spread = mix(values)
        for k, a in enumerate(_seeds(size, 1) | np.uint64(1)):
            out[full, k] = mix(np.minimum.reduceat(spread * a, starts[full])) >> np.uint64(56)
    return out


def chosen_paths(values: np.ndarray, starts: np.ndarray, similarity: float, runs: int, depth: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each depth: row, parent path and path of every bucket that a row goes to."""
    count = np.diff(starts)
    bound = np.minimum(2.0**64 / (similarity * np.maximum(count, 1)), 2.0**64 - 4096).astype(np.uint64)
    spread = mix(values)
    rows = np.tile(np.flatnonzero(count), runs)
    parent = np.repeat(_seeds(runs, 2), len(rows) // runs if runs else 0)
    out = []
    for _ in range(depth):
        got = [[], [], []]
        for lo, hi in row_slices(np.concatenate([[0], np.cumsum(count[rows])]), 1 << 20):
            r, p = rows[lo:hi], parent[lo:hi]
            size = count[r]
            nth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            value = spread[nth + np.repeat(starts[r], size)]
            node = np.repeat(p, size)
            picked = (value ^ node) * np.uint64(0x9E3779B97F4A7C15)
            picked = (picked ^ (picked >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            hit = np.flatnonzero(picked < np.repeat(bound[r], size))
            got[0].append(np.repeat(r, size)[hit])
            got[1].append(node[hit])
            got[2].append(mix(combine(node[hit], value[hit])))
        rows, parent, path = (np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(got, (np.int64, np.uint64, np.uint64), strict=True))
        order = np.argsort(rows, kind="stable")
        out.append((rows[order], parent[order], path[order]))
        rows, parent = rows[order], path[order]
    return out


def _lists(rows: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), values)


def _signed(texts: DataFrame, shingle: int, similarity: float, runs: int, depth: int) -> DataFrame:
    """``doc, digest, n`` (distinct n-grams), ``sketch`` and ``paths1 .. paths<depth>`` of (doc, digest, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffers(batch.column(2))
            for lo, hi in row_slices(offs, 4 << 20):
                values, starts = shingle_sets(Words(buf, offs[lo : hi + 1], ALNUM, LOWER), shingle)
                n = hi - lo
                sketch = sketches(values, starts)
                columns = [batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(np.diff(starts), pa.int64())]
                columns.append(pa.array([x.tobytes() for x in sketch], pa.binary()))
                for rows, parent, path in chosen_paths(values, starts, similarity, runs, depth):
                    both = pa.StructArray.from_arrays([pa.array(parent.view(np.int64)), pa.array(path.view(np.int64))], ["up", "path"])
                    columns.append(_lists(rows, n, both))
                yield pa.record_batch(columns, names=["doc", "digest", "n", "sketch", *(f"paths{k + 1}" for k in range(depth))])

    paths = "".join(f", paths{k + 1} array<struct<up:long,path:long>>" for k in range(depth))
    return texts.mapInArrow(sign, f"doc long, digest string, n long, sketch binary{paths}")


# ------------------------------------------------------------ groups and blocks


def in_blocks(rows: DataFrame, group: str, size: Column, block: int = BLOCK) -> DataFrame:
    """Send each row of a group to the pairs of blocks that hold it: adds ``i <= j`` and ``mine``, the row's own block.

    A group of up to ``block`` rows has one pair, (0, 0); one of n blocks sends every row n times.
    """
    blocks = F.ceil(size / F.lit(block)).cast("int")
    rows = rows.withColumn("_n", F.greatest(blocks, F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("doc", group), F.col("_n")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.withColumns({"i": F.least("mine", "_other"), "j": F.greatest("mine", "_other")}).drop("_n", "_other")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and where each group begins, from batches sorted by ``keys``."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        starts = _group_starts(held, keys)
        if len(starts) > 1:
            last = int(starts[-1])
            yield held.slice(0, last), starts
            held = held.slice(last)
    if held is not None:
        yield held, np.concatenate([_group_starts(held, keys), [held.num_rows]])


def _group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        v = table[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def _by_group(rows: DataFrame, keys: list[str], work: Callable, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys):
            yield from work(table, starts)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _stars(linked: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node to the least of its component, from a symmetric matrix."""
    label = ids.copy()
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == label).all():
            break
        label = new
    off = label != ids
    return ids[off], label[off]


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _candidates(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Stars of the documents of each bucket whose sketches agree."""
    doc, mine, i, j = (table[c].to_numpy() for c in ("doc", "mine", "i", "j"))
    sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(doc), SKETCH)
    sizes = np.diff(starts)
    least = CANDIDATE * SKETCH
    found_a, found_b = [], []
    for n in range(2, 9):  # small buckets of one size at once
        at = starts[:-1][sizes == n]
        for x in range(n):
            for y in range(x + 1, n):
                for lo in range(0, len(at), 20_000):
                    a, b = at[lo : lo + 20_000] + x, at[lo : lo + 20_000] + y
                    ok = (sketch[a] == sketch[b]).sum(axis=1) >= least
                    ok &= (mine[a] != mine[b]) | (i[a] == j[a])
                    found_a.append(doc[a][ok])
                    found_b.append(doc[b][ok])
    for g in np.flatnonzero(sizes > 8):
        lo, hi = int(starts[g]), int(starts[g + 1])
        part, ids = sketch[lo:hi], doc[lo:hi]
        # bytes compared in rows, so that no more than a block squared is held
        linked = np.stack([(part == row).sum(axis=1) >= least for row in part])
        a, b = _stars(linked, ids)
        found_a.append(a)
        found_b.append(b)
    if found_a:
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        key = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        yield pa.record_batch([pa.array(key[:, 0]), pa.array(key[:, 1])], schema=_LINK)


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc, path, leader`` (if they are candidates) and whether the document is to be split further."""
    for batch in batches:
        both = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SKETCH) for k in (2, 4)]
        same = (both[0] == both[1]).sum(axis=1)
        doc, leader = batch.column(0).to_numpy(), batch.column(3).to_numpy()
        linked = (same >= NEAR * SKETCH) & (doc != leader)
        stays = same < CLOSE * SKETCH
        some = linked | stays
        arrays = [pa.array(doc[some]), batch.column(1).filter(pa.array(some)), pa.array(leader[some], pa.int64(), mask=~linked[some]), pa.array(stays[some])]
        yield pa.record_batch(arrays, names=["doc", "path", "leader", "stays"])


def _without_repeats(table: pa.Table, starts: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """One row of each document of a group: repeated rows are counted among its copies already."""
    group, doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts)), table["doc"].to_numpy()
    order = np.lexsort((doc, group))
    again = (doc[order][1:] == doc[order][:-1]) & (group[order][1:] == group[order][:-1])
    if not again.any():
        return table, starts
    kept = np.sort(order[np.concatenate([[True], ~again])])
    return table.take(pa.array(kept)), np.searchsorted(group[kept], np.arange(len(starts)))


_CHECKED = pa.schema([("doc", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])


def _exact(shingle: int, similarity: float) -> Callable:
    """Compare all pairs of each group by their n-grams; count links (with copies) and give stars."""

    def work(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        table, starts = _without_repeats(table.combine_chunks(), starts)
        buf, offs = text_buffers(table["text"])
        edges = [0]
        for s in starts[1:].tolist():  # groups whose texts are worked on together
            if offs[s] - offs[edges[-1]] >= 4 << 20:
                edges.append(s)
        if edges[-1] != int(starts[-1]):
            edges.append(int(starts[-1]))
        for lo, hi in zip(edges, edges[1:], strict=False):
            part = table.slice(lo, hi - lo)
            inner = starts[(starts >= lo) & (starts <= hi)] - lo
            yield from checked(part, inner, *_sets(buf, offs[lo : hi + 1]))

    def _sets(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values, begin = [], [np.zeros(1, np.int64)]
        for lo, hi in row_slices(offs):
            v, s = shingle_sets(Words(buf, offs[lo : hi + 1], ALNUM, LOWER), shingle)
            values.append(v)
            begin.append(s[1:] + begin[-1][-1])
        return np.concatenate(values), np.concatenate(begin)

    def checked(table: pa.Table, starts: np.ndarray, values: np.ndarray, begin: np.ndarray) -> Iterator[pa.RecordBatch]:
        doc, copies, mine, i, j = (table[c].to_numpy() for c in ("doc", "copies", "mine", "i", "j"))
        out: list[list[np.ndarray]] = [[], [], []]
        for lo, hi in zip(starts.tolist(), starts[1:].tolist(), strict=False):
            n = hi - lo
            if n < 2:
                continue
            _, own = np.unique(values[begin[lo] : begin[hi]], return_inverse=True)
            at = begin[lo : hi + 1] - begin[lo]
            size = np.diff(at)
            mark = np.zeros(int(own.max()) + 1, np.int32)
            linked = np.zeros((n, n), bool)
            apart = i[lo] != j[lo]
            for x in range(n - 1):
                mine_x = own[at[x] : at[x + 1]]
                mark[mine_x] = 1
                shared = np.add.reduceat(mark[own[at[x + 1] :]], at[x + 1 : n] - at[x + 1])
                mark[mine_x] = 0
                ok = shared >= similarity * (size[x] + size[x + 1 :] - shared) - 1e-9
                if apart:
                    ok &= mine[lo + x + 1 : hi] != mine[lo + x]
                linked[x, x + 1 :] = ok
            linked |= linked.T
            weight = linked @ copies[lo:hi]
            a, b = _stars(linked, doc[lo:hi])
            some = weight > 0
            out[0] += [doc[lo:hi][some], a]
            out[1] += [np.full(int(some.sum()), -1), b]
            out[2] += [weight[some], np.zeros(len(a), np.int64)]
        if out[0]:
            d, o, w = (np.concatenate(x) for x in out)
            yield pa.record_batch([pa.array(d, pa.int64()), pa.array(o, pa.int64(), mask=w > 0), pa.array(w, pa.int64())], schema=_CHECKED)

    return work


# ------------------------------------------------------------ the join


def text_digest(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    depth: int = DEPTH,
    block: int = BLOCK,
) -> DataFrame:
    """``doc_id``, ``class_id``, ``n_links``, ``digest`` (of the text) and ``is_first`` of every row of ``docs``.

    Two rows are linked if the Jaccard similarity of their sets of ``shingle``-word n-grams is at
    least ``similarity``; a text of fewer words has all of them as one n-gram. Words are runs of
    digits, Latin letters and bytes from 128 on, A-Z lower-cased. ``n_links`` counts the other rows
    that a row is linked to, copies of texts one by one; ``class_id`` is the least id of all rows
    reached over links. A text that is null, empty or without words is linked to nothing, and its
    class is its own id. Rows of one id with different texts are told apart by their texts, and repeated rows
    are copies; a null id stays alone, with a null class. Other columns are not looked at; an empty table gives
    no rows. ``is_first`` marks the row of each class with the least id (of several texts under it, that with the
    least digest; of repeated rows all), and all rows that stay alone. Ids below -2**62 are kept for the operator's own use.

    ``recall`` is the probability to find a link at the threshold; copies and closer texts are surer.
    """
    runs, since = runs_for(recall, depth), staged_so_far()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), text_digest(text).alias("digest"), F.col(text).alias("text"))
    signed = staged(_signed(rows, shingle, similarity, runs, depth), "signed")
    members = signed.select("doc", "digest", "n")
    kept = members.filter("doc IS NOT NULL AND n > 0").groupBy("digest").agg(F.min("doc").alias("first"), F.count("*").alias("copies"))
    # a text's node is its least id; where that is the least id of several texts, the others have nodes of their own
    nth = F.row_number().over(Window.partitionBy("first").orderBy("digest"))
    own = -F.lit(1 << 62) - F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    kept = staged(kept.withColumn("doc", F.when(nth == 1, F.col("first")).otherwise(own)), "texts")
    nodes_of = kept.select("digest", F.col("first"), F.col("doc").alias("node"))
    texts = signed.join(nodes_of, (signed.doc == nodes_of["first"]) & (signed.digest == nodes_of.digest)).drop(nodes_of.digest).dropDuplicates(["node"])
    texts = staged(texts.select(F.col("node").alias("doc"), "digest", "n", "sketch", *(f"paths{k + 1}" for k in range(depth))), "nodes")

    found = None
    reached = texts.select("doc", F.explode("paths1").alias("p")).select("doc", F.col("p.path").alias("path"))
    for level in range(1, depth + 1):
        sizes = reached.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1")
        sized = staged(reached.join(sizes, "path"), f"buckets{level}")
        leaves = sized if level == depth else sized.filter(F.col("size") <= block)
        leaves = in_blocks(leaves.join(texts.select("doc", "sketch"), "doc"), "path", F.col("size"), block).select("path", "i", "j", "mine", "doc", "sketch")
        part = _by_group(leaves, ["path", "i", "j"], _candidates, "a long, b long")
        found = part if found is None else found.unionByName(part)
        if level == depth:
            break
        large = sized.filter(F.col("size") > block).select("doc", "path")
        if large.isEmpty():
            break
        large = large.join(texts.select("doc", "sketch"), "doc")
        leaders = large.groupBy("path").agg(F.min_by(F.struct("doc", "sketch"), F.xxhash64("doc", "path")).alias("l")).select("path", F.col("l.doc").alias("leader"), F.col("l.sketch").alias("leader_sketch"))
        led = large.join(leaders, "path").select("doc", "path", "sketch", "leader", "leader_sketch")
        led = staged(led.mapInArrow(_led, "doc long, path long, leader long, stays boolean"), f"led{level}")
        found = found.unionByName(led.filter("leader IS NOT NULL").select(F.col("doc").alias("a"), F.col("leader").alias("b")))
        stays = led.filter("stays").select("doc", F.col("path").alias("up"))
        below = texts.join(stays.select("doc").distinct(), "doc", "left_semi").select("doc", F.explode(f"paths{level + 1}").alias("p"))
        reached = below.select("doc", "p.up", "p.path").join(stays, ["doc", "up"], "left_semi").select("doc", "path")

    rough = staged(components(found), "rough")
    labelled = rough.select(F.col("node").alias("doc"), "root").unionByName(rough.select(F.col("root").alias("doc"), "root").distinct())
    sizes = labelled.groupBy("root").agg(F.count("*").alias("size"))
    nodes = staged(labelled.join(sizes, "root").join(kept, "doc"), "candidates")
    full = rows.withColumnRenamed("doc", "first").join(nodes, ["first", "digest"])
    full = in_blocks(full.select("root", "size", "doc", "copies", "text"), "root", F.col("size"), block).select("root", "i", "j", "mine", "doc", "copies", "text")
    checked = staged(_by_group(full, ["root", "i", "j"], _exact(shingle, similarity), "doc long, other long, links long"), "checked")

    drop_staged(since, keep=("signed", "texts", "checked"))  # what the result is read from
    classes = components(checked.filter("other IS NOT NULL").select(F.col("doc").alias("a"), F.col("other").alias("b")))
    links = checked.groupBy("doc").agg(F.sum("links").alias("links"))
    per_text = kept.join(links, "doc", "left").join(classes.withColumnRenamed("node", "doc"), "doc", "left")
    per_text = per_text.select("digest", "first", F.coalesce("root", "doc").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # of each class the least id and its least digest; a third of all rows can have one class, so it is added up before the shuffle
    heads = per_text.groupBy("root").agg(F.min(F.struct("first", "digest")).alias("head"))
    per_text = per_text.join(heads, "root").select("digest", F.col("head.first").alias("class_id"), F.col("head.digest").alias("_head"), "n_links")
    out = members.join(per_text, "digest", "left")
    alone = F.col("n_links").isNull() | F.col("doc").isNull()
    return out.select(
        F.col("doc").alias(doc_id),
        F.when(alone, F.col("doc")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        "digest",
        (alone | ((F.col("doc") == F.col("class_id")) & (F.col("digest") == F.col("_head")))).alias("is_first"),
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near copies among all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links")
