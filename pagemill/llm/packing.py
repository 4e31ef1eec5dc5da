"""Packing of documents into token windows, neighbours by BM25 first.

Texts are tokenized once, into a table of token ids in the shared folder, with partial counts of the
documents that have each term (a token id). Spark adds these up to the global document frequencies, a
table no longer than the vocabulary, which with the number of documents and their mean length gives
every BM25 weight.

A document can be used once only, so the index is sharded by documents that are close to each other.
A few documents, the pivots, are drawn from the corpus; the BM25 scores of a document against them are
read from a table of the vocabulary's weights in each. A document's place is the list of its nearest
pivots, nearest first, and the token table is shuffled by ranges of these places (a permutation-prefix
index): documents that see the pivots in the same order lie side by side, and a place with many documents
is split by further pivots. A task cuts its range into shards of about ``shard_tokens`` tokens, each with
an inverted index; the seed of a window asks it with all its terms, and the best unused neighbours fill
the window. A document that does not fit is cut: its rest opens the next window and is that window's
seed. So all windows of a shard but the last are full, and the last is cut into windows whose lengths are
powers of two, which need no padding.

Neighbours in other shards are not found; how many of the true ones lie in a seed's own shard is measured
in the README.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.shared import SAME, SPACED, Words, row_slices, staged, text_buffers

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
SHARD_TOKENS = 1 << 22
#: Pivots, the tokens that a document should have to be one, and how many of them, nearest first, make a place.
PIVOTS, PIVOT_TOKENS, PREFIX = 24, (2048, 16384), 6
CACHED_WORDS = 500_000
#: Texts and token lists are worked on in parts of about so many bytes.
PART_BYTES = 2 << 20
#: Terms with the most documents of a shard, whose weights are kept as a dense matrix.
DENSE_TERMS = 192
K1, B = 1.2, 0.75

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Token ids of texts, as an array of ``kind``.

    A vocabulary whose file says that it folds case, drops white space and parts letters, digits and marks
    (as the default does) is asked for each word between blanks and line ends once; its ids are kept and
    gathered. Words are told apart by 64 bits. Two generations of ``CACHED_WORDS`` words are kept at most;
    words still in use move from the older to the newer one. Any other vocabulary gets whole texts.
    """

    _of: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = max(self.tokenizer.get_vocab_size(with_added_tokens=True), END_ID + 1)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.by_word = _is_by_word(path)
        self.known, self.older = _Ids.none(self.kind), _Ids.none(self.kind)

    @classmethod
    def at(cls, path: str) -> Encoder:
        """One for each Python worker and vocabulary."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(found)), self.kind), np.array([len(x) for x in found], np.int64)

    def _simple(self, buf: np.ndarray, begins: np.ndarray, start: np.ndarray, end: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of simple words by the vocabulary's model alone: their pieces, folded, with bytes as the model's characters."""
        size = end - start + 1  # and a blank after each
        first = np.cumsum(size) - size
        at = np.minimum(np.repeat(start - first, size) + np.arange(int(size.sum())), len(buf) - 1)
        flat, inside = buf[at], begins[at]
        inside[first] = False
        blank = np.concatenate([first[1:] - 1, [len(flat) - 1]])
        flat[blank], inside[blank] = 0x20, False
        second = np.zeros(len(flat), bool)
        second[1:] = flat[:-1] == 0xC3
        flat[((flat >= 0x41) & (flat <= 0x5A)) | (second & (flat <= 0x9E))] += 0x20
        text = CHARACTERS[np.insert(flat, np.flatnonzero(inside), 0x20)[:-1]].tobytes().decode("utf-16-le").split(" ")
        tokenize = self.tokenizer.model.tokenize
        known = {x: [t.id for t in tokenize(x)] for x in set(text)}
        found = list(map(known.__getitem__, text))
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), self.kind, int(n.sum())), np.add.reduceat(n, np.cumsum(pieces) - pieces)

    def _add(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, starts: np.ndarray) -> None:
        """Learn new words, given by their places in ``buf``; ``starts`` has those of all words."""
        kind = KIND[buf]
        follows = np.zeros(len(buf), bool)
        follows[1:] = buf[:-1] == 0xC3
        kind[follows & LATIN[buf]] = LETTERS
        begins = np.ones(len(buf), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        begins[starts] = True
        pieces, odd = (np.concatenate([[0], np.cumsum(x, dtype=np.int32)]) for x in (begins, kind == 0))
        simple = odd[end] == odd[start]
        at, other = np.flatnonzero(simple), np.flatnonzero(~simple)
        found = [self._simple(buf, begins, start[at], end[at], (pieces[end] - pieces[start])[at])] if len(at) else []
        found.append(self._whole([buf[a:b].tobytes().decode() for a, b in zip(start[other].tolist(), end[other].tolist(), strict=True)]))
        self.known = self.known.with_words(hashes[np.concatenate([at, other])], *_joined_ids(found, self.kind))

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after another, and how many each has."""
        if not self.by_word:
            return self._whole([buf[a:b].tobytes().decode() for a, b in zip(offs.tolist(), offs[1:].tolist(), strict=False)])
        buf, offs = buf[offs[0] : offs[-1]], offs - offs[0]
        if len(self.known.hash) > CACHED_WORDS:
            self.older, self.known = self.known, _Ids.none(self.kind)
        words = Words(buf, offs, SPACED, SAME)
        distinct, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
        new = self.known.find(distinct) < 0
        if new.any():
            at = self.older.find(distinct)
            moved = np.flatnonzero(new & (at >= 0))
            self.known = self.known.with_words(distinct[moved], *self.older.gather(at[moved]))
            new &= at < 0
        if new.any():
            self._add(buf, words.start[first[new]], words.end[first[new]], distinct[new], words.start)
        ids, size = self.known.gather(self.known.find(distinct)[back])
        return ids, np.diff(np.concatenate([[0], np.cumsum(size)])[words.offs])


def _joined_ids(parts: list[tuple[np.ndarray, np.ndarray]], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, kind), *(x for x, _ in parts)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])


@dataclass(frozen=True)
class _Ids:
    """Ids of words by their hash (sorted): those of the k-th stand in ``pool`` from ``at[k]`` on, ``size[k]`` of them."""

    hash: np.ndarray
    at: np.ndarray
    size: np.ndarray
    pool: np.ndarray

    @classmethod
    def none(cls, kind: np.dtype) -> _Ids:
        return cls(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Where each hash stands; -1 for those that are not here."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[at] == hashes, at, -1)

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[which]
        before = np.cumsum(size) - size
        return self.pool[np.repeat(self.at[which] - before, size) + np.arange(int(size.sum()))], size

    def with_words(self, hashes: np.ndarray, ids: np.ndarray, size: np.ndarray) -> _Ids:
        hashes, at, size = (np.concatenate(x) for x in ((self.hash, hashes), (self.at, len(self.pool) + np.cumsum(size) - size), (self.size, size)))
        order = np.argsort(hashes, kind="stable")
        return _Ids(hashes[order], at[order], size[order], np.concatenate([self.pool, ids]))


#: Simple words are made of letters (ASCII, and those from U+00C0 to U+00FF, whose first byte is 0xC3), digits and ASCII marks; not of
#: the marks that begin contractions or special tokens. Their pieces are runs of letters, runs of marks and single digits.
LETTERS, DIGIT, MARKS = 1, 2, 3
KIND = np.zeros(256, np.uint8)
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = LETTERS
KIND[range(0x30, 0x3A)] = DIGIT
KIND[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in "'<"]] = MARKS
#: Characters that stand for bytes in a byte-level model: those of Latin-1, but for those that show nothing.
CHARACTERS = np.arange(256, dtype="<u2")
CHARACTERS[0x7F:0xA1], CHARACTERS[0xAD] = np.arange(0x121, 0x143), 0x143
LATIN = np.zeros(256, bool)
LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
WORD_END = "</w>"
#: Steps of a vocabulary's file for which words can be encoded one by one.
BY_WORD = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _is_by_word(path: str) -> bool:
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    first, then = (said.get("normalizer") or {}).get("normalizers", []), (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
    steps = [x["type"] for x in first], [x["type"] for x in then], (then or [{}])[0].get("pattern", {}).get("Regex")
    inside = not any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") for t in said.get("added_tokens") or [])
    return steps == BY_WORD and said["model"].get("end_of_word_suffix") == WORD_END and inside


# ------------------------------------------------------------ terms and weights


@dataclass(frozen=True)
class Statistics:
    """Of the whole corpus: documents, mean length in tokens, and documents with each term."""

    documents: int
    mean: float
    df: np.ndarray

    def idf(self) -> np.ndarray:
        return np.log1p((self.documents - self.df + 0.5) / (self.df + 0.5)).astype(np.float32)


@dataclass
class Terms:
    """Distinct terms of documents, by document, then term: ``first`` has where each document's begin."""

    doc: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, offs: np.ndarray) -> Terms:
        n, bits = len(offs) - 1, ids.dtype.itemsize * 8
        kind = np.uint32 if n.bit_length() + bits <= 32 else np.uint64
        key = np.repeat(np.arange(n, dtype=kind) << kind(bits), np.diff(offs)) | ids
        key.sort()
        at = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
        doc = (key[at] >> kind(bits)).astype(np.int64)
        return cls(doc, (key[at] & kind((1 << bits) - 1)).astype(ids.dtype), np.diff(np.concatenate([at, [len(key)]])), np.searchsorted(doc, np.arange(n + 1)))

    def weights(self, lengths: np.ndarray, stats: Statistics) -> np.ndarray:
        """BM25 weight of each term in its document."""
        norm = (K1 * (1 - B + B * lengths / max(stats.mean, 1))).astype(np.float32)
        return stats.idf()[self.term] * self.tf * np.float32(K1 + 1) / (self.tf + norm[self.doc])


class Index:
    """An inverted index over the documents of a shard, with weights of the whole corpus. Every document has a term."""

    def __init__(self, ids: np.ndarray, offs: np.ndarray, stats: Statistics):
        self.n = len(offs) - 1
        self.terms = terms = Terms.of(ids, offs)
        weight = terms.weights(np.diff(offs), stats)
        df = np.bincount(terms.term, minlength=len(stats.df))
        # terms of many documents as a matrix, the others as postings by term, then document
        self.column = np.full(len(df), -1, np.int32)
        common = np.argsort(-df, kind="stable")[:DENSE_TERMS]
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((self.n, len(common)), np.float32)
        column = self.column[terms.term]
        at = np.flatnonzero(column >= 0)
        self.dense[terms.doc[at], column[at]] = weight[at]
        rest = np.flatnonzero(column < 0)
        rest = rest[np.argsort(terms.term[rest], kind="stable")]
        self.post_doc, self.post_weight = terms.doc[rest], weight[rest]
        self.post_at = np.concatenate([[0], np.cumsum(np.where(self.column >= 0, 0, df))])

    def scores(self, seed: int) -> np.ndarray:
        """BM25 scores of all documents against all terms of one of them."""
        terms = self.terms.term[self.terms.first[seed] : self.terms.first[seed + 1]].astype(np.int64)
        column = self.column[terms]
        asked = np.zeros(self.dense.shape[1], np.float32)
        asked[column[column >= 0]] = 1
        out = (self.dense @ asked).astype(np.float64)
        terms = terms[column < 0]
        begin, end = self.post_at[terms], self.post_at[terms + 1]
        many = end - begin > 1  # the other postings are the seed's own
        begin, size = begin[many], (end - begin)[many]
        if len(begin):
            at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            out += np.bincount(self.post_doc[at], self.post_weight[at], minlength=self.n)
        return out

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, best first (ties: lower number)."""
        score = self.scores(seed) * unused
        found = np.flatnonzero(score > 0)
        return found[np.argsort(-score[found], kind="stable")]


def order_documents(index: Index, lengths: np.ndarray, window: int) -> list[int]:
    """The order in which documents are laid out, one after another."""
    unused = np.ones(len(lengths), bool)
    sizes, out, filled, waiting, following = lengths.tolist(), [], 0, iter(()), 0
    while len(out) < len(sizes):
        doc = next((d for d in waiting if unused[d]), None)
        if doc is None:
            while not unused[following]:
                following += 1
            doc = following
            unused[doc] = False
            waiting = iter(index.neighbours(doc, unused).tolist()) if sizes[doc] < window - filled else iter(())
        unused[doc] = False
        out.append(doc)
        filled += sizes[doc]
        if filled >= window:
            filled %= window
            waiting = iter(index.neighbours(doc, unused).tolist()) if filled else iter(())
    return out


def cut_points(total: int, window: int) -> np.ndarray:
    """Ends of the sequences over ``total`` tokens: full windows, then falling powers of two."""
    ends = list(range(window, total + 1, window))
    at = ends[-1] if ends else 0
    while at < total:
        at += 1 << ((total - at).bit_length() - 1)
        ends.append(at)
    return np.array(ends, np.int64)


def pack_shard(doc_ids: pa.Array, ids: np.ndarray, offs: np.ndarray, stats: Statistics, window: int, first_sequence: int = 0) -> tuple[pa.RecordBatch, int]:
    """Pieces of a shard's documents, and how many sequences they make."""
    lengths = np.diff(offs)
    order = np.array(order_documents(Index(ids, offs, stats), lengths, window), np.int64)
    ends = np.cumsum(lengths[order])
    cuts = cut_points(int(ends[-1]), window)
    stops = np.union1d(ends, cuts)
    starts = np.concatenate([[0], stops[:-1]])
    place, seq = np.searchsorted(ends, starts, side="right"), np.searchsorted(cuts, starts, side="right")
    doc = order[place]
    start = starts - (ends - lengths[order])[place]
    length = stops - starts
    offset = starts - np.concatenate([[0], cuts])[seq]
    at = offs[doc] + start
    crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
    columns = [doc_ids.take(pa.array(doc)), *(pa.array(c, pa.int64()) for c in (start, length, crc, lengths[doc], first_sequence + seq, offset))]
    return pa.record_batch(columns, names=[c.split()[0] for c in PIECES.split(", ")]), len(cuts)


# ------------------------------------------------------------ the corpus


def token_table(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A table in the shared folder: ``doc, ids, n`` of each document (its tokens and ``END_ID``) and, in rows of their own, ``df``:
    how many documents of a task have each term."""

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(vocabulary)
        df = np.zeros(encoder.size, np.int64)
        for batch in batches:
            buf, offs = text_buffers(batch.column(1))
            for lo, hi in row_slices(offs, PART_BYTES):
                ids, n = encoder.encode(buf, offs[lo : hi + 1])
                ids, n = np.insert(ids, np.cumsum(n), END_ID), n + 1
                ends = np.concatenate([[0], np.cumsum(n)])
                df += np.bincount(Terms.of(ids, ends).term, minlength=len(df))
                lists = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((ends * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
                yield _tokens(batch.column(0).slice(lo, hi - lo), lists, pa.array(n), pa.nulls(hi - lo, _DF))
        found = np.flatnonzero(df)
        counts = pa.StructArray.from_arrays([pa.array(found), pa.array(df[found])], ["term", "n"])
        none = [pa.nulls(1, kind) for kind in (pa.int64(), pa.binary(), pa.int64())]
        yield _tokens(*none, pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), counts))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    return staged(rows.mapInArrow(tokenized, "doc long, ids binary, n long, df array<struct<term:long,n:long>>"), "tokens", compression="zstd")


_DF = pa.list_(pa.struct([("term", pa.int64()), ("n", pa.int64())]))


def _tokens(*columns: pa.Array) -> pa.RecordBatch:
    return pa.record_batch(list(columns), names=["doc", "ids", "n", "df"])


def statistics(tokens: DataFrame, size: int) -> Statistics:
    """Global statistics of a token table; the driver gets a row for each term of the vocabulary at most."""
    whole = tokens.filter("ids IS NOT NULL").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).first()
    counts = tokens.filter("df IS NOT NULL").select(F.explode("df").alias("t")).groupBy("t.term").agg(F.sum("t.n").alias("n")).collect()
    df = np.zeros(size, np.int64)
    for term, n in counts:
        df[term] = n
    return Statistics(whole.docs, (whole.tokens or 0) / max(whole.docs, 1), df)


def _documents(batch: pa.RecordBatch, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    n = batch.column(batch.schema.get_field_index("n")).to_numpy()
    ids = batch.column(batch.schema.get_field_index("ids"))
    raw, offs = ids.buffers()[2], np.frombuffer(ids.buffers()[1], np.int32)
    begin = int(offs[ids.offset])
    return np.frombuffer(raw, kind, int(n.sum()), begin), np.concatenate([[0], np.cumsum(n)])


def pivot_weights(tokens: DataFrame, stats: Statistics, kind: np.dtype) -> np.ndarray:
    """For every term its BM25 weight in each pivot, pivots scaled to length 1.

    Pivots are ``PIVOTS`` documents by a hash of them, those of ``PIVOT_TOKENS`` tokens first: all that the driver gets.
    """
    low, high = PIVOT_TOKENS
    fit = tokens.filter(F.col("n") <= high).select("ids", "n", (F.col("n") < low).alias("short"), F.xxhash64("doc", "ids").alias("h"))
    found = fit.orderBy("short", "h").limit(PIVOTS).select("ids").collect()
    ids = [np.frombuffer(r.ids, kind) for r in found]
    out = np.zeros((len(stats.df), max(1, len(ids))), np.float32)
    if ids:
        offs = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        terms = Terms.of(np.concatenate(ids), offs)
        out[terms.term, terms.doc] = terms.weights(np.diff(offs), stats)
    return out / np.maximum(np.sqrt((out**2).sum(axis=0)), 1e-9)


def places(terms: Terms, weight: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Each document's nearest pivots, nearest first (ties: the lower number), as digits of a number."""
    score = np.add.reduceat(pivots[terms.term] * weight[:, None], terms.first[:-1]) if len(terms.first) > 1 else np.zeros((0, 1))
    near = np.argsort(-score, axis=1, kind="stable")[:, :PREFIX]
    place = np.zeros(len(near), np.int64)
    for digit in near.T:
        place = place * PIVOTS + digit
    return place


def placed(tokens: DataFrame, stats: Statistics, kind: np.dtype) -> DataFrame:
    """``doc, ids, n`` of a token table with each document's ``place``."""
    pivots = pivot_weights(tokens, stats, kind)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in row_slices(np.concatenate([[0], np.cumsum(batch.column(2).to_numpy())]), PART_BYTES // 8):
                part = batch.slice(lo, hi - lo)
                ids, offs = _documents(part, kind)
                terms = Terms.of(ids, offs)
                yield pa.record_batch([*part.columns, pa.array(places(terms, terms.weights(np.diff(offs), stats), pivots))], names=["doc", "ids", "n", "place"])

    rows = tokens.filter("ids IS NOT NULL").select("doc", "ids", "n")
    return rows.mapInArrow(place, "doc long, ids binary, n long, place long")


def pack(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", window: int = 4096, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens.

    ``vocabulary`` is the path of a tokenizer file that every executor has; ``doc_id`` an integer.
    Returns a row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.
    A document's ids are those of its text and ``END_ID``; null and empty texts have that id alone, null ids
    stay null. Each row of repeated rows is packed; ties in score go to the document that comes first in its
    shard (by its place, then by a hash); an empty table gives no pieces; other columns are not looked at. A shard
    holds about ``shard_tokens`` tokens, or one longer document, so the memory of a task does not grow with the corpus.
    """
    encoder = Encoder.at(vocabulary)
    kind = encoder.kind
    tokens = token_table(docs, vocabulary, doc_id, text)
    stats = statistics(tokens, encoder.size)
    parts = max(1, -(-int(stats.mean * stats.documents) // shard_tokens))
    key = ["place", "_spread"]
    rows = placed(tokens, stats, kind).withColumn("_spread", F.xxhash64("doc", "ids"))
    rows = rows.repartitionByRange(parts, *key).sortWithinPartitions(*key, "doc").select("doc", "ids", "n")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            n = batch.column(2).to_numpy()
            for lo, hi in row_slices(np.concatenate([[0], np.cumsum(n)]), shard_tokens // 8):
                more = int(n[lo:hi].sum())
                if held and size + more > 1.5 * shard_tokens:
                    done, made = pack_shard(*_joined(held, kind), stats, window, sequence)
                    sequence, held, size = sequence + made, [], 0
                    yield done
                held.append(batch.slice(lo, hi - lo))
                size += more
        if held:
            yield pack_shard(*_joined(held, kind), stats, window, sequence)[0]

    return rows.mapInArrow(packed, PIECES)


def _joined(held: list[pa.RecordBatch], kind: np.dtype) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    parts = [_documents(b, kind) for b in held]
    lengths = np.concatenate([np.diff(offs) for _, offs in parts])
    return pa.concat_arrays([b.column(0) for b in held]), np.concatenate([ids for ids, _ in parts]), np.concatenate([[0], np.cumsum(lengths)])


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
