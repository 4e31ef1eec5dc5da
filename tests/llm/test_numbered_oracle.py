"""Numbered queries with SQL against DuckDB on the smallest tables."""

import hashlib
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from test_ops import check_packing  # noqa: E402

from pagemill.llm import gif  # noqa: E402
from pagemill.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    result = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())


def rows_of(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, DIR).collect()}


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


def test_queries_with_sql_and_without():
    assert set(QUERIES) - set(ORACLE_SQL) == {"op4_langid", "op5_gif", "op7_packing", "op10_sharding"}


def test_langid_query(spark, duck, texts):
    got, lang = rows_of(spark, "op4_langid"), dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    assert set(got) == set(texts)
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[d] or ""))
    held = [d for d, r in got.items() if r.held_out and r.lang_pred != "und" and lang[d]]
    assert sum(got[d].lang_pred == lang[d] for d in held) / len(held) > 0.95


def test_gif_query(spark, texts):
    got = rows_of(spark, "op5_gif")
    assert set(got) == set(texts)
    for d, r in got.items():
        raw = (texts[d] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        media = gif.encode_gif(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        frames = [payload[i : i + 65536] for i in range(0, len(payload), 65536)]
        counts = [[sum(b // 32 == k for b in f) for k in range(8)] for f in frames]
        assert r.feature == ";".join("100:" + "-".join(map(str, c)) for c in counts)


def test_packing_query(spark, texts):
    check_packing(QUERIES["op7_packing"](spark, DIR).collect(), list(texts.items()), 4096)


def test_sharding_query(spark, texts):
    got = rows_of(spark, "op10_sharding")
    assert set(got) == set(texts)
    slots, filled, shard_of = defaultdict(list), Counter(), {}
    for d, r in got.items():
        raw = (texts[d] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        slots[r.shard].append(r.slot)
        filled[r.shard] += r.size
        assert shard_of.setdefault(raw, r.shard) == r.shard
    assert set(slots) <= set(range(40)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    groups = Counter()
    for t in texts.values():
        groups[(t or "").encode()] += len((t or "").encode()) + 16
    even = sum(groups.values()) / 40
    assert max(filled.values()) <= max(even + max(g for g in groups.values() if g <= even), max(groups.values()))
