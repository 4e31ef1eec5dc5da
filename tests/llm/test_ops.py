"""The numbered operators against plain versions and on hard cases."""

import hashlib
import math
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from pagemill.llm import chat, decontaminate, gif, jaccard, langid, lm, packing, shared, sharding, substring, warc  # noqa: E402
from pagemill.llm.components import components  # noqa: E402

DOCS = brute.documents()
DDL = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    """Dealt over several partitions, with extra columns that have the operators' own names."""
    rows = spark.createDataFrame(DOCS, DDL).repartition(5)
    for clash in ("doc", "words", "key", "n", "place", "block", "part", "shard", "digest", "media", "frames", "path"):
        rows = rows.withColumn(clash, F.lit(1))
    return rows


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


# ------------------------------------------------------------ kernels


def test_words_are_cut_alike_at_any_block_size(monkeypatch):
    import pyarrow as pa

    texts = [t for _, t in DOCS]
    buf, offs = shared.text_buffers(pa.array(texts))
    want = shared.Words(buf, offs, shared.ALNUM, shared.LOWER)
    assert want.count.tolist() == [len(brute.words(t)) for t in texts]
    spaced = shared.Words(buf, offs, shared.SPACED, shared.SAME)
    assert spaced.count.tolist() == [len((t or "").encode().split()) for t in texts]
    monkeypatch.setattr(shared, "BLOCK_BYTES", 64)
    got = shared.Words(buf, offs, shared.ALNUM, shared.LOWER)
    assert (got.hash == want.hash).all() and (got.start == want.start).all() and (got.end == want.end).all()
    by_word = defaultdict(set)
    for w, h in zip((x for t in texts for x in brute.words(t)), want.hash.tolist(), strict=True):
        by_word[w].add(h)
    assert all(len(x) == 1 for x in by_word.values()) and len(set.union(*by_word.values())) == len(by_word)
    assert (want.grams(5)[: len(want.hash) - 5] != 0).all()


# ------------------------------------------------------------ 1


def test_warc_round_trip(spark, tmp_path):
    big = "é<p>" * 50
    rows = [(5, "http://a b\n", big), (2, None, big), (9, "c", big), (3, "d", None), (4, "e", ""), (6, "f", "y" * 99), (7, "g", "y" * 99), (8, "h", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("digest", F.lit("clash"))
    warc.write_archives(pages, str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    for i, _, html in rows:
        body = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert got[i].payload == (None if i in (5, 9) else body)
    assert {i: (got[i].record_type, got[i].refers_to) for i in got} == {i: ("revisit", 2) if i in (5, 9) else ("response", None) for i in got}
    raw = next(p for p in (tmp_path / "w").glob("part-*") if p.stat().st_size).read_bytes()
    assert raw[:4] == (0x184D2A5D).to_bytes(4, "little")


@pytest.mark.parametrize("digests", [250_000, 0])
def test_warc_archives_have_few_records_and_repeats_are_joined_by_either_way(spark, tmp_path, monkeypatch, digests):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", digests)
    rows = [(i, None, f"<p>{i % 7}</p>" * 40) for i in range(500)] + [(None, "u", "x"), (3, None, "<p>3</p>" * 40)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), str(tmp_path / "w"), most=70)
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    want = [(i, "response" if i is None or i < 7 else "revisit", None if i is None or i < 7 else i % 7) for i, _, _ in rows]
    assert sorted(map(repr, ((r.page_id, r.record_type, r.refers_to) for r in got))) == sorted(map(repr, want))
    files = [p.read_bytes() for p in (tmp_path / "w").glob("part-*") if p.stat().st_size]
    assert len(files) >= 8 and all(f[:4] == (0x184D2A5D).to_bytes(4, "little") and len(list(warc.read_archive(f))) <= 70 for f in files)


def test_warc_archives_are_bounded_by_bytes(spark, tmp_path):
    rows = [(i, None, f"{i}" * 2000 if i % 50 else "".join(map(chr, range(300, 300 + 9000)))) for i in range(300)] + [(300, "u", "z" * 3_000_000)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"), most=100, most_bytes=60_000)
    got = {r.page_id: r.payload_bytes for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert got == {i: len(t.encode()) for i, _, t in rows}
    files = [list(warc.read_archive(p.read_bytes())) for p in (tmp_path / "w").glob("part-*")]
    sizes = [sum(len(warc.payload_of(r)[0] or b"") for r in f) for f in files if f]
    assert len(sizes) > 10 and all(len(f) == 1 or size <= 60_000 for f, size in zip([f for f in files if f], sizes, strict=True))


def test_warc_empty_table(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("spoil", [lambda b: b[:-3], lambda b: b.replace(b"hello", b"hellp"), lambda b: b.replace(b"WARC-Date", b"WARC-Dxte")])
def test_warc_damage_is_found(spoil):
    record = warc.record_bytes(1, "u", b"hello", hashlib.sha256(b"hello").hexdigest(), 5, None, "d")
    with pytest.raises((ValueError, KeyError, UnicodeDecodeError)):
        warc.payload_of(warc.parse_record(spoil(record)))


# ------------------------------------------------------------ 2

ITEMS = [(1, " ".join(DOCS[4][1].split()[32:60])), (2, None), (3, ""), (4, DOCS[3][1]), (5, " ".join(DOCS[10][1].split()[3:11])), (6, DOCS[7][1]), (7, "nothing of this stands anywhere at all in these few texts"), (10, " ".join(DOCS[4][1].split()[32:60]))]


@pytest.mark.parametrize("most", [10_000, 0])
def test_decontamination(spark, docs, most):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.decontaminate(docs, items, broadcast_fingerprints=most).collect()
    want = brute.decontaminated(DOCS, ITEMS)
    assert {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in got} == want and len(got) == len(DOCS)
    assert all(sum(s["to"] - s["from"] for s in r.spans) == r.n_hit for r in got)


@pytest.mark.parametrize("most", [10_000, 0])
def test_decontamination_keeps_repeated_rows(spark, most):
    rows = [(1, ITEMS[0][1]), (1, ITEMS[0][1]), (2, "clean"), (2, "clean"), (2, "clean"), (None, None), (None, None), (1, "else")]
    items = spark.createDataFrame([*ITEMS[:1], *ITEMS[:1]], "item_id long, text string")
    got = decontaminate.decontaminate(spark.createDataFrame(rows, DDL).repartition(3), items, broadcast_fingerprints=most).collect()
    n = len(brute.words(ITEMS[0][1]))
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in got) == [(0, 0, 0, []), (0, 0, 0, []), (1, 1, 0, []), (1, n, n, [1]), (1, n, n, [1]), (2, 1, 0, []), (2, 1, 0, []), (2, 1, 0, [])]


def test_decontamination_of_far_places(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "PLACE_BITS", 7)
    monkeypatch.setattr(decontaminate, "PLACES", 128)
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    got = decontaminate.decontaminate(docs, items).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in got} == brute.decontaminated(DOCS, ITEMS[:1])


def test_decontamination_empty(spark, docs, none):
    items = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.decontaminate(docs, items).collect()} == {0}
    assert decontaminate.decontaminate(none, items).count() == 0


# ------------------------------------------------------------ 3


@pytest.mark.parametrize("seed", [10, 5, 20])
def test_substring(docs, monkeypatch, seed):
    got = substring.remove_repeats(docs, seed=seed).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == brute.without_repeats(DOCS) and len(got) == len(DOCS)


def test_substring_repeated_rows_and_empty(spark, none):
    text = " ".join(f"w{i}" for i in range(25))
    twice = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], DDL)
    got = sorted(((r.doc_id or 0), r.n_removed) for r in substring.remove_repeats(twice).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 25)]
    assert substring.remove_repeats(none).count() == 0


def test_many_texts_of_one_id_are_told_apart(spark):
    """Among 2,000 texts of one id some have hashes that agree in their low bits; every text keeps its own words."""
    words = " ".join(f"r{i}" for i in range(30))
    texts = [f"{words} {words} own{i}" if i % 500 == 7 else f"other short text {i}" for i in range(2000)]
    got = [r.text for r in substring.remove_repeats(spark.createDataFrame([(1, t) for t in texts], DDL).repartition(3), block_bytes=20_000).collect()]
    assert sorted(got) == sorted(f"{words} own{i}" if i % 500 == 7 else t for i, t in enumerate(texts))
    low = F.pmod(F.xxhash64("t"), F.lit(1 << 16))
    some = spark.range(3000).select(F.concat(F.lit("other short text "), F.col("id").cast("string")).alias("t"))
    pair = some.withColumn("low", low).groupBy("low").agg(F.collect_list("t").alias("ts")).filter("size(ts) > 1").first().ts[:2]
    both = spark.createDataFrame([(1, f"{words} {words}"), (1, pair[0]), (1, pair[1]), (1, f"{words} {words} {pair[0]}")], DDL)
    assert sorted(r.text for r in substring.remove_repeats(both).collect()) == sorted([words, pair[0], pair[1], f"{words} {pair[0]}"])


def test_substring_of_a_very_long_text(spark):
    rng = np.random.default_rng(1)
    long = " ".join(f"w{x}" for x in rng.integers(0, 50_000, 1_000_000))
    rows = [(2, long), (1, long[-1500:].split(" ", 1)[1]), (3, "x" * 3_000_000), (4, long.split(" ", 700_000)[-1])]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(spark.createDataFrame(rows, DDL)).collect()}
    first = len(rows[1][1].split())
    assert got == {1: (first, 0), 2: (1_000_000, first), 3: (1, 0), 4: (300_000, 300_000)}


@pytest.mark.parametrize("hot_rows", [10**9, 50])
def test_windows_that_differ_in_half_their_hash_bits_are_no_repeats(spark, monkeypatch, hot_rows):
    """A common header before different texts, whose windows have equal upper bits."""
    real = shared.Words.grams
    monkeypatch.setattr(shared.Words, "grams", lambda self, n: real(self, n) & np.uint64(0xFFFFFFFF) if n == 20 else real(self, n))
    head = [f"h{i}" for i in range(10)]
    texts = [(i, " ".join([*head, *(f"w{i}x{k}" for k in range(14))])) for i in range(300)] + [(900, " ".join([*head, *(f"w7x{k}" for k in range(14))]))]
    # two blocks, so that the repeat of text 7 is not settled inside one
    blocks = []
    for some in (texts[:300], texts[300:]):
        table = pa.table({"doc": [i for i, _ in some], "same": pa.array([0] * len(some), pa.int64()), "text": [t for _, t in some]})
        blocks.append(substring._Block(table, 20, 10))
    keys, n = np.unique(np.concatenate([b.low[b.heads()] for b in blocks]), return_counts=True)
    hot = keys[n >= hot_rows]
    parts = [x for b in blocks for x in b.rows(hot)]
    table = pa.Table.from_batches(parts)
    runs = [r for b in substring._matched(table) for r in b.to_pylist()]
    assert {(r["doc"], r["place"] + k) for r in runs for k in range(r["n"])} == {(900, k) for k in range(5)}
    if len(hot):  # the header's seed no longer gathers all its rows under one key
        assert Counter(table["key"].to_pylist()).most_common(1)[0][1] < 10


@pytest.mark.parametrize("hot_rows", [2, 5000])
def test_substring_with_hot_seeds_and_small_blocks(docs, hot_rows):
    a, b = (substring.remove_repeats(docs.repartition(7), block_bytes=n, partition_bytes=4000, hot_rows=m).collect() for n, m in ((2000, hot_rows), (10**9, 10**9)))
    told = lambda rows: {(r.doc_id, r.n_words, r.n_removed, r.text) for r in rows}
    assert told(a) == told(b) and any(r.n_removed for r in a)


def test_substring_sends_windows_of_shared_seeds_only(spark):
    """Texts that share nothing send no window to the second level."""
    apart = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(40))) for i in range(30)], DDL)
    assert substring.repeated_runs(apart, block_bytes=500).count() == 0


def test_substring_replaces_columns_of_its_own_names(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = spark.createDataFrame([(1, text, "a", "b"), (2, text, "c", "d"), (3, None, None, None)], "doc_id long, text string, n_words string, _doc string")
    got = substring.remove_repeats(rows)
    assert got.columns == ["doc_id", "text", "_doc", "n_words", "n_removed"]
    assert {r.doc_id: (r.text, r._doc, r.n_words, r.n_removed) for r in got.collect()} == {1: (text, "b", 25, 0), 2: ("", "d", 25, 25), 3: ("", None, 0, 0)}


# ------------------------------------------------------------ 4


def test_language_model_learns_and_predicts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    rows = langid.predict(docs.select("doc_id", "lang", "text", langid.held_out().alias("held")), model)
    got = rows.filter("held").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_texts(spark, none):
    docs = spark.createDataFrame([(i, "the cat and the dog " * 9, "en") for i in range(20)] + [(i + 20, "der Hund und die Katze " * 9, "de") for i in range(20)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? 34"), (4, "the dog and " * 40_000), (5, "и")], DDL)
    odd = odd.withColumns({c: F.lit("clash") for c in ("score", "lang_pred", "_letter", "held_out")})
    assert langid.predict(odd, model).columns == ["doc_id", "text", "_letter", "held_out", "lang_pred", "score"]
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and [got[i].score for i in (1, 2, 3)] == [0.0] * 3
    assert got[4].lang_pred == "en" and got[5].lang_pred in ("en", "de")
    assert langid.predict(none, model).count() == 0
    assert langid.fit(none.withColumn("lang", F.lit("x"))) is None
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}


def test_letters_that_are_no_language_score_low(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = np.random.default_rng(3)
    words = lambda low, high: " ".join("".join(chr(c) for c in rng.integers(low, high, rng.integers(2, 9))) for _ in range(60))
    odd = [(-1 - k, words(97, 123)) for k in range(20)]
    made = langid.predict(docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, DDL)), langid.fit(docs))
    scores = {r.doc_id: r.score for r in made.filter(F.length(F.regexp_replace("text", r"\P{L}+", "")) >= 64).collect()}
    assert max(s for d, s in scores.items() if d < 0) < 0.3 and min(s for d, s in scores.items() if d >= 0) > 0.4


def test_windows_are_drawn_from_whole_texts():
    text = "a" * 256 * 50 + "!" * 256 * 20 + "b" * 256 * 400 + "c" * 7
    own, noise = langid.draws(text, True)
    most = langid.EPOCHS * langid.EACH
    assert own.shape == noise.shape == (most, langid.WINDOW + 3) and (langid.letters_of(own) == langid.WINDOW).all()
    assert np.array_equal(own, langid.draws(text, False)[0]) and not len(langid.draws(text, False)[1])
    assert (own[:, 0] == langid.CLASS[ord("b")]).sum() > most / 2  # far from the text's beginning
    assert len(langid.draws("12 !", True)[0]) == 0 and len(langid.draws("", True)[0]) == 0
    shuffled = langid.noise_of("Ä b, c-9 d" * 9, np.random.default_rng(1))
    assert len(shuffled) == 90 and [c for c in shuffled if not c.isalpha()] == [c for c in "Ä b, c-9 d" * 9 if not c.isalpha()]


def test_rare_languages_and_repeated_rows_in_the_sample(spark):
    """A language of one row in a hundred is learned, and a row that makes up most of the table counts once."""
    rows = [(i, f"the cat and the dog number {i} " * 9, "en") for i in range(2000)] + [(5000 + i, f"der Hund und die Katze Nummer {i} " * 9, "de") for i in range(25)]
    docs = spark.createDataFrame(rows + [(7000, "the cat and the dog", "en")] * 3000, "doc_id long, text string, lang string")
    model = langid.fit(docs, rows=100)
    assert model.languages == ["de", "en"]
    asked = spark.createDataFrame([(1, "die Katze und der Hund " * 5), (2, "the dog and the cat " * 5)], DDL)
    assert {r.doc_id: r.lang_pred for r in langid.predict(asked, model).collect()} == {1: "de", 2: "en"}
    assert langid.fit(docs.withColumn("text", F.lit("12 !"))) is None


def test_prediction_tables_equal_filters():
    rng = np.random.default_rng(2)
    model = langid.train(["abc def " * 40, "xyz üüü " * 40], ["a", "b"])
    x = rng.integers(0, 124, (3, langid.WINDOW + 3)).astype(np.uint8)
    tops = [np.stack([sum(f[j][x[:, i + j]] for j in range(w)) for i in range(langid.WINDOW)], axis=1).max(axis=1) for w, f in zip(langid.WIDTHS, model.filters, strict=True)]
    logits = np.maximum(np.concatenate(tops, axis=1) + model.bias, 0) @ model.weight + model.offset
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    assert np.allclose(langid.Predictor(model).windows(x), p / p.sum(axis=1, keepdims=True), atol=1e-4)


# ------------------------------------------------------------ 5


def test_gif_round_trip(docs):
    got = {r.doc_id: r for r in gif.add_frames(gif.add_gif(docs.select("doc_id", "text", "n"))).collect()}
    for i, text in DOCS:
        raw = (text or "").encode()
        assert got[i].payload == raw + b"\0" * (-len(raw) % 64 if raw else 64) and got[i].n_bytes == len(raw)
        assert sum(sum(f.histogram) for f in got[i].frames) == 3 * len(got[i].payload)


def test_gif_histograms_are_of_each_frame_alone(spark):
    text = "ab" * 35_000
    rows = spark.createDataFrame([(1, text, 7, "m", "f", "p", "q"), (2, None, 7, "m", "f", "p", "q")], "doc_id long, text string, n_bytes int, media string, frames string, payload string, _payload string")
    got = {r.doc_id: r for r in gif.add_frames(gif.add_gif(rows)).collect()}
    assert [sum(f.histogram) for f in got[1].frames] == [3 * 65_536, 3 * (70_016 - 65_536)]
    assert got[1].frames[1].histogram[:8] == [16, 0, 0, 4464, 0, 0, 0, 0]  # 16 bytes of filling, then 0x61 and 0x62
    assert got[1].n_bytes == 70_000 and got[2].n_bytes == 0 and got[1]._payload == "q" and got[1].payload[:70_000] == text.encode()
    assert gif.add_frames(gif.add_gif(rows)).columns == ["doc_id", "text", "_payload", "n_bytes", "media", "payload", "frames"]


@pytest.mark.parametrize("data", [b"\0" * 64, bytes(range(256)) * 500, np.random.default_rng(1).integers(0, 256, 64 * 3000, dtype=np.uint8).tobytes(), b"ab" * 90_016])
def test_lzw(data):
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def test_lzw_damage():
    stream = gif.lzw_encode(bytes(range(200)))
    with pytest.raises(ValueError, match="cut off"):
        gif.lzw_decode(stream[: len(stream) // 2], 8, 200)


def test_gif_disposal_and_transparency():
    import struct

    def image(left, samples, w, h, disposal, clear=None, local=None, interlace=0):
        control = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), 5, clear or 0, 0)
        return control + struct.pack("<BHHHHB", 0x2C, left, 0, w, h, (0x81 if local else 0) | interlace) + (local or b"") + b"\x02" + gif._blocks(gif.lzw_encode(bytes(samples), 2))

    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    data = b"GIF89a" + struct.pack("<HHBBB", 2, 1, 0x81, 0, 0) + palette
    data += image(0, [1, 2], 2, 1, 1) + image(1, [3], 1, 1, 3) + image(0, [0, 1], 2, 1, 2, clear=0) + image(0, [1], 1, 1, 1, local=bytes(3) + b"\x09\x09\x09" + bytes(6)) + b"\x3b"
    frames = [f["canvas"][0, :, :3].tolist() for f in gif.decode_gif(data)]
    red, green, blue, off = [255, 0, 0], [0, 255, 0], [0, 0, 255], [0, 0, 0]
    # the second goes back to what was before it, the third leaves nothing, the fourth has its own palette
    assert frames == [[red, green], [red, blue], [red, red], [[9, 9, 9], off]]
    assert [f["delay_ms"] for f in gif.decode_gif(data)] == [50] * 4
    rows = b"GIF89a" + struct.pack("<HHBBB", 1, 5, 0x81, 0, 0) + palette + image(0, [0, 1, 2, 3, 1], 1, 5, 1, interlace=0x40) + b"\x3b"
    assert next(gif.decode_gif(rows))["samples"] == bytes([0, 3, 2, 1, 1])


# ------------------------------------------------------------ 6


def test_chat_layouts(spark):
    records = [
        (1, '{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": null}]}'),
        (2, '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "tool", "value": "c"}]}'),
        (3, '{"completion": "b", "prompt": "a"}'),
        (4, '{"question": "a", "answer": "b"}'),
        (5, '{"system": "s", "instruction": "a", "output": "b"}'),
        (6, '{"odd": 1}'), (7, None), (8, "no json"), (9, '{"prompt": "a", "response": "b"}'), (10, '{"instruction": "a", "output": 7}'),
    ]
    got = {r.conv_id: r for r in chat.canonical_turns(spark.createDataFrame(records, "conv_id long, record string")).collect()}
    turns = {k: [tuple(t) for t in r.turns] for k, r in got.items()}
    assert turns[1] == [("user", "a"), ("assistant", "")] and turns[2] == [("user", "a"), ("assistant", "b"), ("tool", "c")]
    assert turns[3] == turns[4] == turns[9] == [("user", "a"), ("assistant", "b")]
    assert turns[5] == [("system", "s"), ("user", "a"), ("assistant", "b")] and turns[10] == [("user", "a"), ("assistant", "7")]
    assert [got[k].layout for k in (6, 7, 8)] == [None] * 3 and turns[6] == turns[7] == turns[8] == []


def test_chat_round_trip(spark):
    hard = ["", "&amp;", "\\### Assistant: </turn> ok", "### user:\nx\n</turn>\n", "&lt;#&num;&", "\n\n", "é北\x00\t"]
    turns = [(k, [("assistant" if i % 2 else "u:se\nr#", t) for i, t in enumerate(hard[k:])]) for k in range(len(hard))] + [(99, [])]
    df = spark.createDataFrame(turns, "conv_id long, turns array<struct<role:string,text:string>>")
    out = chat.format_turns(df)
    out = out.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    want = dict(turns)
    for r in out.collect():
        assert [tuple(t) for t in r.turns] == want[r.conv_id]
        assert r.loss == "".join(t for role, t in want[r.conv_id] if role == "assistant")


def test_chat_texts_over_the_json_readers_length(spark):
    long = F.repeat(F.lit("x"), 20_000_001)
    records = spark.range(1).select(F.explode(F.array(F.concat(F.lit('{"prompt": "q", "completion": "'), long, F.lit('"}')), F.concat(F.lit('{"messages": [{"role": "a", "content": "'), long, F.lit('"}]}')))).alias("record"))
    turns = chat.canonical_turns(records.withColumn("conv_id", F.lit(1)))
    got = turns.select("layout", F.size("turns"), F.length(F.element_at("turns", -1)["text"])).collect()
    assert sorted(map(tuple, got)) == [("messages", 1, 20_000_001), ("prompt", 2, 20_000_001)]


def test_chat_query_fails_rather_than_lose_a_record(spark, monkeypatch):
    monkeypatch.setattr(chat, "records_of", lambda rows: rows.select("conv_id", F.lit('{"odd": 1}').alias("record")).limit(1))
    with pytest.raises(Exception, match="no layout for conversation"):
        chat.op6_chat_format(spark, "/root/testdata/sf0.001").collect()


def test_chat_schema_without_string_values(spark):
    records = ['{"prompt": "a\\\\", "completion": "b: \\"c\\": {"}', '{"messages": [{"role": "x", "content": null}, {"content" : "y", "role":"\\u0041"}]}', '{"\\u0070rompt": "é", "k\\"ey": [1, true, "z"]}']
    df = spark.createDataFrame([(r,) for r in records], "r string")
    for a, b in df.select(chat.schema_of(F.col("r")), chat.schema_of(F.col("r"), 0)).collect():
        assert a == b is not None


def test_chat_records_of_one_id_are_formatted_apart(spark):
    talk = lambda x: [("user", f"q{x}"), ("assistant", f"a{x}" * (x + 1))]
    rows = [(1, talk(0)), (1, talk(1)), (2, talk(2)), (2, talk(2)), (None, talk(3)), (3, []), (4, None)]
    df = spark.createDataFrame(rows, "conv_id long, turns array<struct<role:string,text:string>>").withColumns({"_id": F.lit(9), "pos": F.lit(9), "_same": F.lit(1)})
    out = chat.format_turns(df)
    out = out.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = sorted((repr(r.conv_id), [tuple(t) for t in r.turns], r.loss) for r in out.collect())
    assert got == sorted((repr(i), t or [], "".join(x for role, x in t or [] if role == "assistant")) for i, t in rows)
    assert chat.format_turns(df.filter("false")).count() == 0


# ------------------------------------------------------------ 7


def check_packing(rows, texts, window):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in texts}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        ends = [0, *(a + n for a, n in sorted(pieces))]
        assert [a for a, _ in sorted(pieces)] == ends[:-1] and ends[-1] == len(ids[d])
    for pieces in by_seq.values():
        ends = [0, *(a + n for a, n in sorted(pieces))]
        assert [a for a, _ in sorted(pieces)] == ends[:-1]
        assert ends[-1] == window or (ends[-1] < window and ends[-1] & (ends[-1] - 1) == 0)


@pytest.mark.parametrize("shard_tokens", [1 << 20, 1500])
def test_packing(docs, shard_tokens):
    rows = packing.pack(docs, packing.vocabulary_path(), window=256, shard_tokens=shard_tokens).collect()
    check_packing(rows, DOCS, 256)


def test_packing_of_null_and_repeated_ids(spark):
    rows = [(None, "one two"), (None, "one two"), (None, None), (4, "x y " * 3000), (4, "x y " * 3000), (4, "other")]
    got = packing.pack(spark.createDataFrame(rows, DDL).withColumn("ids", F.lit("clash")), packing.vocabulary_path(), window=64).collect()
    tokens = Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0)
    assert tokens == {(None, 3): 2, (None, 1): 1, (4, 6001): 2, (4, 2): 1}
    assert sum(r.length for r in got) == 3 + 3 + 1 + 6001 * 2 + 2


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_whole_texts(monkeypatch, name):
    import random

    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHED_WORDS", 3000)
    path, rng = packing.vocabulary_path(name), random.Random(4)
    tokenizer, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    assert encoder.by_word == (name == packing.VOCABULARY) and encoder.kind.itemsize == 2
    letters = "aAbBzZéÉßẞİıſÀªº²µÿ.,;:!?'\"-0 9\n\t\x0b\x1c\xa0\u0301Σσςǅ北'sT'Re"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(4000)]
    texts += ["<|endoftext|>. a.<|startoftext|>b", "x" * 1500 + " y", *(t or "" for _, t in DOCS)]
    texts += ["".join(rng.choice("abC12.,'-_<|>$é") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    texts += [f"{a}{b}{c}" for a in ("word", "MÉÑÜ", "ÿß", "x×y", "a÷", "Å") for b in ("", ".", "?!", "\u0301", "'s.") for c in ("", ",", "\xa0z.")]
    got = []
    for lo in range(0, len(texts), 100):
        ids, n = encoder.encode(*shared.text_buffers(pa.array(["skipped", *texts[lo : lo + 100]]).slice(1)))
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_empty(none):
    assert packing.pack(none, packing.vocabulary_path()).count() == 0


def plain_scores(sets, stats, seed):
    """BM25 by its formula, for every term of the seed."""
    idf = {t: math.log1p((stats.documents - d + 0.5) / (d + 0.5)) for t, d in enumerate(stats.df.tolist())}
    out = []
    for s in sets:
        norm = packing.K1 * (1 - packing.B + packing.B * len(s) / stats.mean)
        out.append(sum(idf[t] * s.count(t) * (packing.K1 + 1) / (s.count(t) + norm) for t in set(sets[seed]) & set(s)))
    return out


@pytest.mark.parametrize("dense", [0, 3, 192])
def test_scores_are_those_of_the_whole_seed(monkeypatch, dense):
    monkeypatch.setattr(packing, "DENSE_TERMS", dense)
    rng = np.random.default_rng(5)
    sets = [sorted(rng.zipf(1.4, rng.integers(1, 60)).clip(0, 99).tolist()) for _ in range(50)]
    df = np.bincount([t for s in sets for t in set(s)], minlength=100) + 7  # of a larger corpus
    stats = packing.Statistics(500, 31.0, df)
    index = packing.Index(np.concatenate(sets).astype("<u2"), np.cumsum([0, *map(len, sets)]), stats)
    for seed in range(50):
        others = np.arange(50) != seed
        assert np.allclose(index.scores(seed)[others], np.array(plain_scores(sets, stats, seed))[others], rtol=1e-4)
    unused = np.arange(50) % 3 > 0
    want = sorted((-s, d) for d, s in enumerate(index.scores(0).tolist()) if s > 0 and unused[d])
    assert index.neighbours(0, unused).tolist() == [d for _, d in want]


def test_statistics_and_places_are_global(spark):
    texts = ["aa bb bb", "aa cc", None, "bb", "zz zz"]
    tokens = packing.token_table(spark.createDataFrame(list(enumerate(texts)), DDL).repartition(4), packing.vocabulary_path())
    encoder = packing.Encoder.at(packing.vocabulary_path())
    sets = {d: [*encoder.encode(*shared.text_buffers(pa.array([t or ""])))[0].tolist(), 2] for d, t in enumerate(texts)}
    stats = packing.statistics(tokens, encoder.size)
    assert stats.documents == 5 and stats.mean == sum(map(len, sets.values())) / 5
    assert {t: n for t, n in enumerate(stats.df.tolist()) if n} == Counter(t for s in sets.values() for t in set(s))
    pivots = packing.pivot_weights(tokens, stats, encoder.kind)
    assert pivots.shape == (encoder.size, 5)  # all documents, as there are no more
    for r in packing.placed(tokens, stats, encoder.kind).collect():
        s = sets[r.doc]
        norm = packing.K1 * (1 - packing.B + packing.B * len(s) / stats.mean)
        weight = {t: stats.idf()[t] * s.count(t) * (packing.K1 + 1) / (s.count(t) + norm) for t in set(s)}
        scores = [sum(w * pivots[t, k] for t, w in weight.items()) for k in range(5)]
        digits = [r.place // packing.PIVOTS**k % packing.PIVOTS for k in range(4, -1, -1)]
        assert sorted(digits) == list(range(5)) and all(scores[a] >= scores[b] - 1e-4 for a, b in zip(digits, digits[1:], strict=False))


def test_alike_documents_lie_in_one_shard(spark):
    """Documents of five vocabularies: each one's nearest neighbours are those of its own."""
    rng = np.random.default_rng(2)
    words = [[f"{'abcde'[k]}{'aeiou'[i % 5]}{'lmnrst'[i % 6]}{i}" for i in range(60)] for k in range(5)]
    rows = [(i, " ".join(rng.choice(words[i % 5], 80))) for i in range(400)]
    got = packing.pack(spark.createDataFrame(rows, DDL).repartition(3), packing.vocabulary_path(), window=512, shard_tokens=4000).collect()
    shards = defaultdict(Counter)
    for r in got:
        shards[r.sequence_id >> 32][r.doc_id % 5] += r.length
    assert len(shards) > 10 and sum(max(c.values()) for c in shards.values()) > 0.8 * sum(sum(c.values()) for c in shards.values())


# ------------------------------------------------------------ 8


@pytest.mark.parametrize("block", [jaccard.BLOCK, 4])
def test_near_duplicates(docs, block):
    got = jaccard.near_duplicates(docs, block=block).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute.classes(DOCS) and len(got) == len(DOCS)


def test_near_duplicates_null_ids_and_empty(spark, none):
    rows = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "A b, c d e f"), (3, None), (4, "")], DDL)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(rows).collect()}
    assert got == {None: (None, 0), 1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}
    assert jaccard.near_duplicates(none).count() == 0


def test_near_duplicates_of_repeated_ids_and_rows(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(12)) for x in "abc")
    rows = [(0, a), (1, a), (1, b), (1, c), (2, b), (3, c), (3, c), (4, ""), (4, "")]
    df = spark.createDataFrame(rows, DDL).withColumns({x: F.lit("clash") for x in ("digest", "first", "doc", "class_id")})
    got = sorted((r.doc_id, r.class_id, r.n_links, r.is_first) for r in jaccard.near_duplicates(df).collect())
    assert [x[:3] for x in got] == [(0, 0, 1), (1, 0, 1), (1, 1, 1), (1, 1, 2), (2, 1, 1), (3, 1, 2), (3, 1, 2), (4, 4, 0), (4, 4, 0)]
    kept = {(r.doc_id, r.digest) for r in jaccard.near_duplicates(df).filter("is_first").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert kept == {(0, sha(a)), (1, sha(b)), (1, sha(c)), (4, sha(""))}


def test_staged_tables_are_dropped_but_for_those_still_read(spark):
    a = " ".join(f"w{i}" for i in range(30))
    since = shared.staged_so_far()
    out = jaccard.near_duplicates(spark.createDataFrame([(1, a), (2, a + " x"), (3, "other")], DDL))
    labels = [x[1] for x in shared._staged[since:]]
    assert len(labels) == 4 and set(labels[:3]) == {"signed", "texts", "checked"} and labels[3].startswith("links")
    assert sorted((r.doc_id, r.class_id) for r in out.collect()) == [(1, 1), (2, 1), (3, 3)]


def test_near_duplicates_count_repeated_near_rows_once_each(spark):
    a = [f"w{i}" for i in range(60)]
    near = " ".join([*a[:59], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(a)), (2, near), (2, near), (2, near)]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(spark.createDataFrame(rows, DDL)).collect())
    assert got == [(1, 1, 4), (1, 1, 4), (2, 1, 4), (2, 1, 4), (2, 1, 4)]


def test_runs_grow_with_recall():
    assert jaccard.runs_for(0.9) < jaccard.runs_for(0.997) < jaccard.runs_for(0.9999)


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 11), (5, 5), (12, 11), (4, 9), (9, 1), *((k, k + 1) for k in range(20, 60))]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 9: 1, 11: 10, 12: 10, **{k: 20 for k in range(21, 61)}}


# ------------------------------------------------------------ 9


@pytest.mark.parametrize("block_bytes", [1 << 20, 2000])
def test_backoff(docs, block_bytes):
    got = {r.doc_id: r for r in lm.stupid_backoff(docs, block_bytes=block_bytes).collect()}
    want = brute.backoff_scores(DOCS)
    assert set(got) == set(want)
    for d, (n, score, short) in want.items():
        assert (got[d].n_words, got[d].n_backed_off) == (n, short) and got[d].log_score == pytest.approx(score, rel=1e-9, abs=1e-9)


def test_backoff_empty(none):
    assert lm.stupid_backoff(none).count() == 0


def test_packed_counts_and_keys():
    counts = np.array([1, 254, 255, 256, 10**12])
    assert lm._unpack_counts(lm._pack_counts(counts)).tolist() == counts.tolist()
    for keys in ([], [0], [5, 6, 1 << 35], [7, (1 << 32) + 6, (1 << 40) - 1], [(1 << 32) - 1, 1 << 50]):
        assert lm._unpack(lm._pack(np.array(keys, np.uint64))).tolist() == keys


def test_all_bits_of_ngrams_are_kept(docs, monkeypatch):
    """Hashes that differ in their upper 14 bits only are different n-grams."""
    keys = [0, 3, 1 << 50, (1 << 50) + 3, (1 << 63) + 3, (1 << 64) - 1]
    assert lm._unpack(lm._pack(np.array(keys, np.uint64))).tolist() == keys
    real = lm._key_hashes

    def upper(words, order):
        at, hashes = real(words, order)
        return at, hashes >> np.uint64(50) << np.uint64(50)

    few = [(1, "a b c d e f"), (2, "a b c x y"), (3, "x y z a"), (4, "q r")]
    rows = docs.sparkSession.createDataFrame(few, DDL)
    monkeypatch.setattr(lm, "_key_hashes", upper)
    got = {r.doc_id: r for r in lm.stupid_backoff(rows).collect()}
    for d, (n, score, short) in brute.backoff_scores(few).items():
        assert (got[d].n_words, got[d].n_backed_off) == (n, short) and got[d].log_score == pytest.approx(score, rel=1e-9, abs=1e-9)


# ------------------------------------------------------------ 10


def check_shards(rows, texts, shards):
    where, slots, size = {}, defaultdict(list), Counter()
    texts = dict(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        assert where.setdefault(raw, r.shard) == r.shard and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return size


@pytest.mark.parametrize("resolution", [1, 256])
def test_shards(docs, resolution):
    rows = sharding.shard(docs, 7, resolution=resolution, rows_per_run=3).collect()
    assert len(rows) == len(DOCS)
    size = check_shards(rows, DOCS, 7)
    groups = Counter()
    for _, t in DOCS:
        groups[hashlib.sha256((t or "").encode()).hexdigest()] += len((t or "").encode()) + 16
    total, left, large = sum(groups.values()), 7, []
    for digest, n in sorted(groups.items(), key=lambda g: (-g[1], g[0])):
        if n * left <= total:
            break
        large.append(digest)
        total, left = total - n, left - 1
    rest = [groups[d] for d in sorted(groups) if d not in large]
    assert max(size.values()) == max([*(groups[d] for d in large), brute.smallest_capacity(rest, left)])


def test_shards_of_few_rows(spark, none):
    assert sharding.shard(none, 5).count() == 0
    rows = sharding.shard(spark.createDataFrame([(1, None), (1, None), (2, "")], DDL), 5).collect()
    assert sorted(r.slot for r in rows) == [0, 1, 2] and len({r.shard for r in rows}) == 1
