"""Quality rules, ranked search and resampling against plain versions and on hard cases."""

import math
import random
import sys
import zlib
from fractions import Fraction
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from pagemill.llm import quality, ranking, resampling, shared  # noqa: E402

LONG = " ".join(f"w{i * 7919 % 5003} x{i % 97}" for i in range(120_000)) + "\n" + "endless" * 40_000
ROWS = [*brute.documents(), (7, "copy of a row"), (7, "copy of a row"), (None, "copy of a row and more of it"), (500, LONG), (501, "a|b # a|b # a|b\n\na|b\n a|b\nx\u00a0y\n\u2028\n"), (502, "\x00 \x00 \x00 \x00")]
DDL = "doc_id long, text string"
ITEMS = [(1, "abc of a row"), (2, None), (3, ""), (1, "abc of a row"), (4, ROWS[4][1]), (5, "w1 x5 endless copy"), (6, ROWS[0][1]), (None, "COPY more"), (8, "nothingofthisisthere")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, DDL).repartition(5)
    for clash in ("doc", "words", "n", "item", "terms", "score", "rank", "weight", "values", "stratum", "kept", "k0", "_n", "n_words", "bucket"):
        rows = rows.withColumn(clash, F.lit("x"))
    return rows


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


# ------------------------------------------------------------ 11


def test_measures(docs):
    got = quality.text_measures(docs.select("doc_id", "text"), "text").collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got], [(d, *brute.quality_counts(t)) for d, t in ROWS])
    assert quality.text_measures(docs.select("doc_id", "text").filter("doc_id = 501"), "text", ["b", "a", "absent"]).first().n_flagged == 2


def binomial_tail(n, x, rate):
    p = Fraction(rate)
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(x + 1))


def test_exact_binomial_tail(spark):
    cases = [(n, x, rate) for rate in (0.05, 0.008) for n in (1, 7, 300, 2000) for x in (0, 1, 5, 12) if x <= n * rate]
    for rate in (0.05, 0.008):
        df = spark.createDataFrame([(n, x) for n, x, r in cases if r == rate], "n long, x long")
        for r in df.select("n", "x", quality.log_tail(F.col("n"), F.col("x"), rate).alias("p")).collect():
            assert r.p == pytest.approx(math.log(binomial_tail(r.n, r.x, rate)), abs=1e-8)
    assert spark.createDataFrame([(100, 50)], "n long, x long").select(quality.log_tail(F.col("n"), F.col("x"), 0.1)).first()[0] == 0
    big = spark.createDataFrame([(3_000_000, 20_000)], "n long, x long").select(quality.log_tail(F.col("n"), F.col("x"), 0.01)).first()[0]
    assert -3000 < big < -1000  # no underflow


def thresholds(rows, cutoffs, risk, error, cost):
    """Plain choice of cutoffs: rows of (stratum, good, learn, values)."""
    strata = {s for s, good, learn, _ in rows if good and not learn}
    out = {}
    for s in strata:
        for k, grid in enumerate(cutoffs):
            best = None
            holdout = [v[k] for t, good, learn, v in rows if t == s and good and not learn]
            for c in grid:
                x = sum(v >= c for v in holdout)
                if binomial_tail(len(holdout), x, risk / len(cutoffs)) > error / (len(strata) * len(cutoffs)):
                    break
                gain, loss = (sum(v[k] >= c for t, good, learn, v in rows if t == s and learn and good == g) for g in (False, True))
                worth = gain - cost * loss
                if worth > 0 and (best is None or worth > best[0]):
                    best = (worth, c)
            if best:
                out.setdefault(s, []).append((k, best[1]))
    return out


def test_thresholds_against_a_plain_choice(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(4000):
        s, good = rng.choice(["a", "a", "a", "b", None, "tiny" if rng.random() < 0.05 else "a"]), rng.random() < 0.8
        values = [int(rng.gauss(20 if good else 60, 12)), rng.choice([0, 0, 0, 7] if good else [0, 7, 9]), rng.choice([0, 1])]
        rows.append((s, good, rng.random() < 0.3, values))
    rows += [("only bad", False, False, [90, 9, 1])] * 20
    rules = [quality.Rule("first", "0", [90, 70, 60, 50, 40, 30]), quality.Rule("second", "0", [9, 8, 7]), quality.Rule("third", "0", [1])]
    df = spark.createDataFrame(rows, "stratum string, good boolean, learn boolean, values array<bigint>").repartition(3)
    tested = quality.certified(df, rules, 0.3, 0.05)
    got = {r.stratum: [tuple(c) for c in r.cutoffs] for r in quality.chosen(tested, 2).collect()}
    want = thresholds(rows, [r.cutoffs for r in rules], 0.3, 0.05, 2)
    assert got == want and set(got) >= {"a", None} and "tiny" not in got and "only bad" not in got
    assert tested.filter("stratum = 'a'").count() == 10


def test_false_rejections_stay_below_the_limit(spark):
    """Over many draws in which a measure says nothing, a limit is broken in at most the share of ``error``."""
    rng, broken, rate, runs = np.random.default_rng(3), 0, 0.1, 60
    rules = [quality.Rule("noise", "0", list(range(99, 0, -3)))]
    rows = [(f"r{k}", bool(rng.random() < 0.7), bool(rng.random() < 0.3), [int(rng.integers(0, 100))]) for k in range(runs) for _ in range(400)]
    df = spark.createDataFrame(rows, "stratum string, good boolean, learn boolean, values array<bigint>")
    for r in quality.certified(df, rules, rate, 0.05 * runs).filter("certified").groupBy("stratum").agg(F.min("cutoff").alias("c")).collect():
        broken += (100 - r.c) / 100 > rate
    assert broken <= 0.05 * runs + 3


def test_quality_rules(spark, docs):
    rng = random.Random(2)
    prose = lambda k: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(k))
    rows, labels = [], []
    for i in range(3000):
        bad, toxic, lang = i % 10 == 0, i % 10 == 1, ["en", None][i % 7 == 0]
        rows.append((i, (prose(60) if not bad else " # ".join(prose(60).split())) + (" slur" if toxic else ""), lang))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(10_000, None, "en"), (10_001, "", None), (10_002, "slur " + prose(60), "xx"), (10_003, "slur " + prose(60), "en"), (None, prose(60), "en"), (5, rows[5][1], "en")]
    labels += [(None, 1, 0), (4, None, 1), (77_777, 0, 0), (3, 1, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("kept", F.lit(1)).withColumn("stratum", F.lit(2))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.quality_rules(df, marks).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(by[i].kept == (i % 10 > 1) for i in range(3000) if i % 7)
    assert all(by[i].kept for i in range(0, 3000, 7))  # too few labels to certify anything
    assert by[10].rejected_by == "symbols,short_words" and by[1].rejected_by == "flagged"
    assert by[10_000].base_failed and by[10_001].base_failed and not by[10_000].kept
    assert by[10_002].kept and not by[10_003].kept and next(r for r in got if r.doc_id is None).kept
    again = quality.quality_rules(df, marks.limit(0)).collect()
    assert len(again) == len(rows) and all(r.kept == (not r.base_failed) for r in again)


def test_quality_rules_on_hard_rows_and_none(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = quality.quality_rules(docs.withColumn("lang", F.lit("en")), labels).collect()
    same([(r.doc_id, r.n_words, r.base_failed) for r in got], [(d, c[0], c[0] < 50 or 100 * c[4] > 50 * c[0]) for d, c in ((d, brute.quality_counts(t)) for d, t in ROWS)])
    assert quality.quality_rules(none, labels).count() == 0


# ------------------------------------------------------------ 12


@pytest.mark.parametrize("k", [1, 3, 50])
def test_ranked_search(spark, docs, k):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("item", F.lit(1)).withColumn("terms", F.lit(2))
    got = ranking.rank_documents(docs, items, k).collect()
    same(got, [(ITEMS[i][0], r, d, s) for i, r, d, s in brute.ranked(ROWS, ITEMS, k)])


def test_ranked_search_in_small_blocks_batches_and_groups(spark, docs, monkeypatch):
    for name, value in (("BLOCK_ROWS", 7), ("DOC_LEAF", 2), ("ITEM_LEAF", 2), ("FANOUT", 2), ("CELLS", 64), ("BATCH_ITEMS", 3), ("GROUP_TERMS", 40), ("EXACT", 0), ("TASK_ROWS", 20)):
        monkeypatch.setattr(ranking, name, value)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    same(ranking.rank_documents(docs, items, 4).collect(), [(ITEMS[i][0], r, d, s) for i, r, d, s in brute.ranked(ROWS, ITEMS, 4)])


def test_ranked_search_without_rows(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranking.rank_documents(none, items).count() == 0
    for empty in (items.limit(0), items.filter("text is null")):
        got = ranking.rank_documents(docs, empty)
        assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_most_pairs_are_never_scored():
    """Documents on other subjects than an item's fall away by the bounds of their nodes, and the result is that of all pairs."""
    rng = np.random.default_rng(4)
    n, subjects, size = 4096, 64, 20
    subject = np.sort(rng.integers(0, subjects, n))
    rows = [np.unique(np.concatenate([s * size + rng.integers(0, size, 12), subjects * size + rng.integers(0, 30, 3)])) for s in subject]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    terms, vals = np.concatenate(rows), rng.integers(100, 1000, ends[-1])
    own = [np.unique(np.concatenate([k % subjects * size + rng.integers(0, size, 6), subjects * size + rng.integers(0, 30, 2)])) for k in range(128)]
    flat = np.concatenate(own)
    items = ranking.Items(np.arange(128), np.concatenate([[0], np.cumsum([len(x) for x in own])]), flat, np.where(flat < subjects * size, 4000, 30))
    order = np.argsort([x[0] for x in own], kind="stable")
    floor, null = np.zeros(128, np.int64), np.zeros(n, bool)
    seed = ranking.Best(floor, 10)
    ranking.search_block(items, order, np.arange(n), null, ends, terms, vals, seed, True)
    best = ranking.Best(seed.score[-1].copy(), 10)
    scored = ranking.search_block(items, order, np.arange(n), null, ends, terms, vals, best, False)
    dense, weights = np.zeros((n, subjects * size + 30), np.int64), np.zeros((128, subjects * size + 30), np.int64)
    dense[np.repeat(np.arange(n), np.diff(ends)), terms] = vals
    weights[np.repeat(np.arange(128), np.diff(items.starts)), flat] = items.weights
    every = dense @ weights.T
    for i in range(128):
        want = sorted((-s, d) for d, s in enumerate(every[:, i]) if s > 0)[:10]
        assert [(-s, d) for s, d in zip(best.score[:, i], best.doc[:, i], strict=True) if s] == want
    assert scored < 0.1 * n * 128


# ------------------------------------------------------------ 13


def test_feature_hashes():
    texts = ["One two  THREE", "", "é" * 200 + " x " + "y" * 300 + " " + "z" * 127 + " " + "q" * 128, "a", "b c"]
    buf, offs = shared.text_buffers(pa.array(texts))
    for lo, hi in ((0, 5), (2, 5)):
        words = shared.Words(buf, offs[lo : hi + 1], shared.ALNUM, shared.LOWER)
        one, two = resampling.feature_hashes(words, shared.LOWER[buf[offs[lo] :]].tobytes(), int(offs[lo]))
        split = [brute.words(t) for t in texts[lo:hi]]
        assert one.tolist() == [zlib.crc32(w.encode()) for s in split for w in s]
        want = [zlib.crc32(f"{a} {b}".encode()) for s in split for a, b in zip(s, s[1:], strict=False)]
        assert two[words.left > 1].tolist() == want


@pytest.mark.parametrize("percent", [25, 100, 0])
def test_resampling(spark, docs, percent):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = resampling.resample(docs, items, percent=percent).collect()
    same(got, brute.resampled(ROWS, ITEMS, percent=percent))


def test_resampling_with_few_open_keys_and_ties(spark, monkeypatch):
    monkeypatch.setattr(resampling, "noisy", lambda weight, doc, seed: F.pmod(doc, F.lit(3)).cast("long"))
    rows = spark.range(5000).select((F.col("id") % 2500).alias("doc_id"), F.concat_ws(" ", *(F.lit(f"w{i}") for i in range(30))).alias("text")).repartition(7)
    got = resampling.resample(rows, rows.limit(3), open_keys=1).filter("rank is not null").orderBy("rank").collect()
    want = sorted((-(i % 3), i) for i in [*range(2500)] * 2)[:1250]
    assert [(-r.score, r.doc_id) for r in got] == want and [r["rank"] for r in got] == [*range(1, 1251)]


@pytest.mark.parametrize("spread", [3, 10**12])
def test_cutoff_at_every_place(spark, spread):
    rng = random.Random(9)
    keys = sorted((rng.randrange(-spread, spread), rng.randrange(2), rng.randrange(5), i) for i in range(300))
    df = spark.createDataFrame(rng.sample(keys, 300), "k0 long, k1 long, k2 long, k3 long").repartitionByRange(6, "k2")
    df = spark.createDataFrame(df.collect(), df.schema).repartition(6, "k2")
    for wanted in (0, 1, 2, 75, 150, 299, 300):
        assert resampling.cutoff(df, wanted, 4) == (keys[wanted - 1] if wanted else None)


def test_resampling_without_rows(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert resampling.resample(none, items).count() == 0
    same(resampling.resample(docs, items.limit(0)).collect(), brute.resampled(ROWS, []))
