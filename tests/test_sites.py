"""Composed crawls against plain queues over hand-written sites, and calls that wait for each other against a loop."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagemill.operators import history, sitecrawl

LONG = "word " * 60
PAGES = "url string, html string, content string"


def site(spark, rows):
    return spark.createDataFrame([("https://u.edu" + u, h, c) for u, h, c in rows], PAGES)


def seeds(spark, *paths):
    return spark.createDataFrame([(k, "https://u.edu" + p) for k, p in enumerate(paths)], "crawl_id int, page string")


def found(df):
    return sorted((r.crawl_id, r.page.removeprefix("https://u.edu"), r.depth) for r in df.collect())


def test_broad_crawl_follows_scored_links_of_all_sources(spark):
    rows = [
        ("/zoo", """<a href='/zoo/fees-x?y=1'>a</a> <a href=/tuition-and-fees>b</a> <a href="/zoo/news-fees">c</a> <a href="https://o.org/zoo/fees">d</a> <a href="/q/fees">e</a>""", LONG + "[x](https://u.edu/zoo/apply) https://u.edu/zoo/ielts."),
        ("/zoo/fees-x", '<a href="/zoo/deadline">x</a>', LONG + "1"),
        ("/tuition-and-fees", None, LONG + "2"),
        ("/zoo/news-fees", None, LONG + "3"),  # skipped word
        ("/q/fees", None, LONG + "4"),  # neither below the base nor named after it
        ("/zoo/apply", "", LONG + "5"),
        ("/zoo/ielts", "", LONG + "5"),  # the same text as /zoo/apply
        ("/zoo/overview", "", LONG + "6"),  # only made from the address
        ("/zoo/deadline", "", LONG + "7"),
        ("/zoo/structure", "", None),  # no text
        ("/zoo/modules", "", "too short"),
    ]
    got = found(sitecrawl.broad_crawl(seeds(spark, "/zoo"), site(spark, rows), max_depth=3, max_pages=300))
    assert got == [(0, "/tuition-and-fees", 1), (0, "/zoo", 0), (0, "/zoo/apply", 1), (0, "/zoo/deadline", 2), (0, "/zoo/fees-x", 1), (0, "/zoo/overview", 1)]


def test_broad_crawl_ends_early(spark):
    rows = [("/p", '<a href="/p/course-1">x</a>', LONG), ("/p/fees", "", LONG + "1"), ("/p/english-language", "", LONG + "2"), ("/p/entry-requirements", "", LONG + "3"), ("/p/course-1", '<a href="/p/course-2">x</a>', LONG + "4"), ("/p/course-2", "", LONG + "5")]
    table = site(spark, rows)
    assert (0, "/p/course-2", 2) in found(sitecrawl.broad_crawl(seeds(spark, "/p"), table, max_pages=300, enough=6))
    assert (0, "/p/course-2", 2) not in found(sitecrawl.broad_crawl(seeds(spark, "/p"), table, max_pages=300, enough=5))
    assert len(found(sitecrawl.broad_crawl(seeds(spark, "/p"), table, max_pages=1))) == 1


FEES, LESS = "Fees for all " + LONG * 2, "Fees for home students " + LONG * 2


@pytest.mark.parametrize(
    ("rows", "added"),
    [
        # the first address of the site that has a page; one that is missing or short does not count
        ([("/english-language-requirements", "", "Page not found " + LONG * 2), ("/study/english-language-requirements", "", LONG), ("/admissions/english-language", "", "a404 " + LONG * 2), ("/find/english-language-requirements", "", LONG * 3)], ["/admissions/english-language"]),
        # a page on English is there already
        ([("/p/english-requirements", "", LONG + "e"), ("/study/english-language-requirements", "", LONG * 2)], []),
        # the view for international students, as no page on fees tells of them
        ([("/p/fees", "", LESS), ("/p/fees?view=international", "", FEES)], ["/p/fees?view=international"]),
        # the view has the text that the crawl has, is too short, or a page tells of them
        ([("/p/fees", "", LESS), ("/p/fees?view=international", "", LESS)], []),
        ([("/p/fees", "", LESS), ("/p/fees?view=international", "", LONG)], []),
        ([("/p/fees", "", "International fees " + LONG), ("/p/fees?view=international", "", FEES)], []),
        # no page on fees: no view of it
        ([("/p/fees?view=international", "", FEES)], []),
    ],
)
def test_passes_after_a_narrow_crawl(spark, rows, added):
    got = found(sitecrawl.narrow_crawl(seeds(spark, "/p"), site(spark, [("/p", "", "404 is the seed's own " + LONG), *rows])))
    assert [p for _, p, d in got if d == sitecrawl.ADDED] == added


def test_passes_need_slots_and_stay_with_their_crawl(spark):
    rows = [("/p", "", LONG), ("/q", "", LONG + "q"), ("/q/english-requirements", "", LONG + "e"), ("/study/english-language-requirements", "", LONG * 2), ("/p/fees", "", "404 " + LONG)]
    assert found(sitecrawl.narrow_crawl(seeds(spark, "/p", "/q", "/none"), site(spark, rows))) == [(0, "/p", 0), (0, "/study/english-language-requirements", 99), (1, "/q", 0), (1, "/q/english-requirements", 1)]
    assert found(sitecrawl.narrow_crawl(seeds(spark, "/p"), site(spark, rows), max_pages=1)) == [(0, "/p", 0)]
    empty = spark.createDataFrame([], PAGES)
    assert found(sitecrawl.narrow_crawl(seeds(spark, "/p"), empty)) == found(sitecrawl.broad_crawl(seeds(spark, "/p"), empty)) == []


def one_by_one(calls, seconds, most, gap, cooldown):
    """The limiter as it runs: the oldest call in the window, the gap, and the call before."""
    out, state = {}, {}
    for number, key, at, good, took in sorted(calls, key=lambda c: (c[2], c[0])):
        begun, free = state.get(key, ([], 0))
        now = max(at, free)
        recent = [b for b in begun if b >= now - seconds]
        if len(recent) >= most:
            now = max(now, recent[0] + seconds)
        if begun:
            now = max(now, begun[-1] + gap)
        state[key] = ([*begun, now], now + (took or 0) + (cooldown if good else 0))
        out[number] = (now, now - at)
    return out


@pytest.mark.parametrize("block", [50, 86_400])
def test_calls_wait_for_each_other(spark, block):
    rng = random.Random(5)
    start = datetime(2024, 1, 1, tzinfo=UTC)
    # a key with most calls, calls of one instant, calls that take long
    calls = [(i, rng.choice("aaab"), rng.randrange(0, 4000) if i % 4 else 100, rng.random() < 0.7, rng.choice([None, 0.0, 5.0, 90.0])) for i in range(160)]
    table = spark.createDataFrame([(i, k, start + timedelta(seconds=at), g, t, "x") for i, k, at, g, t in calls], "id int, key string, ts timestamp, good boolean, took double, called_us string").withColumnRenamed("called_us", "more")
    got = history.paced_calls(table, "key", "ts", "id", block=block)
    base = int(start.timestamp()) * 1_000_000
    assert {r.id: ((r.called_us - base) / 1e6, r.wait) for r in got.collect()} == one_by_one(calls, 60, 3, 20, 10)
    nobody = table.withColumn("key", F.lit(None).cast("string"))
    assert {(r.called_us, r.wait) for r in history.paced_calls(nobody, "key", "ts", "id").collect()} == {(None, None)}
    assert history.paced_calls(table.limit(0), "key", "ts", "id").count() == 0
    with pytest.raises(ValueError, match="gap"):
        history.paced_calls(table, "key", "ts", "id", gap=5)
