"""Which links a crawl follows, what it has reached, and which tier's result is taken."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.lexicon import (
    BROAD_SKIPPED,
    BROAD_WORDS,
    CRITICAL,
    FIELD_WORDS,
    NARROW_SKIPPED,
    NARROW_WORDS,
    PROGRAM_PATHS,
    PROGRAM_WORDS,
    SEMESTER_PATHS,
    SITE_WIDE,
    SUBPAGES,
)
from pagemill.functions.text import let
from pagemill.functions.urls import link_key

def _any(x: Column, words: list[str]) -> Column:
    return x.rlike("|".join(re.escape(w) for w in words))


def _hits(x: Column, words: list[str]) -> Column:
    """How many of the words are found."""
    return let(x, lambda t: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: t.contains(w))))


def _parts(url: Column) -> tuple[Column, Column]:
    bare = F.regexp_replace(url, "[?#].*$", "")
    return F.regexp_extract(bare, "^[A-Za-z]+://([^/]*)", 1), F.regexp_replace(F.regexp_extract(bare, "^[A-Za-z]+://[^/]*(.*)$", 1), "/+$", "")


def catalogue_link(link: Column, start: Column) -> Column:
    """Whether a link leads to a course catalogue, to another year's copy of the start page, or to a semester's list."""
    _, path = _parts(link)
    _, own = _parts(start)
    tail = F.regexp_extract(own, r"^/\d{4}(/.+)$", 1)
    rest = F.regexp_extract(path, r"^/\d{4}(/.*)$", 1)
    copy = (tail != "") & ((rest == tail) | rest.startswith(F.concat(tail, F.lit("/")))) & ~F.regexp_replace(link, "/+$", "").endswith(F.regexp_replace(own, "^/", ""))
    return link.rlike(r"/\d{4}/course/") | copy | _any(link, SEMESTER_PATHS)


def broad_score(link: Column, base: Column) -> Column:
    """Score in a crawl of a whole site: 10 for site-wide pages, 2 a word below the base path, 1 a word on pages that name the programme; null: not followed."""
    host, path = _parts(link)
    own_host, own = _parts(base)
    low = F.lower(link)
    name = F.regexp_replace(F.element_at(F.split(own, "/"), -1), r"\.html|\.htm", "")
    words = _hits(low, BROAD_WORDS)
    points = F.when(_any(low, SITE_WIDE), F.lit(10)).when(path.contains(own), words * 2).when((name != "") & low.contains(name), words).otherwise(0)
    skip = (host != own_host) | _any(low, BROAD_SKIPPED) | (F.regexp_replace(link, "/+$", "") == F.regexp_replace(base, "/+$", ""))
    return F.when(~skip & (points > 0), points)


def narrow_score(link: Column, base: Column) -> Column:
    """Score in a crawl below a page: 3 a word; null: not followed."""
    host, path = _parts(link)
    own_host, own = _parts(base)
    points = _hits(F.lower(link), NARROW_WORDS) * 3
    skip = (host != own_host) | ~path.startswith(own) | _any(F.lower(link), NARROW_SKIPPED)
    return F.when(~skip & (points > 0), points)


def subpages(base: Column) -> Column:
    """Addresses that programme pages often have."""
    host, path = _parts(base)
    return F.transform(F.array(*map(F.lit, SUBPAGES)), lambda s: F.concat(F.lit("https://"), host, path, s))


def program_link(link: Column, words: list[str] = PROGRAM_PATHS) -> Column:
    return _any(F.lower(link), words)


def reached(pages: DataFrame, crawl: str, url: str = "url", enough: int = 15, critical: dict[str, list[str]] | None = None) -> DataFrame:
    """For each crawl which critical pages it has, and whether it may stop."""
    critical = critical or CRITICAL
    flags = pages.groupBy(crawl).agg(F.count("*").alias("n"), *(F.bool_or(_any(F.lower(F.col(url)), words)).alias(name) for name, words in critical.items()))
    stop = F.col("n") >= enough
    for name in critical:
        stop &= F.col(name)
    return flags.withColumn("stop", stop)


def waterfall(pages: DataFrame, seed: str, tier: str = "tier", main: str = "is_main", words: str = "word_count", least: int = 200) -> DataFrame:
    """All pages of the first tier whose main page has enough words; seeds without one have no rows."""
    good = pages.filter(F.col(main) & (F.col(words) >= least)).groupBy(seed).agg(F.min(tier).alias("_tier"))
    return pages.join(good, seed).filter(F.col(tier) == F.col("_tier")).drop("_tier")


def fetch_by_tiers(fetches: DataFrame, url: str = "url", words: int = 200) -> DataFrame:
    """One row per URL: that of the first tier with content and enough words; where none has, method ``all_failed``, tier 0 and an error.

    ``fetches`` has ``tier``, ``method``, ``content`` and ``word_count``; of several good rows of a tier the one with most words counts.
    """
    good = (F.col("content") != "") & (F.col("word_count") >= words)
    best = F.min_by(F.when(good, F.struct("tier", "method", "content", "word_count")), F.when(good, F.struct("tier", (-F.col("word_count")).alias("w"), "content")))
    failed = F.struct(F.lit(0).alias("tier"), F.lit("all_failed").alias("method"), F.lit("").alias("content"), F.lit(0).alias("word_count"))
    rows = fetches.groupBy(url).agg(best.alias("b")).select(url, F.col("b").isNull().alias("_none"), F.coalesce(F.col("b"), failed.cast(fetches.select(F.struct("tier", "method", "content", "word_count").alias("b")).schema["b"].dataType)).alias("b"))
    return rows.select(url, "b.*", F.when(F.col("_none"), "All tiers failed").alias("error"))


#: Sources of program links: a site map first, then the crawl, then the browser.
DISCOVERY_ORDER = (2, 1, 3)


def discovered(links: DataFrame, site: str, tier: str = "tier", order: tuple[int, ...] = DISCOVERY_ORDER) -> DataFrame:
    """The links of each site's first source, in ``order``, that has any; sites without links have no rows."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(tier))
    first = links.filter(place > 0).groupBy(site).agg(F.min(place).alias("_first"))
    return links.join(first, site).filter(place == F.col("_first")).drop("_first").distinct()


def new_candidates(candidates: DataFrame, pages: DataFrame, by: str, url: str = "url") -> DataFrame:
    """Candidates (``by``, ``url``) that no page of the same group has, up to case and trailing slash."""
    seen = pages.select(by, link_key(F.col(url)).alias("_key")).distinct()
    return candidates.withColumn("_key", link_key(F.col(url))).join(seen, [by, "_key"], "left_anti").drop("_key")


def fields_in_pages(pages: DataFrame, by: str, url: str = "url", content: str = "content", pos: str = "pos", words: dict[str, list[str]] | None = None, least: int = 2) -> DataFrame:
    """For each group and field the first page that holds at least ``least`` of the field's words."""
    low = F.lower(F.coalesce(F.col(content), F.lit("")))
    fields = F.array(*(F.when(_hits(low, w) >= least, F.lit(f)) for f, w in (words or FIELD_WORDS).items()))
    hits = pages.withColumn("field", F.explode(F.filter(fields, lambda f: f.isNotNull())))
    return hits.groupBy(by, "field").agg(F.min_by(url, pos).alias("found_in"))


def step_of(elapsed: Column, ends: list[float]) -> Column:
    """Number of the first step that ends after ``elapsed``; the last one beyond."""
    later = F.filter(F.transform(F.array(*map(F.lit, ends)), lambda e, i: F.when(e > elapsed, i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(later, 0), F.lit(len(ends) - 1))


def display_value(value: Column, note: str = "— not found") -> Column:
    """The text shown for a value: a note for null, empty text and the text "null"."""
    return F.when(value.isNull() | value.isin("", "null"), note).otherwise(value)


def file_slug(name: Column) -> Column:
    """A file name part: lower case, runs of other characters than letters and digits as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9_]", "_"), "__+", "_")


def local_time(ts: Column, zone: str = "Asia/Kolkata", label: str = "IST") -> Column:
    return F.concat(F.date_format(F.from_utc_timestamp(ts, zone), "MMM dd, yyyy, HH:mm:ss"), F.lit(f" {label}"))
