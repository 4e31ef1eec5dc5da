"""Crawls composed of captured pages: their own links, scores against the seed, slots, and passes for what is still missing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import lexicon as L
from pagemill.operators.crawl import crawl
from pagemill.operators.frontier import broad_score, narrow_score, subpages
from pagemill.operators.pages import link_sources, presence, soft_404
from pagemill.sources.shared import shared_folder

#: Depth of pages that a pass after the crawl has added.
ADDED = 99


def _named(url: Column, words: list[str]) -> Column:
    return F.lower(url).rlike("|".join(re.escape(w) for w in words))


def _known(pages: DataFrame, **signs: Column) -> DataFrame:
    """``page, words, digest`` of captures and signs of their texts, worked out in one pass over them; null texts have no words and are never followed."""
    text = F.coalesce("content", F.lit(""))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return pages.select(F.col("url").alias("page"), words.alias("words"), F.md5(text).alias("digest"), *(c.alias(n) for n, c in signs.items())).checkpoint()


def site_links(pages: DataFrame, suffixes: list[str] = L.KNOWN_SUFFIXES, site_paths: list[str] = L.SITE_PATHS) -> DataFrame:
    """``src, dst``: the links of each page by ``link_sources``, without query, fragment and trailing slash, each once.

    A page's links are told apart in its own row; nothing is shuffled.
    """
    bare = F.regexp_replace(F.regexp_replace("link", "[?#].*$", ""), "/+$", "")
    return link_sources(pages, "url", suffixes, site_paths).select(F.col("url").alias("src"), bare.alias("dst"))


def broad_crawl(seeds: DataFrame, pages: DataFrame, max_depth: int = 4, max_pages: int = 50, needs: dict[str, list[str]] | None = None, enough: int = 8) -> DataFrame:
    """Crawl of whole sites from ``seeds(crawl_id, page)`` over ``pages(url, html, content)``: ``crawl_id, page, depth``.

    Followed are anchors, links of the text and addresses made from the page's own, by ``broad_score`` against the seed. A crawl ends early once the
    addresses of its pages meet all ``needs``. ``pages`` has one row for an address; addresses that nobody captured take a slot and give no page.
    """
    needs = L.CRAWL_NEEDS if needs is None else needs
    shared_folder(seeds.sparkSession)
    known = _known(pages, **{n: _named(F.col("url"), words) for n, words in needs.items()})
    return crawl(seeds, site_links(pages).checkpoint(), known, max_depth, max_pages, needs=list(needs), enough=enough, score=broad_score)


def narrow_crawl(seeds: DataFrame, pages: DataFrame, max_depth: int = 4, max_pages: int = 50, least: int = 100) -> DataFrame:
    """Crawl below each seed, then two passes for what it lacks: ``crawl_id, page, depth``, added pages at depth ``ADDED``.

    Links come from the pages, by ``narrow_score`` against the seed, and from ``subpages`` of the seed. Pages whose head says that they are missing
    are dropped, but for the seed. Crawls that have slots left but no page with ``english`` or ``language`` in its address get the first of the site's
    ``ENGLISH_PATHS`` that was captured with ``least`` words. Those that have slots left, an address that ends with ``/fees`` and no page on fees of
    international students get the capture under ``?view=international`` beside it, unless the crawl has its text already; of several such addresses
    that of least depth counts, then the least.

    Pages are taken apart once, and their links and digests checkpointed. A pass works on the crawls that need it only; each is a chain of joins by crawl or address, after what decides is added up by crawl.
    """
    shared_folder(seeds.sparkSession)
    text, low = F.col("content"), F.lower(F.coalesce("content", F.lit("")))
    site_page = [s for s in L.NARROW_SOFT_404 if s != "404"]  # a site's own page may show the number
    told = F.substring(low, 1, 2000).contains("international") & (presence(text, L.FEE_SIGNS) > 0)
    known = _known(pages, gone=soft_404(text, L.NARROW_SOFT_404), lost=soft_404(text, site_page), told=told & F.lower("url").contains("fee"))
    whole = known.join(seeds.select("page", F.lit(True).alias("_seed")).distinct(), "page", "left").filter(~F.coalesce("gone", F.lit(False)) | F.col("_seed"))
    made = seeds.select(F.col("page").alias("src"), F.explode(subpages(F.col("page"))).alias("dst"))
    links = site_links(pages, [], []).unionByName(made).checkpoint()
    kept = crawl(seeds, links, whole, max_depth, max_pages, score=narrow_score).checkpoint()

    site = F.regexp_extract("page", "^[A-Za-z]+://([^/?#]*)", 1)
    size = kept.groupBy("crawl_id").agg(F.count("*").alias("_n"), F.bool_or(_named(F.col("page"), ["english", "language"])).alias("_has"))
    open_ones = size.filter((F.col("_n") < max_pages) & ~F.col("_has")).join(seeds, "crawl_id").select("crawl_id", site.alias("_site"))
    tried = open_ones.select("crawl_id", "_site", F.posexplode(F.array(*map(F.lit, L.ENGLISH_PATHS))).alias("_place", "_path"))
    tried = tried.select("crawl_id", "_place", F.concat(F.lit("https://"), "_site", "_path").alias("page"))
    good = known.filter((F.col("words") >= least) & ~F.coalesce("lost", F.lit(False))).select("page")
    english = tried.join(good, "page").join(kept.select("crawl_id", "page"), ["crawl_id", "page"], "left_anti")
    english = english.groupBy("crawl_id").agg(F.min_by("page", "_place").alias("page")).withColumn("depth", F.lit(ADDED)).checkpoint()

    with_english = kept.unionByName(english)
    have = with_english.join(known.filter("told").select("page"), "page").select("crawl_id").distinct()
    at = with_english.filter(F.regexp_replace("page", "/+$", "").endswith("/fees")).groupBy("crawl_id").agg(F.min_by("page", F.struct("depth", "page")).alias("_fees"))
    slots = with_english.groupBy("crawl_id").agg(F.count("*").alias("_n")).filter(F.col("_n") < max_pages)
    view = at.join(slots, "crawl_id").join(have, "crawl_id", "left_anti").select("crawl_id", F.concat("_fees", F.lit("?view=international")).alias("page"))
    view = view.join(known.filter(F.col("words") >= least), "page")
    texts = kept.join(known, "page").select("crawl_id", "digest")
    view = view.join(texts, ["crawl_id", "digest"], "left_anti").select("crawl_id", "page", F.lit(ADDED).alias("depth"))
    return with_english.unionByName(view)
