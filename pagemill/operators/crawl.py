"""Crawls over captured pages and links: frontier joins in waves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.sources.shared import shared_folder


def crawl(
    seeds: DataFrame,
    links: DataFrame,
    pages: DataFrame,
    max_depth: int = 4,
    max_pages: int | None = None,
    min_words: int = 50,
    needs: list[str] | None = None,
    enough: int = 8,
    score: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Breadth-first crawl from ``seeds(crawl_id, page)``: ``crawl_id, page, depth``.

    A wave is the frontier joined with ``pages(page, words, digest)``: pages with too few words, and texts that the crawl has
    seen, are dropped and their links not followed (of equal texts in a wave the least page stays). Then it is joined with
    ``links(src, dst)`` or ``links(src, dst, score)``, without pages queued before; only scores over 0 are followed.
    With ``score``, a link's score is that of its address and the address of the crawl's seed, null for what is not followed; a crawl has one seed then.

    With ``max_pages`` a crawl queues as many pages as it has slots left, by their greatest score, then the least page. With
    ``needs``, boolean columns of ``pages``, a crawl stops from depth 1 on once it has ``enough`` pages and each need is met by one.

    The driver loops over at most ``max_depth`` waves and asks once in each whether a frontier is left. Everything is keyed by crawl
    and page, or added up before it is shuffled, so a page that all others link to or a crawl with a third of all pages is no task's own.
    Waves are checkpointed in the folder of ``spark.checkpoint.dir``; without one a local session gets its own, a cluster a ValueError.
    """
    shared_folder(seeds.sparkSession)
    scored = links if "score" in links.columns else links.withColumn("score", F.lit(1))
    signs = needs or []
    known = pages.select("page", "words", "digest", *signs)
    frontier = seeds.select("crawl_id", "page").distinct()
    bases = frontier.withColumnRenamed("page", "_base")
    visited, kept = frontier, None
    for depth in range(max_depth + 1):
        wave = frontier.join(known, "page").filter(F.col("words") >= min_words)
        first = F.struct("page", *signs)
        wave = wave.groupBy("crawl_id", "digest").agg(F.min_by(first, "page").alias("f")).select("crawl_id", "digest", "f.*", F.lit(depth).alias("depth"))
        if kept is not None:
            wave = wave.join(kept.select("crawl_id", "digest"), ["crawl_id", "digest"], "left_anti")
        wave = wave.checkpoint()
        kept = wave if kept is None else kept.unionByName(wave)
        if depth == max_depth:
            break
        go = wave.select("crawl_id", "page")
        state = kept.groupBy("crawl_id").agg(F.count("*").alias("_n"), *(F.max(F.coalesce(F.col(s), F.lit(False))).alias(s) for s in signs))
        stop = F.lit(False)
        if signs and depth >= 1:
            stop = F.col("_n") >= enough
            for s in signs:
                stop &= F.col(s)
        if max_pages:
            stop |= F.col("_n") >= max_pages
        if max_pages or signs:
            go = go.join(state.filter(stop), "crawl_id", "left_anti")
        if score:
            step = go.join(links.select("src", "dst"), go.page == F.col("src")).select("crawl_id", "dst").distinct().join(bases, "crawl_id")
            step = step.withColumn("score", score(F.col("dst"), F.col("_base"))).filter("score > 0")
        else:
            step = go.join(scored.filter("score > 0"), go.page == scored.src)
        found = step.groupBy("crawl_id", F.col("dst").alias("page")).agg(F.max("score").alias("score"))
        frontier = found.join(visited, ["crawl_id", "page"], "left_anti")
        if max_pages:
            # the constant bound lets Spark keep the best of each task before the shuffle; the slots left cut further
            place = F.row_number().over(Window.partitionBy("crawl_id").orderBy(F.desc("score"), "page"))
            frontier = frontier.withColumn("_place", place).filter(F.col("_place") <= max_pages).join(state.select("crawl_id", "_n"), "crawl_id")
            frontier = frontier.filter(F.col("_place") <= max_pages - F.col("_n"))
        frontier = frontier.select("crawl_id", "page").checkpoint()
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return kept.select("crawl_id", "page", "depth")


def crawl_depths(crawled: DataFrame) -> DataFrame:
    """Of each crawl: ``n`` pages, the distinct ``depths`` in order and ``max_depth``. Depths are few, so the lists are short."""
    return crawled.groupBy("crawl_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("depth")).alias("depths"), F.max("depth").alias("max_depth"))


def rescanned(pages: DataFrame, found: DataFrame, within: str, most: int = 5, attempts: int = 15, raw_words: int = 100, clean_words: int = 50) -> DataFrame:
    """Pages of a scrape with those of a targeted re-scan after them (``rescan`` true).

    ``found`` has the columns of ``pages`` and ``place`` (order of the candidates, from 0), ``status_code``, ``raw_words`` and
    ``words``. Only the first ``attempts`` candidates are tried; a page with status under 400 and enough words is new, and the first ``most`` stay.
    """
    good = found.filter((F.col("place") < attempts) & (F.col("status_code") < 400) & (F.col("raw_words") >= raw_words) & (F.col("words") >= clean_words))
    nth = F.row_number().over(Window.partitionBy(within).orderBy("place"))
    new = good.withColumn("_n", nth).filter(F.col("_n") <= most).select(*pages.columns, F.lit(True).alias("rescan"))
    return pages.withColumn("rescan", F.lit(False)).unionByName(new)
