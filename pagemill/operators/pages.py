"""Operators on tables of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import lexicon as L
from pagemill.functions.markup import anchors
from pagemill.functions.text import page_type, word_count
from pagemill.functions.urls import absolute_url, base_parts, host, is_pdf, let, link_key, link_score


def presence(text: Column, words: list[str]) -> Column:
    """How many of the words are in a text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((low.contains(w).cast("int") for w in words), F.lit(0))


def blocked(html: Column, signs: list[str] = L.ANTI_BOT) -> Column:
    """Whether a page shows at least two signs of a bot check."""
    return presence(html, signs) >= 2


def soft_404(text: Column, signs: list[str] = L.SOFT_404, head: int = 500) -> Column:
    """Whether the head of a text says that the page is missing."""
    return presence(F.substring(text, 1, head), signs) > 0


def useful_pages(pages: DataFrame, text: str = "content", words: int = L.MIN_PAGE_WORDS) -> DataFrame:
    """Pages with enough words that are no error pages."""
    return pages.filter((word_count(F.col(text)) >= words) & ~soft_404(F.col(text)))


def first_copies(rows: DataFrame, text: str, order: str, within: list[str]) -> DataFrame:
    """The first row of each text within a group. The digest is first reduced to one row each, so that copies do not gather in a task."""
    key = [*within, "_digest"]
    marked = rows.withColumn("_digest", F.md5(F.coalesce(F.col(text), F.lit(""))))
    first = marked.groupBy(*key).agg(F.min(order).alias("_first"))
    return marked.join(first, key).filter(F.col(order) == F.col("_first")).drop("_digest", "_first")


def page_links(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """Links of each page: ``key, base, pos, target, link_text`` within the same site, no PDFs, not to itself, each target once (its first place).

    ``pos`` counts the anchors of the page that have an address (``functions.markup.anchors``). All of it is worked out inside the page's own array of anchors, before links become rows, so nothing is shuffled.
    """

    def link(anchor: Column, pos: Column, base: Column) -> Column:
        return let(
            absolute_url(anchor["href"], base["parts"]),
            lambda t: F.struct(pos.alias("pos"), t.alias("target"), anchor["text"].alias("link_text"), link_key(t).alias("key"), (host(t) == base["host"]).alias("near"), is_pdf(t).alias("pdf")),
        )

    def links(base: Column) -> Column:
        found = F.transform(anchors(F.col(html)), lambda a, i: link(a, i, base))
        good = F.filter(found, lambda x: x["target"].isNotNull() & ~x["target"].contains("#") & x["near"] & ~x["pdf"] & (x["key"] != base["key"]))
        first = lambda g, keys: F.transform(F.array_distinct(keys), lambda k: F.get(g, (F.array_position(keys, k) - 1).cast("int")))
        return let(good, lambda g: let(F.transform(g, lambda x: x["key"]), lambda keys: first(g, keys)))

    base = F.struct(base_parts(F.col(url)).alias("parts"), host(F.col(url)).alias("host"), link_key(F.col(url)).alias("key"))
    rows = pages.select(key, F.col(url).alias("base"), F.explode(let(base, links)).alias("a"))
    return rows.select(key, "base", "a.pos", "a.target", "a.link_text")


def page_pdfs(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id", most: int = L.MAX_PDFS) -> DataFrame:
    """``key, pos, pdf_url``: the first PDFs that a page's anchors lead to, each once, on any site; pages without any have no row."""
    found = lambda base: F.filter(F.transform(anchors(F.col(html)), lambda a: absolute_url(a["href"], base)), lambda t: t.isNotNull() & is_pdf(t))
    first = F.slice(F.array_distinct(let(base_parts(F.col(url)), found)), 1, most)
    return pages.select(key, F.posexplode(first).alias("pos", "pdf_url"))


def listed_pages(pages: DataFrame, within: str, most: int = L.LISTED_PAGES) -> DataFrame:
    """``within, listed``: the first pages by ``pos`` as lines ``- url (page_type)``, as a prompt on gaps lists them.

    The rank's limit holds before the shuffle, so a scrape sends at most ``most`` rows from each task.
    """
    place = F.row_number().over(Window.partitionBy(within).orderBy("pos"))
    first = pages.select(within, "pos", "url", "page_type").withColumn("_n", place).filter(F.col("_n") <= most)
    line = F.concat(F.lit("- "), F.coalesce("url", F.lit("unknown")), F.lit(" ("), F.coalesce("page_type", F.lit("unknown")), F.lit(")"))
    lines = first.groupBy(within).agg(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))).alias("l"))
    return lines.select(within, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("listed"))


def top_links(links: DataFrame, key: str = "page_id", most: int = L.MAX_SUBPAGES) -> DataFrame:
    """The best-scored links of each page: ``rank`` from 1, ties by place."""
    scored = links.withColumn("score", link_score(F.col("target"), F.col("link_text"))).filter("score >= 1")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "pos"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= most)


def best_fetch(fetches: DataFrame, url: str = "url", order: str | None = None, words: int = 200) -> DataFrame:
    """One fetch per URL: a blocked one of the first kind that was tried if there is any, as that ends the attempts; else good ones
    (status under 400, enough words) first, then by tier, then by ``order``. Fetches are reduced before the shuffle.

    ``fetches`` has ``tier``, ``status_code`` and ``word_count``, and may have ``blocked``.
    """
    stopped = F.coalesce(F.col("blocked"), F.lit(False)) & (F.col("tier") == 1) if "blocked" in fetches.columns else F.lit(False)
    good = (F.col("status_code") < 400) & (F.col("word_count") >= words)
    rest = [c for c in fetches.columns if c != url]
    rank = [(~stopped).alias("a"), (~good).alias("b"), F.col("tier").alias("c"), *([F.col(order).alias("d")] if order else [])]
    best = fetches.groupBy(url).agg(F.min_by(F.struct(*rest), F.struct(*rank)).alias("_f"))
    return best.select(url, "_f.*")


def page_label(url: Column, page_type: Column, main: Column) -> Column:
    """What a page is called in a context: MAIN PAGE, else its last path segment and type in upper case."""
    parts = F.split(url, "/")
    name = F.coalesce(F.nullif(F.try_element_at(parts, F.lit(-1)), F.lit("")), F.nullif(F.try_element_at(parts, F.lit(-2)), F.lit("")), url)
    return F.when(main, "MAIN PAGE").otherwise(F.upper(F.concat(name, F.lit(" ("), page_type, F.lit(")"))))


def label_pages(pages: DataFrame, within: str, page_id: str = "page_id") -> DataFrame:
    """Add ``label``; the first page of each group is the main one. A given ``page_type`` is kept, an absent one found."""
    first = pages.groupBy(within).agg(F.min(page_id).alias("_first"))
    found = page_type(F.col("url"), F.col("content"))
    kind = F.coalesce(F.nullif(F.col("page_type"), F.lit("")), found) if "page_type" in pages.columns else found
    return pages.join(first, within).withColumn("label", page_label(F.col("url"), kind, F.col(page_id) == F.col("_first"))).drop("_first")


def markdown_of(raw: Column, fit: Column, text: Column) -> Column:
    """The first of a crawler's texts that is not empty: raw markdown, fitted markdown, plain text; null without any."""
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in (raw, fit, text)))


def link_sources(pages: DataFrame, key: str = "page_id", suffixes: list[str] = L.KNOWN_SUFFIXES, site_paths: list[str] = L.SITE_PATHS) -> DataFrame:
    """``key, source, link``: absolute links of a page by where they come from, each once: anchors of ``html``, markdown links and bare
    addresses of ``content``, and addresses made from the page's own. Null texts have none."""
    site = F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract("url", "^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    parts = base_parts(F.col("url"))
    none = F.array().cast("array<string>")
    sources = {
        "html": let(parts, lambda p: F.transform(anchors(F.col("html")), lambda a: absolute_url(a["href"], p))),
        "markdown": F.regexp_extract_all("content", F.lit(r"\[[^\]]*\]\((https?://[^\)]+)\)"), F.lit(1)),
        "bare": F.transform(F.regexp_extract_all("content", F.lit(r"(?<!\()https?://[^\s\)>]+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,)]+$", "")),
        "made": F.array(*(F.concat(F.lit("https://"), site, path, F.lit(x)) for x in suffixes), *(F.concat(F.lit("https://"), site, F.lit(x)) for x in site_paths)),
    }

    def named(name: str, found: Column) -> Column:
        return F.transform(F.filter(F.coalesce(found, none), lambda u: u.isNotNull()), lambda u: F.struct(F.lit(name).alias("source"), u.alias("link")))

    found = [named(n, v) for n, v in sources.items()]
    return pages.select(key, F.explode(F.array_distinct(F.concat(*found))).alias("l")).select(key, "l.source", "l.link")
