"""Relevance of pages for groups of fields, bounded contexts, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import lexicon as L


def _any(text: Column, words: list[str]) -> Column:
    return F.greatest(*(text.contains(w) for w in words)) if len(words) > 1 else text.contains(words[0])


def relevance(group: str, url: Column, page_type: Column, content: Column) -> Column:
    """Score of a page for a group: page type, URL signs and keywords on a base of 50; 0 at least."""
    url, content = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(content, F.lit("")))
    by_type = F.lit(0)
    for name, points in L.TYPE_SCORES.get(group, {}).items():
        by_type = F.when(page_type == name, points).otherwise(by_type)
    points = F.lit(L.RELEVANCE_BASE) + by_type
    if group == "tuition_fees":
        points += F.when(_any(url, L.TUITION_URLS), L.FEE_URL_POINTS).otherwise(0)
        made_up = url.endswith(".html/fees") | _any(url, L.CONSTRUCTED_URLS)
        points += F.when(made_up, L.MADE_UP_POINTS).when(_any(url, L.AID_URLS), L.AID_POINTS).otherwise(0)
    for words, worth, else_worth in L.URL_SIGNS:
        points += F.when(_any(url, words), worth.get(group, else_worth)).otherwise(0)
    points += L.KEYWORD_POINTS * sum((content.contains(w).cast("int") for w in L.GROUP_KEYWORDS.get(group, [])), F.lit(0))
    return F.greatest(points, F.lit(0))


def score_pages(pages: DataFrame, groups: list[str] = L.GROUPS) -> DataFrame:
    """A row for each page and group with ``field_group`` and ``score``; narrow, as the groups are a fixed list."""
    scores = F.array(*(F.struct(F.lit(g).alias("field_group"), relevance(g, F.col("url"), F.col("page_type"), F.col("content")).alias("score")) for g in groups))
    return pages.withColumn("_s", F.explode(scores)).select(*pages.columns, "_s.field_group", "_s.score")


def pack_contexts(scored: DataFrame, within: str, contents: DataFrame | None = None, budgets: dict[str, int] = L.GROUP_BUDGETS, threshold: int = L.RELEVANCE_THRESHOLD) -> DataFrame:
    """The best pages of each (``within``, field group) up to the group's characters: ``context``, ``pages``.

    Pages come by score, then ``pos``. The first that does not fit is cut if over 500 characters remain
    for it, and ends the context; so does a remainder of 500 or less.

    Places are found on rows without contents; these come in for the pages kept, from ``contents`` (``within, pos, content``;
    by default from ``scored`` itself).
    """
    keys = [within, "field_group"]
    header = F.concat(F.lit("\n--- "), F.upper("page_type"), F.lit(" (score:"), F.col("score").cast("string"), F.lit(") | "), F.col("url"), F.lit(" ---\n"))
    budget = F.lit(8000)
    for g, n in budgets.items():
        budget = F.when(F.col("field_group") == g, n).otherwise(budget)
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "pos")
    if contents is None:
        contents = scored.select(within, "pos", "content").dropDuplicates([within, "pos"])
    rows = scored.filter(F.col("score") >= threshold)
    rows = rows.select(*keys, "score", "pos", header.alias("_header"), F.coalesce(F.length("content"), F.lit(0)).alias("_length"), budget.alias("_budget"))
    size = F.length("_header") + F.col("_length")
    rows = rows.withColumn("_before", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["_before"])
    # pages before the first one that does not fit, and that one
    free = F.col("_budget") - F.col("_before")
    fits = size <= free
    rows = rows.withColumn("_misfit", F.sum((~fits).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["_misfit"])
    room = free - F.length("_header") - 30
    rows = rows.filter((F.col("_misfit") == 0) & (free > 500) & (fits | (room > 500))).select(*keys, "score", "pos", "_header", F.when(~fits, room.cast("int")).alias("_room"))
    content = F.coalesce("content", F.lit(""))
    part = F.when(F.col("_room").isNull(), F.concat("_header", content)).otherwise(F.concat(F.col("_header"), F.substring(content, F.lit(1), F.col("_room")), F.lit("\n...[truncated]")))
    parts = rows.join(contents.select(within, "pos", "content"), [within, "pos"])
    packed = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "pos", part.alias("part")))).alias("p"))
    return packed.select(*keys, F.array_join(F.transform("p", lambda x: x["part"]), "\n").alias("context"), F.size("p").alias("pages"))


def best_sources(scored: DataFrame, within: str) -> DataFrame:
    """The best page of each (``within``, field group); the first of equals."""
    best = F.max_by("url", F.struct("score", (-F.col("pos")).alias("p")))
    return scored.groupBy(within, "field_group").agg(best.alias("source_url"), F.max("score").alias("score"))


def score_histogram(scored: DataFrame, steps: tuple[int, ...] = (200, 150, 100, 80, 50, 0)) -> DataFrame:
    """Pages at or above each step, by group."""
    return scored.groupBy("field_group").agg(*(F.count_if(F.col("score") >= s).alias(f"at_least_{s}") for s in steps))


def field_sources(record: dict[str, Column], sources: Column, default: Column | None = None, nested: dict[str, list[str]] | None = None) -> Column:
    """Map from each field that has a value, and each sub-field of ``nested`` ones, to the best page of its group.

    ``sources`` maps groups to URLs; a group without one gets ``default``, the address the scrape ended at.
    """
    of = lambda name: F.coalesce(F.try_element_at(sources, F.lit(L.FIELD_GROUP[name])), default if default is not None else F.lit(None))
    entry = lambda name, value, group: F.when(value.isNotNull(), F.struct(F.lit(name).alias("k"), of(group).alias("v")))
    entries = []
    for name, value in record.items():
        entries.append(entry(name, value, name))
        entries += [F.when(value.isNotNull(), entry(f"{name}.{sub}", value[sub], name)) for sub in (nested or {}).get(name, [])]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))
