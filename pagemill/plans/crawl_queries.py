"""Queries on crawl decisions, re-scans and display, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import extract, text
from pagemill.operators import frontier, records
from pagemill.plans import derived
from pagemill.plans.oracle import PAGES, PROGRAMS, RECORDS, key, q

#: Paths that links of the derived pages are tried with.
TRIED = ["/fees", "/english/ielts", "/news/tuition", "/2024/course/C1", "/Semester/x", "/apply?x=1", "/how-to-apply", "/modules#m", "/tuition-and-fees/a", "/2024/program/X/y", "/2026/program/X"]
START = "/2026/program/X"
#: Addresses beside a page that its scrape has seen, by page.
SEEN = ["/fees/", "/Overview", "/admissions/", "/visa", "/funding/"]


def _links(spark, d):
    site = F.regexp_extract("url", "^([A-Za-z]+://[^/]*)", 1)
    rows = derived.pages(spark, d).select("page_id", "url", site.alias("site"))
    below = F.when(F.col("page_id") % 2 == 0, F.col("site")).otherwise(F.col("url"))
    return rows.select("page_id", "url", "site", F.posexplode(F.array(*map(F.lit, TRIED))).alias("pos", "path"), below.alias("below")).withColumn("link", F.concat("below", "path")).withColumn("pos", F.col("pos").cast("long"))


def catalogue_links(spark, d):
    rows = _links(spark, d)
    link, start = F.concat("site", "path"), F.concat("site", F.lit(START))
    return rows.select("page_id", "pos", frontier.catalogue_link(link, start).alias("skipped"))


def broad_link_scores(spark, d):
    return _links(spark, d).select("page_id", "pos", frontier.broad_score(F.col("link"), F.col("url")).cast("long").alias("score")).filter("score IS NOT NULL")


def narrow_link_scores(spark, d):
    return _links(spark, d).select("page_id", "pos", frontier.narrow_score(F.col("link"), F.col("url")).cast("long").alias("score")).filter("score IS NOT NULL")


def constructed_subpages(spark, d):
    rows = derived.pages(spark, d).select("page_id", F.explode(frontier.subpages(F.col("url"))).alias("subpage"))
    return rows


def program_links(spark, d):
    rows = _links(spark, d).filter(frontier.program_link(F.col("link")))
    return rows.select("page_id", "pos")


def mapped_programs(spark, d):
    return _links(spark, d).filter(frontier.program_link(F.col("link"), frontier.PROGRAM_WORDS)).groupBy("page_id").agg(F.count("*").alias("n"))


def crawl_reach(spark, d):
    return frontier.reached(derived.pages(spark, d), "scrape", enough=5)


def tier_waterfall(spark, d):
    rows = derived.pages(spark, d).select("scrape", "page_id", (F.col("page_id") % 3 + 1).alias("tier"), (F.col("page_id") % 2 == 0).alias("is_main"), (F.col("page_id") % 400).alias("word_count"))
    return frontier.waterfall(rows, "scrape", least=20).select("scrape", "page_id", "tier")


def rescan_candidates(spark, d):
    pages = derived.pages(spark, d)
    made = pages.select("scrape", F.explode(frontier.subpages(F.regexp_replace("url", "/[^/]*$", ""))).alias("url"))
    # each page's scrape has seen one address beside it
    name = F.element_at(F.array(*map(F.lit, SEEN)), (F.col("page_id") % len(SEEN) + 1).cast("int"))
    seen = pages.withColumn("url", F.upper(F.concat(F.regexp_replace(F.regexp_replace("url", "^http:", "https:"), "/[^/]*$", ""), name)))
    return frontier.new_candidates(made, seen, "scrape").select("scrape", "url")


def found_fields(spark, d):
    pages = derived.pages(spark, d).withColumn("pos", F.col("page_id"))
    return frontier.fields_in_pages(pages, "scrape")


def field_metrics(spark, d):
    r = derived.records(spark, d)
    blank = F.when(F.col("scrape") % 11 == 0, "").when(F.col("scrape") % 19 == 0, "null")
    r = r.withColumns({c: F.coalesce(blank, c) for c in ("degree_level", "ielts", "toefl")})
    return r.select("scrape", *(v.cast("long").alias(n) for n, v in records.field_counts(SIMPLE, {"english": ("ielts", "toefl"), "fees": ("domestic", "international")}).items()))


#: Fields of a record without parts.
SIMPLE = ("university_name", "program_name", "degree_level", "program_duration", "application_deadlines", "min_academic_requirement", "accepted_qualifications")


def section_hints(spark, d):
    headers = F.array(F.lit("Duration:"), F.lit("Admission requirements"), F.lit("Cost of study"), F.lit("The programme duration"))
    part = extract.section_text(F.col("text"), headers)
    return derived.programs(spark, d).select("k", F.md5(part).alias("part_md5"), F.length(part).cast("long").alias("n_chars"))


def displayed_records(spark, d):
    r = derived.records(spark, d)
    return r.select(
        "scrape",
        frontier.display_value(F.col("program_name")).alias("program"),
        frontier.file_slug(F.concat(F.coalesce("university_name", F.lit("Unknown?")), F.lit(" - "), F.coalesce("program_name", F.lit("x")))).alias("slug"),
        frontier.local_time(F.col("created_at").cast("timestamp")).alias("shown_at"),
        frontier.step_of((F.col("scrape") % 60).cast("double"), [5.0, 15.0, 25.0, 30.0, 40.0, 45.0]).cast("long").alias("step"),
    )


def thin_pages(spark, d):
    return derived.pages(spark, d).select("page_id", text.word_count(F.col("content")).cast("long").alias("n_words")).filter("n_words < 75")


QUERIES = {f.__name__: f for f in (
    catalogue_links, broad_link_scores, narrow_link_scores, constructed_subpages, program_links, mapped_programs, crawl_reach, tier_waterfall,
    rescan_candidates, found_fields, field_metrics, section_hints, displayed_records, thin_pages,
)}

# ------------------------------------------------------------ SQL


def _any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def _hits(x: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({x}, {q(w)})::INT" for w in words) + ")"


_host = lambda u: f"regexp_extract({u}, '^[A-Za-z]+://([^/?#]*)', 1)"
_path = lambda u: f"regexp_replace(regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"
LINKS = f"""l0 AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z]+://[^/]*)', 1) AS site, unnest([{', '.join(map(q, TRIED))}]) AS path, unnest([{', '.join(map(str, range(len(TRIED))))}])::BIGINT AS pos FROM {PAGES}),
l AS (SELECT *, CASE WHEN page_id % 2 = 0 THEN site ELSE url END || path AS link FROM l0)"""
_same = "regexp_replace(link, '/+$', '') = regexp_replace(url, '/+$', '')"
_name = f"regexp_replace(string_split({_path('url')}, '/')[-1], '\\.html|\\.htm', '', 'g')"

ORACLE_SQL = {
    "catalogue_links": f"WITH {LINKS} SELECT page_id, pos, path IN ('/2024/course/C1', '/Semester/x', '/2024/program/X/y') AS skipped FROM l",
    "broad_link_scores": f"""WITH {LINKS}, s AS (SELECT page_id, pos, CASE WHEN {_any('lower(link)', frontier.SITE_WIDE)} THEN 10 WHEN contains({_path('link')}, {_path('url')}) THEN 2 * {_hits('lower(link)', frontier.BROAD_WORDS)}
 WHEN {_name} <> '' AND contains(lower(link), {_name}) THEN {_hits('lower(link)', frontier.BROAD_WORDS)} ELSE 0 END AS score FROM l WHERE {_host('link')} = {_host('url')} AND NOT {_any('lower(link)', frontier.BROAD_SKIPPED)} AND NOT {_same})
SELECT page_id, pos, score::BIGINT AS score FROM s WHERE score > 0""",
    "narrow_link_scores": f"""WITH {LINKS}, s AS (SELECT page_id, pos, 3 * {_hits('lower(link)', frontier.NARROW_WORDS)} AS score FROM l WHERE starts_with({_path('link')}, {_path('url')}) AND NOT {_any('lower(link)', frontier.NARROW_SKIPPED)})
SELECT page_id, pos, score::BIGINT AS score FROM s WHERE score > 0""",
    "constructed_subpages": f"SELECT page_id, 'https://' || {_host('url')} || {_path('url')} || unnest([{', '.join(map(q, frontier.SUBPAGES))}]) AS subpage FROM {PAGES}",
    "program_links": f"WITH {LINKS} SELECT page_id, pos FROM l WHERE {_any('lower(link)', frontier.PROGRAM_PATHS)}",
    "mapped_programs": f"WITH {LINKS} SELECT page_id, count(*) AS n FROM l WHERE {_any('lower(link)', frontier.PROGRAM_WORDS)} GROUP BY 1",
    "crawl_reach": f"""WITH f AS (SELECT scrape, count(*) AS n, {', '.join(f"bool_or({_any('lower(url)', w)}) AS {n}" for n, w in frontier.CRITICAL.items())} FROM {PAGES} GROUP BY 1)
SELECT *, n >= 5 AND fees AND english AND entry AS stop FROM f""",
    "tier_waterfall": f"""WITH r AS (SELECT scrape, page_id, page_id % 3 + 1 AS tier, page_id % 2 = 0 AND page_id % 400 >= 20 AS good FROM {PAGES}), g AS (SELECT scrape, min(tier) AS t FROM r WHERE good GROUP BY 1)
SELECT r.scrape, page_id, tier FROM r JOIN g ON g.scrape = r.scrape AND g.t = tier""",
    "rescan_candidates": f"""WITH c AS (SELECT scrape, 'https://' || {_host('url')} || regexp_replace({_path('url')}, '/+[^/]*$', '') || unnest([{', '.join(map(q, frontier.SUBPAGES))}]) AS url FROM {PAGES}),
s AS (SELECT DISTINCT scrape, 'https://' || {_host('lower(url)')} || regexp_replace({_path('lower(url)')}, '/[^/]*$', '') || [{', '.join(q(x.lower().rstrip('/')) for x in SEEN)}][page_id % {len(SEEN)} + 1] AS k FROM {PAGES})
SELECT c.scrape, c.url FROM c ANTI JOIN s ON s.scrape = c.scrape AND s.k = {key('c.url')}""",
    "found_fields": " UNION ALL ".join(f"SELECT scrape, {q(f)} AS field, min_by(url, page_id) AS found_in FROM {PAGES} WHERE {_hits('lower(content)', w)} >= 2 GROUP BY 1" for f, w in frontier.FIELD_WORDS.items()),
    "field_metrics": f"""WITH b AS (SELECT *, CASE WHEN scrape % 11 = 0 THEN '' WHEN scrape % 19 = 0 THEN 'null' END AS z FROM {RECORDS}),
r AS (SELECT scrape, len([x FOR x IN [university_name, program_name, coalesce(z, degree_level), program_duration, application_deadlines, min_academic_requirement, accepted_qualifications] IF coalesce(x, '') NOT IN ('', 'null')])::BIGINT AS s,
 (coalesce(nullif(nullif(coalesce(z, ielts), ''), 'null'), nullif(nullif(coalesce(z, toefl), ''), 'null')) IS NOT NULL)::BIGINT + (coalesce(domestic, international) IS NOT NULL)::BIGINT AS g FROM b)
SELECT scrape, s AS simple_fields, s + g AS total_fields FROM r""",
    "section_hints": f"""WITH p AS (SELECT k, array_to_string(list_transform(list_filter(['Admission requirements', 'The programme duration', 'Duration:', 'Cost of study'], lambda h: contains(text, h)), lambda h: substring(text, position(h IN text), 2000)), chr(10)) AS t FROM {PROGRAMS})
SELECT k, md5(t) AS part_md5, length(t)::BIGINT AS n_chars FROM p""",
    "displayed_records": f"""SELECT scrape, coalesce(program_name, '— not found') AS program,
 regexp_replace(regexp_replace(lower(coalesce(university_name, 'Unknown?') || ' - ' || coalesce(program_name, 'x')), '[^a-z0-9_]', '_', 'g'), '__+', '_', 'g') AS slug,
 strftime(created_at + INTERVAL 330 MINUTE, '%b %d, %Y, %H:%M:%S IST') AS shown_at,
 CASE WHEN scrape % 60 < 5 THEN 0 WHEN scrape % 60 < 15 THEN 1 WHEN scrape % 60 < 25 THEN 2 WHEN scrape % 60 < 30 THEN 3 WHEN scrape % 60 < 40 THEN 4 ELSE 5 END::BIGINT AS step FROM {RECORDS}""",
    "thin_pages": f"SELECT page_id, len(regexp_extract_all(content, '\\S+'))::BIGINT AS n_words FROM {PAGES} WHERE len(regexp_extract_all(content, '\\S+')) < 75",
}
