"""Queries on extraction as a whole, page texts, attribution, lists, exports and limits, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagemill.functions import lexicon as L
from pagemill.functions import text
from pagemill.operators import crawl, extraction, frontier, history, pages, records, relevance
from pagemill.plans import derived
from pagemill.plans.oracle import ANCHORS, FIELDS, PAGES, PROGRAMS, RECORDS, SCORED, _cased, _present, _strip, hints, q, target
from pagemill.sources import html

# ------------------------------------------------------------ page texts


def page_texts(spark, d):
    """The text of every page's HTML, cleaned."""
    read = html.add_text(spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html"))
    cleaned = text.clean_lines(F.col("content"))
    return read.select("page_id", text.looks_like_html(F.col("html")).alias("is_html"), cleaned.alias("t")).select("page_id", "is_html", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n_chars"))


def html_flags(spark, d):
    p = derived.pages(spark, d)
    return p.select("page_id", text.looks_like_html(F.col("html")).alias("html_is"), text.looks_like_html(F.concat(F.lit("a < b and c > d: "), "content")).alias("content_is"))


def markdown_picks(spark, d):
    """A crawler's three texts by page, some of them missing."""
    p = derived.pages(spark, d)
    when = lambda k, c: F.when(F.col("page_id") % k == 0, F.lit("")).when(F.col("page_id") % k != 1, c)
    picked = pages.markdown_of(when(2, F.lit("raw")), when(3, F.lit("fit")), when(5, F.lit("plain")))
    return p.select("page_id", picked.alias("picked"))


def link_unions(spark, d):
    p = derived.pages(spark, d)
    more = F.concat("content", F.lit(" [x](https://h.org/a?b) see https://k.org/b). and (https://l.org/c)"))
    out = pages.link_sources(p.select("page_id", "url", "html", more.alias("content")))
    return out.groupBy("page_id", "source").agg(F.count("*").alias("n"), F.md5(F.array_join(F.sort_array(F.collect_list("link")), " ")).alias("links_md5"))


def rescanned_pages(spark, d):
    """Pages of scrapes and those that a re-scan adds."""
    p = derived.pages(spark, d)
    site = F.regexp_extract("url", "^([A-Za-z]+://[^/]*)", 1)
    tried = p.select("scrape", "page_id", F.posexplode(F.array(*(F.concat(site, F.lit(x)) for x in frontier.SUBPAGES))).alias("k", "url"))
    main = F.min("page_id").over(Window.partitionBy("scrape"))
    tried = tried.withColumn("_main", main).filter("page_id = _main")
    found = tried.select("scrape", "page_id", "url", F.col("k").alias("place"), F.when((F.col("page_id") + F.col("k")) % 4 == 0, 404).otherwise(200).alias("status_code"), (F.col("k") * 40).alias("raw_words"), (F.col("k") * 15).alias("words"))
    return crawl.rescanned(p.select("scrape", "page_id", "url"), found, "scrape").select("scrape", "page_id", "url", "rescan")


# ------------------------------------------------------------ extraction


def _given() -> str:
    """What another extractor found, by key: SQL of a struct of type ``extraction.GIVEN``."""
    values = {
        "degree_level": "degree",
        "program_duration": "case k % 4 when 0 then concat(cast(k % 13 as string), ' years') when 1 then concat(cast(k % 40 as string), ' months') when 2 then 'some time' end",
        "min_academic_requirement": "case when k % 3 = 0 then 'GPA 3.1' end",
        "confidence_notes": "case when k % 7 = 0 then 'seen once' end",
        "application_deadlines": "case when k % 5 = 0 then '1 May' end",
    }
    fields = [f"{values.get(n, 'cast(null as string)')} as {n}" for n in L.SCALAR_FIELDS]
    none = lambda names: ", ".join(f"cast(null as string) as {n}" for n in names)
    english = f"named_struct('ielts', case when k % 6 = 0 then concat('IELTS ', cast(k % 12 as string)) end, 'toefl', case when k % 10 = 0 then concat('TOEFL ', cast(k % 150 as string)) end, 'pte', cast(null as string), 'duolingo', cast(null as string), 'notes', cast(null as string))"
    fees = "named_struct('domestic', case when k % 8 = 0 then '£1' end, 'international', cast(null as string), 'currency', cast(null as string), 'notes', cast(null as string))"
    return f"SELECT *, {', '.join(fields)}, case when k % 2 = 0 then {english} end as english_requirements, case when k % 4 = 0 then {fees} end as tuition_fees FROM {{rows}}"


def extracted_records(spark, d):
    rows = spark.sql(_given(), rows=derived.programs(spark, d))
    given = F.struct(*(F.col(n) for n in (*L.SCALAR_FIELDS, *L.NESTED_FIELDS)))
    out = extraction.extract_records(extraction.contexts(rows.select("k", "text", given.alias("given"))), given="given")
    names = ["program_duration", "min_academic_requirement", "application_deadlines", "confidence_notes"]
    return out.select("k", *(F.col(f"record.{n}").alias(n) for n in names), "record.english_requirements.ielts", "record.english_requirements.toefl", "record.tuition_fees.domestic", "record.tuition_fees.international", "record.tuition_fees.currency", F.md5("context").alias("context_md5"))


def attributed_records(spark, d):
    """Fields of records and the pages they come from."""
    p = derived.pages(spark, d).select("scrape", F.col("page_id").alias("pos"), "url", "content")
    best = relevance.best_sources(relevance.score_pages(p.withColumn("page_type", text.page_type(F.col("url"), F.col("content")))), "scrape")
    maps = best.filter("field_group <> 'intake_months'").groupBy("scrape").agg(F.map_from_entries(F.collect_list(F.struct("field_group", "source_url"))).alias("sources"))
    r = derived.records(spark, d).join(maps, "scrape")
    english = F.when(F.coalesce("ielts", "toefl").isNotNull(), F.struct("ielts", "toefl"))
    record = {n: F.col(n) for n in FIELDS} | {"english_requirements": english, "intake_months": F.when(F.col("scrape") % 2 == 0, F.lit("May"))}
    found = relevance.field_sources(record, F.col("sources"), F.lit("final"), {"english_requirements": ["ielts", "toefl"]})
    return r.select("scrape", F.explode(found).alias("field", "source"))


# ------------------------------------------------------------ lists and exports


def _results(spark, d):
    """Records with the columns of whole results."""
    return spark.sql(f"SELECT *, {_MORE} FROM {{r}}", r=derived.records(spark, d)).withColumn("source_urls", F.when(F.col("scrape") % 4 != 0, F.sequence(F.lit(0), (F.col("scrape") % 4).cast("int"))))


_MORE = """concat('https://u', cast(scrape % 20 as string), '.org/x') AS url_requested, CASE WHEN status <> 'failed' THEN cast((scrape % 400) / 4.0 AS double) END AS elapsed_seconds,
 CASE WHEN status <> 'failed' THEN scrape % 30 END AS pages_fetched, CASE WHEN status = 'failed' THEN 'timed out' END AS error"""


def summary_list(spark, d):
    return history.summary_page(_results(spark, d), status="success", page=3, limit=25)


def searched_records(spark, d):
    return history.containing(derived.records(spark, d), " UNIVERSITY 3").select("scrape", "university_name")


def exported_json(spark, d):
    chosen = derived.records(spark, d).filter("scrape % 3 = 0").select("scrape")
    kept = records.selected_results(derived.records(spark, d), ids=chosen)
    return records.json_rows(kept.select("scrape", *FIELDS, "status"))


def exported_first(spark, d):
    return records.selected_results(derived.records(spark, d), every=True, limit=500).select("scrape", "status")


def deleted_by_address(spark, d):
    r = _results(spark, d)
    left = history.delete_where(history.delete_where(r, url="https://u3.org/x"), pattern=r"u1\d\.")
    return left.groupBy("url_requested").agg(F.count("*").alias("n"))


def run_averages(spark, d):
    return history.averages(_results(spark, d))


def batch_progress(spark, d):
    r = derived.records(spark, d)
    jobs = r.groupBy("batch").agg(F.collect_list("scrape").alias("scrapes"))
    tally = history.batch_tally(jobs, r.filter(F.col("scrape") % 50 != 0).select("scrape", "status"))
    return history.batch_progress(tally).select("batch", "total", "percent")


def batch_table(spark, d):
    r = _results(spark, d)
    jobs = r.groupBy("batch").agg(F.collect_list("scrape").alias("scrapes"))
    return history.batch_export(jobs, r.filter(F.col("scrape") % 50 != 0).select("scrape", "url_requested", "university_name", "program_name", "status", "elapsed_seconds", "error"))


def coverage_marks(spark, d):
    c = records.coverage({n: F.col(n) for n in (*FIELDS, "ielts", "toefl", "domestic", "international")})
    rows = derived.records(spark, d).filter("status <> 'failed'").select("batch", c.alias("c"))
    total = rows.groupBy("batch").agg((F.sum("c.found") * 100 / F.sum("c.total")).cast("int").alias("percent"))
    return total.select("batch", F.col("percent").cast("long"), records.coverage_mark(F.col("percent")).alias("mark"))


def zipped_sources(spark, d):
    """Addresses of a batch and its scrapes, by place."""
    r = _results(spark, d).filter("source_urls IS NOT NULL")
    return records.zipped(r.select("scrape", "source_urls", F.sequence(F.lit(1), (F.col("scrape") % 3 + 1).cast("int")).alias("results")), "scrape", "source_urls", "results")


def call_waits(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "ts", (F.col("event_type") != "error").alias("good"))
    out = history.call_waits(e, "user_id", "ts", "event_id", seconds=3600, gap=1200, cooldown=600)
    return out.select("event_id", *(F.round(c, 3).alias(c) for c in ("window_wait", "gap_wait", "cooldown_wait", "wait")))


def tier_results(spark, d):
    """Pages by the first tier that gave enough of them."""
    p = derived.pages(spark, d)
    rows = p.select("page_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("tier"), "content")
    rows = rows.select("page_id", "tier", F.concat(F.lit("m"), F.col("tier").cast("string")).alias("method"), F.when((F.col("page_id") + F.col("tier")) % 3 > 0, F.col("content")).alias("content"), ((F.col("page_id") * F.col("tier")) % 300).cast("int").alias("word_count"))
    return frontier.fetch_by_tiers(rows, "page_id", words=120).select("page_id", "tier", "method", "word_count", "error", F.length("content").cast("long").alias("n_chars"))


def discovered_programs(spark, d):
    p = derived.pages(spark, d)
    return frontier.discovered(p.select("scrape", (F.col("page_id") % 5).cast("int").alias("tier"), "url").filter("scrape % 3 > 0 OR tier <> 2"), "scrape").groupBy("scrape", "tier").agg(F.count("*").alias("n"))


def record_sheets(spark, d):
    r = derived.records(spark, d).withColumn("degree_level", F.concat(F.lit('say "'), F.col("degree_level"), F.lit('", so')))
    return history.record_csv(r, "scrape", FIELDS).select("scrape", F.md5("csv").alias("csv_md5"))


def run_seconds(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select("user_id", history.elapsed(F.col("a"), F.col("b")).alias("seconds"))


QUERIES = {f.__name__: f for f in (
    tier_results, discovered_programs, record_sheets, run_seconds, page_texts, html_flags, markdown_picks, link_unions, rescanned_pages, extracted_records, attributed_records, summary_list, searched_records, exported_json,
    exported_first, deleted_by_address, run_averages, batch_progress, batch_table, coverage_marks, zipped_sources, call_waits,
)}

# ------------------------------------------------------------ SQL

_RESULTS = f"(SELECT *, {_MORE.replace(' as string', ' as varchar')}, CASE WHEN scrape % 4 <> 0 THEN range(0, scrape % 4 + 1) END AS source_urls FROM {RECORDS})"
_SITE = "regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)"
_PATH = "regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"


def focus(source: str) -> str:
    """CTE ``focused (k, degree, text)`` of a table with these columns."""
    return f"""f0 AS (SELECT k, degree, unnest(string_split(text, chr(10) || chr(10))) AS p, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i FROM {source}),
f1 AS (SELECT k, degree, i, p, {_cased('lower(p)', L.SECTIONS, 'other')} AS s FROM (SELECT k, degree, i, {_strip('p')} AS p FROM f0) WHERE p <> ''),
f2 AS (SELECT k, any_value(degree) AS degree, {', '.join(f"string_agg(p, chr(10) || chr(10) ORDER BY i) FILTER (s = {q(n)}) AS s_{n}" for n in [*L.SECTIONS, 'other'])} FROM f1 GROUP BY k),
focused AS (SELECT k, degree, concat_ws(chr(10) || chr(10), s_admissions, s_english, s_fees, s_scholarships, left(s_other, 2000)) AS text FROM f2)"""


_YEARS = "coalesce(TRY_CAST(nullif(regexp_extract(lower({0}), '(\\d+(?:\\.\\d+)?)\\s*years?', 1), '') AS DOUBLE), TRY_CAST(nullif(regexp_extract(lower({0}), '(\\d+)\\s*months?', 1), '') AS DOUBLE) / 12)"
_KIND = "CASE WHEN degree = 'Undergraduate' THEN 'undergraduate' WHEN degree = 'PhD' THEN 'doctoral' ELSE 'masters' END"
_SAID = " ".join(f"WHEN kind = {q(k)} AND verdict = {q(v)} THEN replace({q(t)}, '%s', years::VARCHAR)" for (k, v), t in L.DURATION_NOTES.items())
_INTERNAL = ", ".join(f"CASE WHEN contains(lower(text), {q(w)}) THEN {q(w)} END" for w in L.INTERNAL_FLAGS)
_GIVEN_SQL = {
    "duration": "CASE k % 4 WHEN 0 THEN (k % 13)::VARCHAR || ' years' WHEN 1 THEN (k % 40)::VARCHAR || ' months' WHEN 2 THEN 'some time' END",
    "ielts": "CASE WHEN k % 6 = 0 THEN 'IELTS ' || (k % 12) END",
    "toefl": "CASE WHEN k % 10 = 0 THEN 'TOEFL ' || (k % 150) END",
}
_WAIT = "greatest(0, coalesce(({0} + {1} * 1000000 - us) / 1000000, 0))"

ORACLE_SQL = {
    "tier_results": f"""WITH r AS (SELECT page_id, t AS tier, (page_id * t) % 300 AS w, length(content) AS n FROM {PAGES}, (SELECT unnest([1, 2, 3]) AS t) WHERE (page_id + t) % 3 > 0 AND content <> ''),
g AS (SELECT page_id, min(tier) AS tier FROM r WHERE w >= 120 GROUP BY 1)
SELECT p.page_id, coalesce(g.tier, 0)::INT AS tier, coalesce('m' || g.tier, 'all_failed') AS method, coalesce(r.w, 0)::INT AS word_count, CASE WHEN g.tier IS NULL THEN 'All tiers failed' END AS error, coalesce(r.n, 0)::BIGINT AS n_chars
FROM pages p LEFT JOIN g ON g.page_id = p.page_id LEFT JOIN r ON r.page_id = g.page_id AND r.tier = g.tier""",
    "discovered_programs": f"""WITH l AS (SELECT DISTINCT scrape, (page_id % 5)::INT AS tier, url FROM {PAGES} WHERE (scrape % 3 > 0 OR page_id % 5 <> 2) AND page_id % 5 IN (1, 2, 3)),
f AS (SELECT scrape, min(CASE tier WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 3 END) AS o FROM l GROUP BY 1)
SELECT scrape, tier, count(*) AS n FROM l JOIN f USING (scrape) WHERE CASE tier WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 3 END = o GROUP BY 1, 2""",
    "record_sheets": f"""SELECT scrape, md5('field,value' || {' || '.join(f"chr(10) || {q(chr(34) + f + chr(34) + ',' + chr(34))} || replace(coalesce({f}, ''), '{chr(34)}', '{chr(34) * 2}') || '{chr(34)}'" for f in FIELDS)}) AS csv_md5
FROM (SELECT * REPLACE ('say "' || degree_level || '", so' AS degree_level) FROM {RECORDS})""",
    "run_seconds": "SELECT user_id, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000, 2) AS seconds FROM events GROUP BY 1",
    "html_flags": f"SELECT page_id, regexp_matches(html, '<[a-zA-Z][^>]{{0,100}}>') AS html_is, regexp_matches('a < b and c > d: ' || content, '<[a-zA-Z][^>]{{0,100}}>') AS content_is FROM {PAGES}",
    "markdown_picks": "SELECT page_id, coalesce(CASE WHEN page_id % 2 > 1 THEN 'raw' END, CASE WHEN page_id % 3 > 1 THEN 'fit' END, CASE WHEN page_id % 5 > 1 THEN 'plain' END) AS picked FROM pages",
    "link_unions": f"""WITH p AS (SELECT page_id, url, html, content || ' [x](https://h.org/a?b) see https://k.org/b). and (https://l.org/c)' AS content FROM {PAGES}),
{ANCHORS},
s AS (SELECT page_id, 'html' AS source, {target('href', 'url')} AS link FROM anchors WHERE href <> '' UNION ALL SELECT page_id, 'markdown', unnest(regexp_extract_all(content, '\\[[^\\]]*\\]\\((https?://[^\\)]+)\\)', 1)) FROM p
 UNION ALL SELECT page_id, 'bare', regexp_replace(unnest(regexp_extract_all(content, '(?:^|[^(])(https?://[^\\s\\)>]+)', 1)), '[.,)]+$', '') FROM p
 UNION ALL SELECT page_id, 'made', unnest([{', '.join(f"'https://' || {_SITE} || {_PATH} || {q(x)}" for x in L.KNOWN_SUFFIXES)}, {', '.join(f"'https://' || {_SITE} || {q(x)}" for x in L.SITE_PATHS)}]) FROM p)
SELECT page_id, source, count(*) AS n, md5(string_agg(link, ' ' ORDER BY link)) AS links_md5 FROM (SELECT DISTINCT * FROM s WHERE link IS NOT NULL) GROUP BY 1, 2""",
    "rescanned_pages": f"""WITH p AS (SELECT scrape, page_id, url FROM {PAGES}), m AS (SELECT scrape, min(page_id) AS page_id FROM p GROUP BY 1),
t AS (SELECT scrape, page_id, unnest([{', '.join(f"regexp_extract(url, '^([A-Za-z]+://[^/]*)', 1) || {q(x)}" for x in frontier.SUBPAGES)}]) AS url, unnest(range({len(frontier.SUBPAGES)})) AS k FROM p JOIN m USING (scrape, page_id)),
g AS (SELECT *, row_number() OVER (PARTITION BY scrape ORDER BY k) AS n FROM t WHERE k < 15 AND (page_id + k) % 4 <> 0 AND k * 40 >= 100 AND k * 15 >= 50)
SELECT scrape, page_id, url, false AS rescan FROM p UNION ALL SELECT scrape, page_id, url, true FROM g WHERE n <= 5""",
    "extracted_records": f"""WITH {focus(PROGRAMS)}, {hints('focused')},
g AS (SELECT *, {_GIVEN_SQL['duration']} AS gd, {_GIVEN_SQL['ielts']} AS gi, {_GIVEN_SQL['toefl']} AS gt, CASE WHEN k % 3 = 0 THEN 'GPA 3.1' END AS gg, CASE WHEN k % 7 = 0 THEN 'seen once' END AS gn, CASE WHEN k % 5 = 0 THEN '1 May' END AS ga,
 CASE WHEN k % 8 = 0 THEN '£1' END AS gf, {_KIND} AS kind FROM h),
y AS (SELECT *, {_YEARS.format('gd')} AS years, TRY_CAST(nullif(regexp_extract(gi, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS ni, TRY_CAST(nullif(regexp_extract(gt, '(\\d+)', 1), '') AS BIGINT) AS nt FROM g),
v AS (SELECT *, CASE WHEN gd IS NULL THEN NULL WHEN years IS NULL THEN 'unclear' WHEN kind = 'undergraduate' THEN CASE WHEN years < 2.5 THEN 'short' WHEN years > 6 THEN 'long' ELSE 'ok' END
 WHEN kind = 'doctoral' THEN CASE WHEN years < 2 THEN 'implausible' WHEN years > 10 THEN 'long' ELSE 'ok' END ELSE CASE WHEN years < 0.5 THEN 'short' WHEN years > 3 THEN 'long' ELSE 'ok' END END AS verdict FROM y),
w AS (SELECT *, list_filter(['Duration: ' || CASE WHEN verdict = 'unclear' THEN {q(L.UNCLEAR_DURATION)} {_SAID} END,
 CASE WHEN gg IS NOT NULL AND {_present('lower(text)', L.INTERNAL_FLAGS)} > {_present('lower(text)', L.ADMISSION_FLAGS)} THEN 'Academic requirement: ' || {q(L.INTERNAL_NOTE)} || array_to_string(list_filter([{_INTERNAL}], lambda x: x IS NOT NULL), ', ') END,
 'English requirements: ' || nullif(array_to_string(list_filter([CASE WHEN ni NOT BETWEEN 4 AND 9 THEN replace({q(L.IELTS_NOTE)}, '%s', ni::VARCHAR) END, CASE WHEN nt NOT BETWEEN 30 AND 120 THEN replace({q(L.TOEFL_NOTE)}, '%s', nt::VARCHAR) END], lambda x: x IS NOT NULL), '; '), '')], lambda x: x IS NOT NULL) AS notes,
 coalesce(gf, domestic_fee) AS dom, list_filter(list_transform(fee_amounts, lambda a: CASE {' '.join(f'WHEN contains(a, {q(s)}) THEN {q(c)}' for s, c in L.CURRENCIES.items())} END), lambda c: c IS NOT NULL)[-1] AS cur FROM v)
SELECT k, coalesce(CASE WHEN verdict = 'implausible' THEN NULL ELSE gd END, duration) AS program_duration, coalesce(gg, gpa) AS min_academic_requirement, coalesce(ga, array_to_string(deadlines, '; ')) AS application_deadlines,
 CASE WHEN len(notes) = 0 THEN gn WHEN gn IS NULL THEN 'Validation warnings: ' || array_to_string(notes, '; ') ELSE gn || '. Validation warnings: ' || array_to_string(notes, '; ') END AS confidence_notes,
 coalesce(gi, ielts) AS ielts, coalesce(gt, CASE WHEN length(toefl) >= 10 AND regexp_matches(toefl, '\\d{{2,3}}') THEN toefl END) AS toefl, dom AS domestic, international_fee AS international, cur AS currency, md5(text) AS context_md5 FROM w""",
    "attributed_records": f"""{SCORED}, b AS (SELECT scrape, field_group, url FROM (SELECT *, row_number() OVER (PARTITION BY scrape, field_group ORDER BY score DESC, pos) AS n FROM scored) WHERE n = 1 AND field_group <> 'intake_months'),
r AS (SELECT *, CASE WHEN scrape % 2 = 0 THEN 'May' END AS intake_months, coalesce(ielts, toefl) AS english FROM {RECORDS} SEMI JOIN b USING (scrape)),
f AS ({' UNION ALL '.join(f"SELECT scrape, {q(n)} AS field, {q(L.FIELD_GROUP[n.split('.')[0]])} AS field_group FROM r WHERE {c} IS NOT NULL" for n, c in [*((n, n) for n in [*FIELDS, 'intake_months']), ('english_requirements', 'english'), ('english_requirements.ielts', 'ielts'), ('english_requirements.toefl', 'toefl')])})
SELECT f.scrape, field, coalesce(b.url, 'final') AS source FROM f LEFT JOIN b ON b.scrape = f.scrape AND b.field_group = f.field_group""",
    "summary_list": f"SELECT scrape, university_name, program_name, status, created_at, url_requested, coalesce(len(source_urls), 0)::BIGINT AS source_count FROM {_RESULTS} WHERE status = 'success' ORDER BY created_at DESC, scrape LIMIT 25 OFFSET 50",
    "searched_records": f"SELECT scrape, university_name FROM {RECORDS} WHERE contains(lower(coalesce(university_name, '')), 'university 3') OR contains(lower(coalesce(program_name, '')), 'university 3')",
    "exported_json": f"SELECT scrape, to_json({{'scrape': scrape, {', '.join(f'{q(f)}: {f}' for f in FIELDS)}, 'status': status}})::VARCHAR AS json FROM {RECORDS} WHERE scrape % 3 = 0",
    "exported_first": f"SELECT scrape, status FROM {RECORDS} ORDER BY scrape LIMIT 500",
    "deleted_by_address": f"SELECT url_requested, count(*) AS n FROM {_RESULTS} WHERE url_requested <> 'https://u3.org/x' AND NOT regexp_matches(url_requested, 'u1\\d\\.') GROUP BY 1",
    "run_averages": f"""SELECT count(*) AS runs, count(*) FILTER (status IN ('success', 'partial')) AS good, round(avg(elapsed_seconds), 2) AS mean_seconds, round(avg(pages_fetched), 2) AS mean_pages,
 round(100.0::DOUBLE * count(*) FILTER (status IN ('success', 'partial')) / count(*), 2) AS percent FROM {_RESULTS}""",
    "batch_progress": f"SELECT batch, count(*) AS total, round(100 * count(*) FILTER (scrape % 50 <> 0 AND status IN ('success', 'partial', 'failed')) / count(*))::BIGINT AS percent FROM {RECORDS} GROUP BY 1",
    "batch_table": f"""SELECT batch, scrape, {', '.join(f"CASE WHEN scrape % 50 <> 0 THEN coalesce({c}::VARCHAR, '') ELSE '' END AS {c}" for c in ('url_requested', 'university_name', 'program_name', 'elapsed_seconds', 'error'))}, CASE WHEN scrape % 50 = 0 THEN 'pending' ELSE status END AS status FROM {_RESULTS}""",
    "coverage_marks": f"""WITH c AS (SELECT batch, (sum({' + '.join(f"(coalesce({f}, '') <> '')::INT" for f in [*FIELDS, 'ielts', 'toefl', 'domestic', 'international'])}) * 100 // (count(*) * {len(FIELDS) + 4}))::BIGINT AS percent FROM {RECORDS} WHERE status <> 'failed' GROUP BY 1)
SELECT batch, percent, CASE WHEN percent >= 75 THEN 'good' WHEN percent >= 50 THEN 'fair' ELSE 'poor' END AS mark FROM c""",
    "zipped_sources": f"SELECT scrape, unnest(range(least(scrape % 4, scrape % 3) + 1)) AS pos, unnest(range(least(scrape % 4, scrape % 3) + 1))::INT AS source_urls, unnest(range(least(scrape % 4, scrape % 3) + 1))::INT + 1 AS results FROM {RECORDS} WHERE scrape % 4 <> 0",
    "call_waits": f"""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, event_type <> 'error' AS good FROM events),
w AS (SELECT *, count(*) OVER r AS n, min(us) OVER r AS oldest, lag(us) OVER l AS last, lag(good) OVER l AS was_good FROM e WINDOW r AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING), l AS (PARTITION BY user_id ORDER BY us, event_id)),
x AS (SELECT event_id, CASE WHEN n >= 3 THEN {_WAIT.format('oldest', 3600)} ELSE 0 END AS a, {_WAIT.format('last', 1200)} AS b, CASE WHEN was_good THEN {_WAIT.format('last', 600)} ELSE 0 END AS c FROM w)
SELECT event_id, round(a, 3) AS window_wait, round(b, 3) AS gap_wait, round(c, 3) AS cooldown_wait, round(greatest(a, b, c), 3) AS wait FROM x""",
}
