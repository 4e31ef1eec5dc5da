"""Queries on whole scrapes: contexts by field group, records with their sources, prompts, first PDFs and pages; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import lexicon as L
from pagemill.functions.text import page_type
from pagemill.operators import extraction, pages
from pagemill.plans import derived
from pagemill.plans.oracle import ANCHORS, ORACLE_SQL as PAGE_SQL, PAGES, SPACE, hints, page_type as page_type_sql, q, target
from pagemill.plans.record_queries import focus

#: Every fifth scrape has no pages but a text; every other one has an answer.
_BARE, _ANSWERED = "scrape % 5 = 4", "scrape % 2 = 0"


def _pages(spark, d):
    p = derived.pages(spark, d).select("scrape", F.col("page_id").alias("pos"), "url", "content")
    return p.withColumn("page_type", page_type(F.col("url"), F.col("content")))


def _scrapes(spark, d):
    """Whole scrapes, extracted: those without pages from the text of their first."""
    p = _pages(spark, d)
    scrapes = p.groupBy("scrape").agg(F.min_by("url", "pos").alias("url"), F.min_by("content", "pos").alias("text"))
    answer = '```json {"university_name": "U", "program_name": "P", "scholarships": "Some", "intake_months": ["May", "June"], "english_requirements": null} ```'
    rows = scrapes.withColumn("given", extraction.read_answer(F.when(F.expr(_ANSWERED), answer)))
    return extraction.extract_scrapes(rows, p.filter(f"NOT ({_BARE})"), "scrape", given="given")


def scrape_contexts(spark, d):
    """The text that each scrape is extracted from."""
    return _scrapes(spark, d).select("scrape", F.md5("focused").alias("text_md5"), F.length("focused").cast("long").alias("n_chars"))


def scrape_records(spark, d):
    """Records of scrapes with the sources of their fields."""
    sources = F.array_join(F.array_sort(F.transform(F.map_entries("field_sources"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), " ")
    names = ["program_duration", "min_academic_requirement", "application_deadlines", "scholarships", "english_requirements.ielts", "english_requirements.toefl", "english_requirements.pte", "tuition_fees.domestic", "tuition_fees.international", "tuition_fees.currency"]
    return _scrapes(spark, d).select("scrape", "status", *(F.col(f"record.{n}") for n in names), F.array_join("record.intake_months", ",").alias("intake_months"), sources.alias("sources"))


def scrape_prompts(spark, d):
    """The prompt of each scrape."""
    return _scrapes(spark, d).select("scrape", F.md5("prompt").alias("prompt_md5"))


def page_pdfs(spark, d):
    """The first two PDFs that each page leads to; every third page has three more."""
    more = F.concat("html", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<a href=/a/Guide.PDF>g</a><a href='https://other.org/pdf/"), F.col("page_id").cast("string"), F.lit("'>h</a><a href=\"/b.pdf\">i</a>"))).otherwise(""))
    return pages.page_pdfs(derived.pages(spark, d).withColumn("html", more)).select("page_id", F.col("pos").cast("long"), "pdf_url")


def listed_pages(spark, d):
    """The pages of each scrape that a prompt on gaps lists."""
    return pages.listed_pages(_pages(spark, d), "scrape")


QUERIES = {f.__name__: f for f in (scrape_contexts, scrape_records, scrape_prompts, page_pdfs, listed_pages)}

# ------------------------------------------------------------ SQL

_strip = lambda x: f"regexp_replace({x}, {q(SPACE)}, '', 'g')"
_NL = "chr(10)"
_packed = PAGE_SQL["packed_contexts"].rsplit("\nSELECT", 1)[0]
_of = lambda g: f"coalesce(any_value(c) FILTER (field_group = {q(g)}), '')"
_head = lambda g: q(f"=== {L.GROUP_HEADERS[g]} ===")
_from = lambda g: f"CASE WHEN contains(text, {_head(g)}) THEN substr(text, strpos(text, {_head(g)}), 2000) END"
_TELLING = ["program_duration", "english_requirements", "application_deadlines"]
_OTHERS = ["tuition_fees", "intake_months"]

#: CTE ``texts (scrape, url, bare, text)``: what each scrape is extracted from.
_TEXTS = f"""{_packed}, s0 AS (SELECT scrape, min_by(url, pos) AS url, min_by(content, pos) AS text FROM p GROUP BY 1),
{focus('(SELECT scrape AS k, NULL AS degree, text FROM s0)')},
x AS (SELECT s0.scrape, any_value(url) AS url, {', '.join(f'{_of(g)} AS {g}' for g in L.GROUP_HEADERS)} FROM s0 LEFT JOIN w USING (scrape) GROUP BY 1),
texts AS (SELECT scrape, url, {_BARE} AS bare, CASE WHEN {_BARE} THEN focused.text ELSE {_strip(f'''concat_ws({_NL} || {_NL}, {', '.join(f"{_head(g)} || {_NL} || {g}" for g in L.GROUP_HEADERS if g != 'intake_months')},
 CASE WHEN intake_months <> '' AND {_strip('intake_months')} <> {_strip('application_deadlines')} THEN {_head('intake_months')} || {_NL} || intake_months END)''')} END AS text FROM x JOIN focused ON k = scrape)"""

_found = ["ielts", "toefl", "pte", "duolingo", "fee_amounts", "domestic_fee", "international_fee", "duration", "gpa", "deadlines"]
_joined = {"fee_amounts": "array_to_string(fee_amounts, ', ')", "deadlines": "array_to_string(deadlines, '; ')"}
#: CTE ``rec``: findings (from the windows after telling headers, then the others) and what is filled with them.
_RECORDS = f"""{_TEXTS},
win AS (SELECT scrape * 2 AS k, NULL AS degree, CASE WHEN bare THEN text ELSE concat_ws({_NL}, {', '.join(map(_from, _TELLING))}) END AS text FROM texts
 UNION ALL SELECT scrape * 2 + 1, NULL, concat_ws({_NL}, {', '.join(map(_from, _OTHERS))}) FROM texts WHERE NOT bare),
{hints('win')},
f AS (SELECT t.scrape, t.url, t.bare, t.text, {_ANSWERED.replace('scrape', 't.scrape')} AS answered, {', '.join(f'coalesce(a.{n}, b.{n}) AS {n}' for n in _found)} FROM texts t JOIN h a ON a.k = t.scrape * 2 LEFT JOIN h b ON b.k = t.scrape * 2 + 1),
rec AS (SELECT * REPLACE (CASE WHEN length(toefl) >= 10 AND regexp_matches(toefl, '\\d{{2,3}}') THEN toefl END AS toefl), toefl AS said_toefl,
 list_filter(list_transform(fee_amounts, lambda a: CASE {' '.join(f'WHEN contains(a, {q(s)}) THEN {q(c)}' for s, c in L.CURRENCIES.items())} END), lambda c: c IS NOT NULL)[-1] AS currency,
 CASE WHEN domestic_fee IS NULL AND international_fee IS NULL THEN array_to_string(fee_amounts, '; ') END AS notes, array_to_string(deadlines, '; ') AS dates FROM f)"""

_english, _fees = "coalesce(ielts, toefl, pte)", "coalesce(domestic_fee, international_fee, currency, notes)"
#: Fields, what shows that they have a value, and the group that their source is of.
_FIELDS = [
    ("university_name", "answered", "program_duration"), ("program_name", "answered", "program_duration"), ("program_duration", "duration", "program_duration"), ("intake_months", "answered", "intake_months"),
    ("application_deadlines", "dates", "application_deadlines"), ("min_academic_requirement", "gpa", "application_deadlines"), ("scholarships", "answered", "tuition_fees"),
    ("english_requirements", _english, "english_requirements"), *((f"english_requirements.{n}", n, "english_requirements") for n in ("ielts", "toefl", "pte")),
    ("tuition_fees", _fees, "tuition_fees"), ("tuition_fees.domestic", "domestic_fee", "tuition_fees"), ("tuition_fees.international", "international_fee", "tuition_fees"), ("tuition_fees.currency", "currency", "tuition_fees"), ("tuition_fees.notes", "notes", "tuition_fees"),
]
_has = lambda c: "answered" if c == "answered" else f"{c} IS NOT NULL"
_source = lambda g: f"CASE WHEN bare THEN url ELSE b_{g} END"
_prompt = " || ".join(q(x) if i % 2 == 0 else {"url": "url", "hint": q(L.ANY_HINT), "findings": "block", "text": "text"}[x] for i, x in enumerate(L.PROMPT.replace("}", "{").split("{")))
_lines = ", ".join(f"{q(label)} || {_joined.get(n, 'said_toefl' if n == 'toefl' else n)}" for n, label in L.HINT_LINES.items())
_base = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"

ORACLE_SQL = {
    "scrape_contexts": f"{_TEXTS} SELECT scrape, md5(text) AS text_md5, length(text)::BIGINT AS n_chars FROM texts",
    "scrape_records": f"""{_RECORDS}, best AS (SELECT scrape, {', '.join(f"max_by(url, {{'s': score, 'p': -pos}}) FILTER (field_group = {q(g)}) AS b_{g}" for g in L.GROUP_HEADERS)} FROM scored GROUP BY 1)
SELECT scrape, CASE WHEN NOT answered THEN 'failed' WHEN {' + '.join(f'({_has(c)})::INT' for n, c, _ in _FIELDS if '.' not in n)} >= 8 THEN 'success' ELSE 'partial' END AS status,
 duration AS program_duration, gpa AS min_academic_requirement, dates AS application_deadlines, CASE WHEN answered THEN 'Some' END AS scholarships, ielts, toefl, pte, domestic_fee AS domestic, international_fee AS international, currency,
 CASE WHEN answered THEN 'May,June' END AS intake_months, array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN {_has(c)} THEN {q(n + '=')} || {_source(g)} END" for n, c, g in _FIELDS)}], lambda x: x IS NOT NULL)), ' ') AS sources FROM rec JOIN best USING (scrape)""",
    "scrape_prompts": f"""{_RECORDS}, l AS (SELECT scrape, url, text, list_filter([{_lines}], lambda x: x IS NOT NULL) AS l FROM rec),
b AS (SELECT scrape, url, text, CASE WHEN len(l) = 0 THEN '' ELSE concat_ws({_NL}, {q(L.HINT_HEAD)}, array_to_string(l, {_NL}), {q(L.HINT_TAIL)}) END AS block FROM l) SELECT scrape, md5({_prompt}) AS prompt_md5 FROM b""",
    "page_pdfs": f"""WITH {ANCHORS}, a AS (SELECT page_id, pos, {target('href', 'url')} AS t FROM anchors WHERE href <> '' UNION ALL SELECT page_id, 1000 + i, t FROM (SELECT page_id, unnest([0, 1, 2]) AS i,
 unnest([{_base} || '/a/Guide.PDF', 'https://other.org/pdf/' || page_id, {_base} || '/b.pdf']) AS t FROM {PAGES} WHERE page_id % 3 = 0)),
f AS (SELECT page_id, t, min(pos) AS pos FROM a WHERE ends_with(lower(t), '.pdf') OR contains(lower(t), '/pdf/') OR contains(lower(t), 'format=pdf') GROUP BY 1, 2)
SELECT page_id, n - 1 AS pos, t AS pdf_url FROM (SELECT page_id, t, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM f) WHERE n <= 2""",
    "listed_pages": f"""SELECT scrape, string_agg('- ' || url || ' (' || page_type || ')', {_NL} ORDER BY page_id) AS listed FROM (SELECT scrape, page_id, url, {page_type_sql('url', 'content')} AS page_type, row_number() OVER (PARTITION BY scrape ORDER BY page_id) AS n FROM {PAGES}) WHERE n <= 10 GROUP BY 1""",
}
