"""DuckDB SQL of the queries, over the same tables."""

from __future__ import annotations

from pagemill.functions import lexicon as L
from pagemill.plans import derived


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _cased(expr: str, types: dict[str, list[str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({expr}, {q('|'.join(f'(?:{p})' for p in ps))}) THEN {q(n)}" for n, ps in types.items()) + f" ELSE {q(default)} END"


def _present(expr: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({expr}, {q(w)})::INT" for w in words) + ")"


def _any(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(w)})" for w in words) + ")"


def _words(expr: str) -> str:
    return f"len(regexp_extract_all(coalesce({expr}, ''), '\\S+'))"


def _count(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {q(pattern)}))"


SPACE = r"^[\s\x{85}\x{A0}]+|[\s\x{85}\x{A0}]+$"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def _strip(expr: str) -> str:
    return f"regexp_replace({expr}, {q(SPACE)}, '', 'g')"


def host(u: str) -> str:
    return f"regexp_replace(regexp_extract(lower({u}), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^www\\.', '')"


def key(u: str) -> str:
    return f"lower(regexp_replace({u}, '/+$', ''))"


def url_type(u: str) -> str:
    return _cased(f"lower(coalesce({u}, ''))", L.URL_TYPES, "other")


def votes(t: str) -> str:
    parts = []
    for k, (n, ps) in enumerate(L.CONTENT_TYPES.items()):
        parts.append(f"{{'votes': {' + '.join(_count(f'lower({t})', p) for p in ps)}, 'rank': {-k}, 'type': {q(n)}}}")
    return f"list_max([{', '.join(parts)}])"


def page_type(u: str, t: str) -> str:
    return f"CASE WHEN {url_type(u)} <> 'other' THEN {url_type(u)} WHEN {votes(t)}.votes > 0 THEN {votes(t)}.type ELSE 'other' END"


def link_score(u: str, t: str) -> str:
    both = f"lower(concat({u}, ' ', {t}))"
    weights = L.LINK_HIGH | L.LINK_LANGUAGE | L.LINK_POSITIVE | L.LINK_NEGATIVE
    total = " + ".join(f"CASE WHEN contains({both}, {q(k)}) THEN {w} ELSE 0 END" for k, w in weights.items())
    return f"greatest({total} + ({_present(both, [*L.LINK_HIGH, *L.LINK_LANGUAGE])} >= 2)::INT, 0)"


def relevance(group: str, u: str, kind: str, t: str) -> str:
    u, t = f"lower({u})", f"lower({t})"
    parts = ["50", f"CASE {kind} " + " ".join(f"WHEN {q(n)} THEN {p}" for n, p in L.TYPE_SCORES[group].items()) + " ELSE 0 END"]
    fees = group == "tuition_fees"
    if fees:
        parts.append(f"CASE WHEN {_any(u, L.TUITION_URLS)} THEN 200 ELSE 0 END")
        parts.append(f"CASE WHEN ends_with({u}, '.html/fees') OR {_any(u, L.CONSTRUCTED_URLS)} THEN -100 WHEN {_any(u, L.AID_URLS)} THEN 60 ELSE 0 END")
    for words, worth in (
        (["language", "english", "ielts", "toefl"], 40 if group == "english_requirements" else -20),
        (["fee", "tuition", "cost", "funding"], 40 if fees else -10),
        (["admission", "apply", "entry", "requirement"], 20 if group in ("application_deadlines", "program_duration") else 0),
        (["visa", "immigration", "cas", "undergraduate"], -30),
    ):
        parts.append(f"CASE WHEN {_any(u, words)} THEN {worth} ELSE 0 END")
    parts.append(f"20 * {_present(t, L.GROUP_KEYWORDS[group])}")
    return f"greatest({' + '.join(parts)}, 0)"


PAGES, PROGRAMS, RECORDS = (f"({x})" for x in (derived.PAGES, derived.PROGRAMS, derived.RECORDS))
SCORED = "WITH p AS (SELECT scrape, page_id AS pos, url, content, " + page_type("url", "content") + f" AS page_type FROM {PAGES}), scored AS (" + " UNION ALL ".join(f"SELECT scrape, pos, url, content, page_type, {q(g)} AS field_group, {relevance(g, 'url', 'page_type', 'content')}::BIGINT AS score FROM p" for g in L.GROUPS) + ")"


def first(t: str, p: str) -> str:
    return f"nullif(trim(regexp_extract({t}, {q(p)}, 0)), '')"


def distinct(t: str, p: str, n: int) -> str:
    """Distinct trimmed matches in order."""
    return f"list_slice(list_filter(list_transform(regexp_extract_all({t}, {q(p)}), lambda x: trim(x)), lambda x, i: list_position(list_transform(regexp_extract_all({t}, {q(p)}), lambda y: trim(y)), x) = i), 1, {n})"


def ordered_distinct(e: str) -> str:
    return f"list_filter({e}, lambda x, i: list_position({e}, x) = i)"


def labelled(t: str, p: str) -> str:
    return f"list_filter(list_transform({distinct(t, p, 3)}, lambda c: trim(regexp_extract(c, {q(L.FEE)}, 0))), lambda a: a <> '')[1]"


NEAR = f"flatten(list_transform({distinct('text', L.FEE_CONTEXT, 8)}, lambda c: list_transform(regexp_extract_all(c, {q(L.FEE)}), lambda y: trim(y))))"
TABLE = [f"trim(regexp_extract(text, {q(L.TOEFL_TABLE)}, {k}))" for k in (1, 2)]

def hints(source: str) -> str:
    """CTE ``h``: findings in the texts of ``source (k, degree, text)``."""
    return f"""h0 AS (SELECT k, degree, text, {first('text', L.IELTS)} AS overall, {first('text', L.IELTS_BAND)} AS band, {NEAR} AS near,
 list_zip(regexp_extract_all(text, {q(L.DEADLINE)}, 1), regexp_extract_all(text, {q(L.DEADLINE)}, 2)) AS dates FROM {source}),
h1 AS (SELECT *, list_filter(list_transform(dates, lambda z: trim(CASE WHEN z[1] <> '' THEN z[1] ELSE z[2] END)), lambda x: x <> '') AS dd, {ordered_distinct('near')} AS nd FROM h0),
h AS (SELECT k, degree, text, CASE WHEN band IS NULL THEN overall ELSE overall || ', no band below ' || regexp_split_to_array(band, '\\s+')[-1] END AS ielts,
 CASE WHEN {TABLE[0]} <> '' AND {TABLE[1]} <> '' THEN 'TOEFL iBT: ' || {TABLE[0]} || ' (before Jan 2026) or ' || {TABLE[1]} || ' (after Jan 2026)' ELSE {first('text', L.TOEFL)} END AS toefl,
 {first('text', L.PTE)} AS pte, {first('text', L.DUOLINGO)} AS duolingo,
 CASE WHEN len(nd) > 0 THEN nd WHEN len({distinct('text', L.FEE, 4)}) > 0 THEN {distinct('text', L.FEE, 4)} END AS fee_amounts,
 {labelled('text', L.DOMESTIC_CONTEXT)} AS domestic_fee, {labelled('text', L.INTERNATIONAL_CONTEXT)} AS international_fee,
 {first('text', L.DURATION)} AS duration, coalesce({first('text', L.GPA)}, {first('text', L.UK_GRADE)}) AS gpa,
 CASE WHEN len(dd) > 0 THEN list_slice({ordered_distinct('dd')}, 1, 3) END AS deadlines FROM h1)"""


HINTS = hints(PROGRAMS)

CLEAN = _strip(
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!\\[[^\\]]*\\]\\(data:[^)]*\\)', '', 'g'), '\\[!\\[[^\\]]*\\]\\(data:[^)]*\\)\\]\\([^)]*\\)', '', 'g'), 'data:image/\\S{10,}', '[image]', 'g'), '%3[cC]svg\\S{20,}', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"
)
_REL = q(L.RELEVANT)
_DROP = f"(regexp_matches(s, {q(L.JUNK)}) OR (NOT regexp_matches(s, {_REL}) AND (regexp_matches(s, {q(L.BOILERPLATE)}) OR (regexp_matches(s, {q(L.NAVIGATION)}) AND length(s) < 50))))"

FIELDS = ["university_name", "program_name", "degree_level", "program_duration", "application_deadlines", "min_academic_requirement", "accepted_qualifications"]
TRACKED = [*FIELDS, "ielts", "toefl", "domestic", "international"]
MISSING = "list_filter([" + ", ".join(f"CASE WHEN coalesce({f}, '') = '' THEN {q(f)} END" for f in TRACKED) + "], lambda x: x IS NOT NULL)"
PAGE_TABLE = "MAP {" + ", ".join(f"{q(k)}: [{', '.join(map(q, v))}]" for k, v in L.FIELD_PAGES.items()) + "}"
BASE = "regexp_replace(url, '[?#].*$', '')"


def target(href: str, base: str) -> str:
    """Absolute form of absolute and root-relative links only; all anchors of the pages are of these kinds."""
    full = f"CASE WHEN regexp_matches(lower({href}), '^https?://') THEN {href} WHEN starts_with({href}, '/') THEN regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || {href} END"
    cut = f"regexp_replace({full}, '[?#].*$', '')"
    return f"CASE WHEN regexp_extract({cut}, '^[A-Za-z]+://[^/]*(.*)$', 1) IN ('', '/') THEN {cut} ELSE regexp_replace({cut}, '/+$', '') END"


_PLAIN = lambda x: f"trim(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'))"  # noqa: E731  the entities that the pages have
#: Anchors of the derived pages: cut at each ``<a``, then at the end of the tag and of the anchor.
ANCHORS = rf"""h AS (SELECT page_id, url, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style).*?</(script|style)>', '', 'g') AS x FROM {PAGES}),
cut AS (SELECT page_id, url, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM (SELECT page_id, url, string_split_regex(x, '(?i)<a\s')[2:] AS l FROM h)),
tag AS (SELECT page_id, url, i, ' ' || split_part(piece, '>', 1) AS given, substr(piece, strpos(piece, '>') + 1) AS rest FROM cut),
given AS (SELECT page_id, url, i, regexp_extract(given, '(?i)\shref\s*=\s*("[^"]*"|''[^'']*''|[^\s"'']+)', 1) AS v, string_split_regex(string_split_regex(rest, '(?i)</a')[1], '<[^>]*>') AS pieces FROM tag),
anchors AS (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, {_PLAIN('''regexp_replace(v, '^["'']|["'']$', '', 'g')''')} AS href,
 array_to_string([{_PLAIN('y')} FOR y IN pieces], '') AS text FROM given WHERE v <> '')"""


def _wave(d: int, most: int = 20, enough: int = 8, last: int = 3) -> str:
    """A wave of the crawl: what is kept, and the next frontier."""
    seen, before = ("", "") if not d else (f" ANTI JOIN k{d - 1} USING (crawl_id, digest)", f" UNION ALL SELECT * FROM k{d - 1}")
    m = "AS MATERIALIZED"
    out = f"""w{d} {m} (SELECT * FROM (SELECT crawl_id, digest, min(page) AS page FROM f{d} JOIN p USING (page) WHERE words >= 50 GROUP BY 1, 2){seen}),
k{d} {m} (SELECT crawl_id, digest, page, {d}::BIGINT AS depth FROM w{d}{before})"""
    if d == last:
        return out
    stop = f"count(*) >= {most}" + (f" OR (count(*) >= {enough} AND bool_or(page % 5 = 0) AND bool_or(page % 3 = 0) AND bool_or(page % 2 = 0))" if d else "")
    return f"""{out},
s{d} {m} (SELECT crawl_id, count(*) AS n, {stop} AS stop FROM k{d} GROUP BY 1),
c{d} {m} (SELECT * FROM (SELECT w{d}.crawl_id, dst AS page, max(score) AS score FROM w{d} JOIN s{d} USING (crawl_id) JOIN l ON src = w{d}.page WHERE NOT stop AND score > 0 GROUP BY 1, 2) ANTI JOIN v{d} USING (crawl_id, page)),
f{d + 1} {m} (SELECT crawl_id, page FROM (SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY score DESC, page) AS place FROM c{d}) JOIN s{d} USING (crawl_id) WHERE place <= {most} - n),
v{d + 1} {m} (SELECT * FROM v{d} UNION ALL SELECT * FROM f{d + 1})"""


_HREFS = "regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)"
CRAWL = f"""n AS (SELECT max(page_id) + 1 AS n FROM pages), p AS MATERIALIZED (SELECT page_id AS page, {_words('html')} AS words, md5(html) AS digest FROM pages),
h AS (SELECT page_id, unnest({_HREFS}) AS href, generate_subscripts({_HREFS}, 1) - 1 AS i FROM pages),
l AS MATERIALIZED (SELECT page_id AS src, (length(href) * 37 + page_id * 5 + i * 11) % n AS dst, length(href) % 7 AS score FROM h, n UNION ALL SELECT page_id, 0, 1 FROM pages),
f0 AS MATERIALIZED (SELECT min(page_id) AS crawl_id, min(page_id) AS page FROM pages GROUP BY {host('url')}), v0 AS (SELECT * FROM f0),
{(chr(44) + chr(10)).join(map(_wave, range(4)))}"""
_min_by = lambda v, o: f"min_by({v}, {o}) FILTER ({v} IS NOT NULL)"
SEARCH = "(regexp_matches(coalesce(university_name, ''), '(?i)program 1[0-9]$') OR regexp_matches(coalesce(program_name, ''), '(?i)program 1[0-9]$')) AND status = 'success'"

ORACLE_SQL = {
    "page_links_topk": f"""WITH {ANCHORS},
b AS (SELECT page_id, url AS base, pos, text AS t, {target('href', 'url')} AS target FROM anchors WHERE href <> ''),
c AS (SELECT *, row_number() OVER (PARTITION BY page_id, {key('target')} ORDER BY pos) AS n FROM b WHERE target IS NOT NULL AND {host('target')} = {host('base')}
 AND NOT (ends_with(lower(target), '.pdf') OR contains(lower(target), '/pdf/') OR contains(lower(target), 'format=pdf')) AND {key('target')} <> {key('base')}),
s AS (SELECT page_id, pos, target, {link_score('target', 't')} AS score FROM c WHERE n = 1)
SELECT page_id, rank::INT AS rank, target, score::INT AS score, pos::BIGINT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rank FROM s WHERE score >= 1) WHERE rank <= {L.MAX_SUBPAGES}""",
    "page_type_counts": f"SELECT {url_type('url')} AS page_type, count(*) AS n FROM {PAGES} GROUP BY 1",
    "host_counts": f"SELECT {host('url')} AS host, count(*) AS n FROM pages GROUP BY 1",
    "same_domain_pairs": f"SELECT {host('url')} AS host, (count(*) * (count(*) - 1) // 2)::BIGINT AS pairs FROM pages GROUP BY 1",
    "normalized_urls": f"""WITH b AS (SELECT page_id, {BASE} AS base, regexp_extract(url, '^([A-Za-z]+)://', 1) AS scheme, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS origin FROM {PAGES}),
f AS (SELECT *, regexp_extract(base, '^[A-Za-z]+://[^/]*(/.*/)', 1) AS folder FROM b)
SELECT page_id, pos::BIGINT AS pos, t AS target FROM (SELECT page_id, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS pos,
 unnest([origin || '/a/b', scheme || '://h.org/q', NULL, NULL, origin || folder || 'c/d.html', origin || regexp_replace(folder, '[^/]*/$', '') || 'up', 'http://z.org/', NULL]) AS t FROM f)""",
    "pdf_links": f"SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '.PDF' ELSE '/pdf/x' END AS pdf_url FROM {PAGES} WHERE page_id % 3 < 2",
    "page_labels": f"""SELECT page_id, CASE WHEN row_number() OVER (PARTITION BY scrape ORDER BY page_id) = 1 THEN 'MAIN PAGE' ELSE
 upper(concat(coalesce(nullif(string_split(url, '/')[-1], ''), nullif(string_split(url, '/')[-2], ''), url), ' (', {page_type('url', 'content')}, ')')) END AS label FROM {PAGES}""",
    "useful_pages": f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN concat('Error 404. ', text) ELSE text END AS c FROM documents)
SELECT doc_id, {_words('c')}::BIGINT AS n_words FROM d WHERE {_words('c')} >= {L.MIN_PAGE_WORDS} AND {_present('lower(left(c, 500))', L.SOFT_404)} = 0""",
    "antibot_flags": f"""SELECT page_id, {_present("lower(html || CASE page_id % 4 WHEN 0 THEN 'Please ENABLE cookies' WHEN 1 THEN 'Ray ID: 7' ELSE '' END)", L.ANTI_BOT)} >= 2 AS blocked FROM pages""",
    "best_fetches": """WITH r AS (SELECT event_id, user_id::VARCHAR AS url, event_id % 3 + 1 AS tier, CASE WHEN event_type = 'error' THEN 403 ELSE 200 END AS status_code, event_id % 400 AS w FROM events)
SELECT url, tier, status_code, event_id FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY (status_code < 400 AND w >= 200) DESC, tier, event_id) AS n FROM r) WHERE n = 1""",
    "doc_first_copies": "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source, md5(coalesce(text, ''))",
    "crawl_waves": f"WITH {CRAWL} SELECT crawl_id, page, depth FROM k3",
    "crawl_depths": f"WITH {CRAWL} SELECT crawl_id, count(*) AS n, string_agg(DISTINCT depth::VARCHAR, ',' ORDER BY depth::VARCHAR) AS depths, max(depth) AS max_depth FROM k3 GROUP BY 1",
    "clean_documents": f"""WITH a AS (SELECT doc_id, list_transform(list_transform(regexp_split_to_array({CLEAN}, {q(LINE_END)}), lambda s: {_strip('s')}), lambda s: CASE WHEN length(s) < 4 THEN '' ELSE s END) AS l FROM documents),
b AS (SELECT doc_id, list_filter(l, lambda s: s = '' OR NOT {_DROP}) AS l FROM a),
c AS (SELECT doc_id, list_filter(l, lambda s, i: s = '' OR regexp_matches(s, {_REL}) OR list_position(l, s) = i) AS l FROM b),
e AS (SELECT doc_id, {_strip("array_to_string(list_filter(l, lambda s, i: s <> '' OR i = 1 OR l[i - 1] <> ''), chr(10))")} AS t FROM c)
SELECT doc_id, md5(t) AS clean_md5, length(t)::BIGINT AS n_chars FROM e""",
    "truncated_documents": f"""WITH p AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\\n+'), lambda s: {_strip('s')}), lambda s: s <> '') AS p FROM documents),
s AS (SELECT doc_id, text, list_sort(list_transform(p, lambda x, i: {{'r': -(3 * {_count('x', L.HIGH_PRIORITY)} + {_count('x', L.MEDIUM_PRIORITY)}), 'a': i, 'p': x}})) AS s FROM p),
c AS (SELECT doc_id, text, list_reduce(s, lambda acc, x: CASE WHEN acc.used + length(x.p) + 2 <= 2920 THEN {{'used': acc.used + length(x.p) + 2, 'kept': list_append(acc.kept, {{'a': x.a, 'p': x.p}})}} ELSE acc END,
 {{'used': 0::BIGINT, 'kept': []::STRUCT(a BIGINT, p VARCHAR)[]}}).kept AS k FROM s),
j AS (SELECT doc_id, text, array_to_string(list_transform(list_sort(k), lambda x: x.p), chr(10) || chr(10)) AS j FROM c),
o AS (SELECT doc_id, CASE WHEN length(text) <= 3000 THEN text WHEN j = '' THEN left(text, 8000) || {q(L.MIDDLE_MARK)} || right(text, 4000) WHEN length(j) < length(text) * 0.9 THEN j || {q(L.CUT_MARK)} ELSE j END AS t FROM j)
SELECT doc_id, md5(t) AS cut_md5, length(t)::BIGINT AS n_chars FROM o""",
    "program_sections": f"""WITH p AS (SELECT k, unnest(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda s: {_strip('s')}), lambda s: s <> '')) AS p, generate_subscripts(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda s: {_strip('s')}), lambda s: s <> ''), 1) AS i FROM {PROGRAMS}),
c AS (SELECT k, i, p, {_cased('lower(p)', L.SECTIONS, 'other')} AS s FROM p),
g AS (SELECT k, {', '.join(f"coalesce(string_agg(p, chr(10) || chr(10) ORDER BY i) FILTER (s = {q(n)}), '') AS s_{n}" for n in [*L.SECTIONS, 'other'])} FROM c GROUP BY k)
SELECT k, {', '.join(f'length(s_{n})::BIGINT AS {n}' for n in [*L.SECTIONS, 'other'])},
 md5(array_to_string(list_filter([s_admissions, s_english, s_fees, s_scholarships, left(s_other, 2000)], lambda x: x <> ''), chr(10) || chr(10))) AS focused_md5 FROM g""",
    "content_votes": f"SELECT k, v.type AS page_type, v.votes::BIGINT AS votes FROM (SELECT k, {votes('text')} AS v FROM {PROGRAMS})",
    "combined_texts": "SELECT conv_id, md5(string_agg('=== SOURCE: ' || upper(role) || ' ===' || chr(10) || trim(text), chr(10) || chr(10) ORDER BY turn)) AS combined_md5 FROM conversations WHERE trim(text) <> '' GROUP BY conv_id",
    "relevance_scores": f"{SCORED} SELECT pos, field_group, score FROM scored",
    "relevance_histogram": f"{SCORED} SELECT field_group, {', '.join(f'count(*) FILTER (score >= {s}) AS at_least_{s}' for s in (200, 150, 100, 80, 50, 0))} FROM scored GROUP BY 1",
    "packed_contexts": f"""{SCORED}, r AS (SELECT scrape, field_group, score, pos, content, chr(10) || '--- ' || upper(page_type) || ' (score:' || score || ') | ' || url || ' ---' || chr(10) AS head,
 CASE field_group {' '.join(f'WHEN {q(g)} THEN {n}' for g, n in L.GROUP_BUDGETS.items())} END AS budget FROM scored WHERE score >= {L.RELEVANCE_THRESHOLD}),
s AS (SELECT *, coalesce(sum(length(head) + length(content)) OVER (PARTITION BY scrape, field_group ORDER BY score DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r),
t AS (SELECT *, budget - before AS free, length(head) + length(content) <= budget - before AS fits FROM s),
u AS (SELECT *, coalesce(sum((NOT fits)::INT) OVER (PARTITION BY scrape, field_group ORDER BY score DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS misfit FROM t),
v AS (SELECT scrape, field_group, score, pos, CASE WHEN fits THEN head || content WHEN free - length(head) - 30 > 500 THEN head || left(content, (free - length(head) - 30)::BIGINT) || chr(10) || '...[truncated]' END AS part FROM u WHERE misfit = 0 AND free > 500),
w AS (SELECT scrape, field_group, string_agg(part, chr(10) ORDER BY score DESC, pos) AS c, count(*) AS n FROM v WHERE part IS NOT NULL GROUP BY 1, 2)
SELECT scrape, field_group, md5(c) AS context_md5, length(c)::BIGINT AS n_chars, n AS pages FROM w""",
    "best_sources": f"{SCORED} SELECT scrape, field_group, url AS source_url, score FROM (SELECT *, row_number() OVER (PARTITION BY scrape, field_group ORDER BY score DESC, pos) AS n FROM scored) WHERE n = 1",
    "extracted_hints": f"WITH {HINTS} SELECT k, ielts, toefl, pte, duolingo, array_to_string(fee_amounts, '; ') AS fee_amounts, domestic_fee, international_fee, duration, gpa, array_to_string(deadlines, '; ') AS deadlines FROM h",
    "hint_blocks": f"""WITH {HINTS}, b AS (SELECT k, list_filter(['  - IELTS score found: ' || ielts, '  - TOEFL score found: ' || toefl, '  - PTE score found: ' || pte, '  - Duolingo score found: ' || duolingo,
 '  - Fee amounts found: ' || array_to_string(fee_amounts, ', '), '  - Domestic/Home fee found: ' || domestic_fee, '  - International fee found: ' || international_fee, '  - Duration found: ' || duration,
 '  - Grade/GPA found: ' || gpa, '  - Deadlines found: ' || array_to_string(deadlines, '; ')], lambda x: x IS NOT NULL) AS l FROM h)
SELECT k, md5(CASE WHEN len(l) = 0 THEN '' ELSE 'REGEX PRE-EXTRACTION (values found in page text — use these as anchors):' || chr(10) || array_to_string(l, chr(10)) || chr(10) || 'Use these as starting points. Extract full context from the text.' END) AS block_md5 FROM b""",
    "filled_records": f"""WITH {HINTS}, f AS (SELECT *, CASE WHEN k % 6 = 0 THEN '£1' END AS given FROM h),
g AS (SELECT *, coalesce(given, domestic_fee) AS dom, list_filter(list_transform(fee_amounts, lambda a: CASE {' '.join(f'WHEN contains(a, {q(s)}) THEN {q(c)}' for s, c in L.CURRENCIES.items())} END), lambda c: c IS NOT NULL)[-1] AS cur FROM f)
SELECT k, CASE WHEN k % 2 = 0 THEN 'IELTS 7.0' ELSE ielts END AS ielts, CASE WHEN length(toefl) >= 10 AND regexp_matches(toefl, '\\d{{2,3}}') THEN toefl END AS toefl, pte, dom AS domestic, international_fee AS international, cur AS currency,
 CASE WHEN given IS NULL AND dom IS NULL AND international_fee IS NULL AND fee_amounts IS NOT NULL THEN array_to_string(fee_amounts, '; ') END AS fee_notes FROM g""",
    "validated_records": f"""WITH {HINTS}, y AS (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(lower(duration), '(\\d+(?:\\.\\d+)?)\\s*years?', 1), '') AS DOUBLE), TRY_CAST(nullif(regexp_extract(lower(duration), '(\\d+)\\s*months?', 1), '') AS DOUBLE) / 12) AS years FROM h),
z AS (SELECT *, CASE WHEN duration IS NULL THEN NULL WHEN years IS NULL THEN 'unclear' WHEN degree = 'Undergraduate' THEN CASE WHEN years < 2.5 THEN 'short' WHEN years > 6 THEN 'long' ELSE 'ok' END
 WHEN degree = 'PhD' THEN CASE WHEN years < 2 THEN 'implausible' WHEN years > 10 THEN 'long' ELSE 'ok' END ELSE CASE WHEN years < 0.5 THEN 'short' WHEN years > 3 THEN 'long' ELSE 'ok' END END AS v FROM y)
SELECT k, v AS duration_verdict, CASE WHEN v = 'implausible' THEN NULL ELSE duration END AS duration, gpa IS NOT NULL AND {_present('lower(text)', L.INTERNAL_FLAGS)} > {_present('lower(text)', L.ADMISSION_FLAGS)} AS internal_grade,
 array_to_string(list_filter([CASE WHEN TRY_CAST(regexp_extract(ielts, '(\\d+\\.?\\d*)', 1) AS DOUBLE) NOT BETWEEN 4 AND 9 THEN 'ielts' END, CASE WHEN TRY_CAST(regexp_extract(toefl, '(\\d+)', 1) AS DOUBLE) NOT BETWEEN 30 AND 120 THEN 'toefl' END], lambda x: x IS NOT NULL), ',') AS english_issues FROM z""",
    "parsed_props": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.absent') AS absent FROM events",
    "record_status": f"""SELECT scrape, CASE WHEN university_name IS NULL AND program_name IS NULL THEN 'failed' WHEN university_name IS NOT NULL AND
 {' + '.join(f'({f} IS NOT NULL)::INT' for f in FIELDS)} + (coalesce(ielts, toefl) IS NOT NULL)::INT + (coalesce(domestic, international) IS NOT NULL)::INT >= 8 THEN 'success' ELSE 'partial' END AS result_status FROM {RECORDS}""",
    "record_coverage": f"SELECT scrape, ({len(TRACKED)} - len({MISSING}))::BIGINT AS found, array_to_string({MISSING}, ',') AS missing FROM {RECORDS}",
    "coverage_total": f"SELECT sum({len(TRACKED)} - len({MISSING}))::BIGINT AS found, (count(*) * {len(TRACKED)})::BIGINT AS total, (sum({len(TRACKED)} - len({MISSING})) * 100 // (count(*) * {len(TRACKED)}))::BIGINT AS percent FROM {RECORDS} WHERE status <> 'failed'",
    "success_rates": f"SELECT batch, count(*) FILTER (status IN ('success', 'partial')) AS good, count(*) AS n, count(ielts) AS with_english FROM {RECORDS} GROUP BY 1",
    "gap_reports": f"""WITH m AS (SELECT scrape, list_filter([CASE WHEN coalesce(domestic, international) IS NULL THEN 'tuition_fees' END, CASE WHEN coalesce(ielts, toefl) IS NULL THEN 'english_requirements' END,
 CASE WHEN application_deadlines IS NULL THEN 'application_deadlines' END, CASE WHEN min_academic_requirement IS NULL THEN 'min_academic_requirement' END], lambda x: x IS NOT NULL) AS missing,
 [CASE WHEN scrape % 2 = 0 THEN 'tuition-and-fees' ELSE 'overview' END, CASE WHEN scrape % 3 = 0 THEN 'entry-requirements' ELSE 'main' END] AS seen FROM {RECORDS}),
w AS (SELECT *, flatten(list_transform(missing, lambda f: {PAGE_TABLE}[f])) AS wanted FROM m),
s AS (SELECT scrape, missing, list_slice(list_filter({ordered_distinct('wanted')}, lambda t: NOT contains(seen[1], t) AND NOT contains(seen[2], t)), 1, {L.SUGGESTIONS}) AS suggested FROM w)
SELECT scrape, array_to_string(missing, ',') AS missing, array_to_string(suggested, ',') AS suggested, len(suggested) > 0 AS needs_recrawl FROM s""",
    "candidate_urls": f"""WITH b AS (SELECT page_id, {BASE} AS base, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS origin FROM pages),
p AS (SELECT *, regexp_replace(regexp_extract(base, '^[A-Za-z]+://[^/]*(.*)$', 1), '/+$', '') AS path, CASE WHEN regexp_matches(base, '^[A-Za-z]+://[^/]*$') THEN base || '/' ELSE regexp_extract(base, '^(.*/)', 1) END AS beside FROM b),
u AS (SELECT page_id, flatten(list_transform(['fees', 'english'], lambda t: list_filter([beside || t, regexp_replace(base, '/+$', '') || '/' || t, CASE WHEN contains(path, '/') THEN origin || regexp_replace(path, '/[^/]*$', '') || '/' || t END, origin || '/' || t, beside || t || '.html'], lambda x: x IS NOT NULL))) AS u FROM p),
d AS (SELECT page_id, list_slice({ordered_distinct('u')}, 1, {L.CANDIDATES}) AS u FROM u)
SELECT page_id, (generate_subscripts(u, 1) - 1)::BIGINT AS pos, unnest(u) AS candidate FROM d""",
    "merged_records": f"""WITH r AS (SELECT *, 's' || scrape AS source FROM {RECORDS}),
l AS (SELECT batch, unnest(['m' || (scrape % 5), 'May']) AS v, scrape * 2 + generate_subscripts(['a', 'b'], 1) AS o FROM r WHERE scrape % 3 = 0),
l2 AS (SELECT batch, string_agg(v, ',' ORDER BY o) AS intake_months FROM (SELECT batch, v, min(o) AS o FROM l GROUP BY 1, 2) GROUP BY 1)
SELECT batch, {', '.join(f'{_min_by(f, "scrape")} AS {f}' for f in FIELDS)}, any_value(intake_months) AS intake_months, {_min_by('ielts', 'scrape')} AS ielts, {_min_by('toefl', 'scrape')} AS toefl, {_min_by('domestic', 'scrape')} AS domestic,
 min_by(source, scrape) FILTER (program_duration IS NOT NULL) AS duration_source, min_by(source, scrape) FILTER (ielts IS NOT NULL) AS ielts_source,
 ({' + '.join(f'(count({f}) > 0)::BIGINT' for f in [*FIELDS, 'intake_months', 'ielts', 'toefl', 'domestic', 'international', 'coalesce(domestic, international)'])}) AS n_sources FROM r LEFT JOIN l2 USING (batch) GROUP BY batch""",
    "history_page": f"SELECT scrape, university_name, program_name, status, created_at FROM {RECORDS} WHERE {SEARCH} ORDER BY created_at DESC, scrape LIMIT 10 OFFSET 10",
    "history_count": f"SELECT count(*) AS total, greatest(ceil(count(*) / 10.0)::BIGINT, 1) AS pages FROM {RECORDS} WHERE {SEARCH}",
    "batch_tally": f"""WITH r AS (SELECT batch, CASE WHEN scrape % 50 = 0 THEN 'pending' ELSE status END AS s FROM {RECORDS})
SELECT batch, count(*) AS total, count(*) FILTER (s IN ('processing', 'running')) AS processing, count(*) FILTER (s = 'success') AS success, count(*) FILTER (s = 'partial') AS partial, count(*) FILTER (s = 'failed') AS failed,
 count(*) FILTER (s = 'pending') AS missing, count(*) FILTER (s IN ('success', 'partial', 'failed')) AS completed, CASE WHEN count(*) FILTER (s IN ('processing', 'running')) = 0 THEN 'complete' ELSE 'processing' END AS job_status FROM r GROUP BY 1""",
    "batch_rows": f"SELECT batch, scrape, CASE WHEN scrape % 50 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN scrape % 50 <> 0 THEN university_name END AS university_name FROM {RECORDS}",
    "exported_rows": "SELECT scrape::VARCHAR AS scrape_id, "
    + ", ".join(f"coalesce({f}, '') AS {f}" for f in FIELDS)
    + f""", 'May; June' AS intake_months, coalesce(ielts, '') AS english_ielts, coalesce(toefl, '') AS english_toefl, '' AS english_pte, '' AS english_duolingo, '' AS english_notes, coalesce(international, '') AS tuition_international,
 coalesce(domestic, '') AS tuition_domestic, CASE WHEN coalesce(domestic, international) IS NULL THEN '' ELSE 'GBP' END AS tuition_currency, '' AS tuition_notes, '' AS other_fees, '' AS scholarships, '' AS work_experience, '' AS other_requirements,
 '' AS confidence_notes, status, 'u1 | u' || scrape AS source_urls, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at FROM {RECORDS}""",
    "record_fields": f"SELECT scrape, unnest([{', '.join(map(q, FIELDS))}]) AS field, unnest([{', '.join(f'coalesce({f}, {q(str())})' for f in FIELDS)}]) AS value FROM {RECORDS}",
    "remaining_after_delete": f"SELECT status, count(*) AS n FROM {RECORDS} WHERE scrape % 7 <> 3 GROUP BY 1",
    "latest_versions": "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "cache_hits": "SELECT user_id AS url, max_by(event_id, {'t': ts, 'e': event_id}) AS scrape FROM events WHERE event_type IN ('view', 'click') AND ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts <= TIMESTAMP '2024-01-03 00:00:00' GROUP BY 1",
    "rate_waits": """SELECT event_id, n AS in_window, n >= 3 AS limited FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) AS n FROM events)""",
    "staggered": f"SELECT scrape, ((row_number() OVER (PARTITION BY batch ORDER BY scrape) - 1) * 25)::BIGINT AS delay_s FROM {RECORDS}",
}
