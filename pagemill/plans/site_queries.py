"""Queries on crawls composed of the pages' own links, and on calls that wait for each other, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import lexicon as L
from pagemill.operators import history, sitecrawl
from pagemill.plans import derived
from pagemill.plans.oracle import ANCHORS, PAGES, q, target

#: Pages that crawls of the derived sites may have.
BROAD_SLOTS, NARROW_SLOTS, DEPTH = 50, 12, 3


def _seeds(sites):
    return sites.filter("page_id % 40 = 0").select("crawl_id", F.col("url").alias("page"))


def broad_crawls(spark, d):
    """A crawl of each derived site from its first page, by the links that its pages have."""
    sites = derived.sites(spark, d)
    return sitecrawl.broad_crawl(_seeds(sites), sites, DEPTH, BROAD_SLOTS).select("crawl_id", "page", F.col("depth").cast("long"))


def narrow_crawls(spark, d):
    """A crawl below the first page of each derived site, with the passes for English and fees."""
    sites = derived.sites(spark, d)
    return sitecrawl.narrow_crawl(_seeds(sites), sites, DEPTH, NARROW_SLOTS).select("crawl_id", "page", F.col("depth").cast("long"))


def paced_calls(spark, d):
    """Calls of each user that wait for each other; those of a multiple of three take some minutes."""
    e = spark.read.parquet(f"{d}/events.parquet")
    e = e.select("event_id", "user_id", "ts", (F.col("event_type") != "error").alias("good"), F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 90 * 60).cast("double")).alias("took"))
    return history.paced_calls(e, "user_id", "ts", "event_id", seconds=3600, gap=1200, cooldown=600).select("event_id", "called_us", F.round("wait", 3).alias("wait"))


QUERIES = {f.__name__: f for f in (broad_crawls, narrow_crawls, paced_calls)}

# ------------------------------------------------------------ SQL


def _any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def _hits(x: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({x}, {q(w)})::INT" for w in words) + ")"


def _host(u: str) -> str:
    return f"regexp_extract({u}, '^[A-Za-z]+://([^/]*)', 1)"


def _path(u: str) -> str:
    return f"regexp_replace(regexp_extract({u}, '^[A-Za-z]+://[^/]*(.*)$', 1), '/+$', '')"


_BROAD = f"""CASE WHEN {_host('dst')} <> {_host('base')} OR {_any('lower(dst)', L.BROAD_SKIPPED)} OR dst = base THEN 0 WHEN {_any('lower(dst)', L.SITE_WIDE)} THEN 10
 WHEN contains({_path('dst')}, {_path('base')}) THEN 2 * {_hits('lower(dst)', L.BROAD_WORDS)} WHEN contains(lower(dst), string_split({_path('base')}, '/')[-1]) THEN {_hits('lower(dst)', L.BROAD_WORDS)} ELSE 0 END"""
_NARROW = f"CASE WHEN {_host('dst')} <> {_host('base')} OR NOT starts_with({_path('dst')}, {_path('base')}) OR {_any('lower(dst)', L.NARROW_SKIPPED)} THEN 0 ELSE 3 * {_hits('lower(dst)', L.NARROW_WORDS)} END"


def _list(words: list[str]) -> str:
    return "unnest([" + ", ".join(map(q, words)) + "])"


SITES = f"({derived.SITES})"
_TARGETS = f"{ANCHORS.replace(PAGES, SITES)}, t AS (SELECT url AS src, {target('href', 'url')} AS dst FROM anchors), s AS MATERIALIZED (SELECT * FROM {SITES})"
_WORDS = r"len(regexp_extract_all(content, '\S+'))"


def _gone(words: list[str]) -> str:
    return _any("lower(left(content, 500))", words)


def _waves(score: str, most: int, needs: dict[str, list[str]], enough: int = 8) -> str:
    """The crawl of ``p (page, words, digest)`` over ``l (src, dst)``, wave by wave, as CTE ``kept``."""
    signs = "".join(f", bool_or({_any('lower(page)', w)}) AS {n}" for n, w in needs.items())
    out = ["f0 AS (SELECT crawl_id, url AS page FROM s WHERE page_id % 40 = 0)", "k_1 AS (SELECT NULL::BIGINT AS crawl_id, NULL AS page, NULL AS digest, NULL::BIGINT AS depth WHERE false)"]
    for d in range(DEPTH + 1):
        before = f"k{d - 1}" if d else "k_1"
        out.append(f"""k{d} AS MATERIALIZED (SELECT * FROM {before} UNION ALL SELECT crawl_id, min(page), digest, {d} FROM f{d} JOIN p USING (page) WHERE words >= 50 AND NOT EXISTS (SELECT 1 FROM {before} o WHERE o.crawl_id = f{d}.crawl_id AND o.digest = p.digest) GROUP BY crawl_id, digest)""")
        if d == DEPTH:
            break
        stop = f"n >= {most}" + (f" OR (n >= {enough} AND {' AND '.join(needs)})" if needs and d else "")
        seen = " UNION ALL ".join(f"SELECT * FROM f{e}" for e in range(d + 1))
        out.append(f"""n{d} AS (SELECT crawl_id, count(*) AS n{signs} FROM k{d} GROUP BY 1), g{d} AS (SELECT k.crawl_id, dst, max(n) AS n, f0.page AS base FROM k{d} k JOIN n{d} USING (crawl_id) JOIN f0 USING (crawl_id) JOIN l ON l.src = k.page WHERE depth = {d} AND NOT ({stop}) GROUP BY 1, 2, 4),
f{d + 1} AS MATERIALIZED (SELECT crawl_id, dst AS page FROM (SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY score DESC, dst) AS place FROM (SELECT *, {score} AS score FROM g{d}) WHERE score > 0 AND (crawl_id, dst) NOT IN (SELECT (crawl_id, page) FROM ({seen}))) WHERE place <= {most} - n)""")
    return ", ".join(out) + f", kept AS (SELECT crawl_id, page, depth, digest FROM k{DEPTH})"


_BARE = "regexp_replace(url, '[?#].*$', '')"
_MADE = f"SELECT url, 'https://' || {_host('url')} || {_path(_BARE)} || {_list(L.KNOWN_SUFFIXES)} FROM s UNION ALL SELECT url, 'https://' || {_host('url')} || {_list(L.SITE_PATHS)} FROM s"
_P = f"SELECT url AS page, {_WORDS} AS words, md5(content) AS digest, content FROM s"
_PASSES = f"""e AS (SELECT crawl_id, min_by(page, place) AS page FROM (SELECT crawl_id, 'https://' || {_host('base')} || {_list(L.ENGLISH_PATHS)} AS page, unnest(range({len(L.ENGLISH_PATHS)})) AS place
 FROM (SELECT k.crawl_id, any_value(f0.page) AS base, count(*) AS n, bool_or(contains(lower(k.page), 'english') OR contains(lower(k.page), 'language')) AS has FROM kept k JOIN f0 USING (crawl_id) GROUP BY 1) WHERE n < {NARROW_SLOTS} AND NOT has)
 JOIN (SELECT page FROM ({_P}) WHERE words >= 100 AND NOT {_gone([w for w in L.NARROW_SOFT_404 if w != '404'])}) USING (page) WHERE (crawl_id, page) NOT IN (SELECT (crawl_id, page) FROM kept) GROUP BY 1),
a AS (SELECT crawl_id, page, depth FROM kept UNION ALL SELECT crawl_id, page, 99 FROM e),
have AS (SELECT DISTINCT crawl_id FROM a JOIN ({_P}) USING (page) WHERE contains(lower(page), 'fee') AND contains(left(lower(content), 2000), 'international') AND {_any('lower(content)', L.FEE_SIGNS)}),
v AS (SELECT a.crawl_id, min_by(page, (depth, page)) FILTER (ends_with(page, '/fees')) || '?view=international' AS page FROM a WHERE crawl_id NOT IN (FROM have) GROUP BY 1 HAVING count(*) < {NARROW_SLOTS})
SELECT crawl_id, page, depth FROM a UNION ALL SELECT v.crawl_id, v.page, 99 FROM v JOIN ({_P}) x USING (page) WHERE x.words >= 100 AND (v.crawl_id, x.digest) NOT IN (SELECT (crawl_id, digest) FROM kept)"""

ORACLE_SQL = {
    "broad_crawls": f"WITH {_TARGETS}, p AS MATERIALIZED ({_P}), l AS MATERIALIZED (SELECT DISTINCT src, dst FROM (FROM t UNION ALL {_MADE}) WHERE dst IS NOT NULL), {_waves(_BROAD, BROAD_SLOTS, L.CRAWL_NEEDS)} SELECT crawl_id, page, depth FROM kept",
    "narrow_crawls": f"""WITH {_TARGETS}, p AS MATERIALIZED (SELECT page, words, digest FROM ({_P}) WHERE NOT {_gone(L.NARROW_SOFT_404)} OR page IN (SELECT url FROM s WHERE page_id % 40 = 0)),
l AS MATERIALIZED (SELECT DISTINCT src, dst FROM (FROM t UNION ALL SELECT url, url || {_list(L.SUBPAGES)} FROM s WHERE page_id % 40 = 0) WHERE dst IS NOT NULL), {_waves(_NARROW, NARROW_SLOTS, {})}, {_PASSES}""",
    # call by call: the last begin, the end of the last call, and the begins so far, of which the third last has to be an hour ago
    "paced_calls": """WITH u AS (SELECT user_id, list({'id': event_id, 'us': epoch_us(ts), 'rest': (CASE WHEN event_id % 3 = 0 THEN event_id % 90 * 60 ELSE 0 END + CASE WHEN event_type <> 'error' THEN 600 ELSE 0 END) * 1000000} ORDER BY ts, event_id) AS c FROM events WHERE user_id IS NOT NULL GROUP BY 1),
r AS (SELECT c, list_reduce(c, lambda acc, x: {'free': greatest(acc.free, x.us, coalesce(acc.begun[-1] + 1200000000, 0), coalesce(acc.begun[-3] + 3600000000, 0)) + x.rest,
 'begun': list_append(acc.begun, greatest(acc.free, x.us, coalesce(acc.begun[-1] + 1200000000, 0), coalesce(acc.begun[-3] + 3600000000, 0)))}, {'free': 0::BIGINT, 'begun': []::BIGINT[]}).begun AS b FROM u),
z AS (SELECT unnest(c) AS c, unnest(b) AS called_us FROM r) SELECT c.id AS event_id, called_us, round((called_us - c.us) / 1e6, 3) AS wait FROM z""",
}
