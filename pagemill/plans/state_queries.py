"""Queries on states of jobs, partial updates, look-ups, the cache, captures and free-form documents, with their DuckDB SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pagemill.operators import records, updates
from pagemill.plans import derived
from pagemill.plans.oracle import RECORDS
from pagemill.sources import captures, documents, lookups
from pagemill.sources.shared import shared_path
from pagemill.streaming import states

#: How late events may be, in days, in ``streamed_job_states``.
LATE_DAYS = 3

_LOG = """SELECT concat(cast(user_id as string), '/', cast(event_id % 20 as string)) AS job, cast(user_id as string) AS batch, ts,
 CASE event_type WHEN 'view' THEN 'processing' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'partial' ELSE 'failed' END AS status FROM events"""


def _over(spark, sql, rows):
    """SQL over ``events``, which may hold braces."""
    return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {rows}"), rows=rows)


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def _log(spark, d):
    return _over(spark, _LOG, _events(spark, d))


def _plain(rows):
    """Times without zone, as in the given tables."""
    return rows.select("job", "batch", "status", F.col("ts").cast("timestamp_ntz").alias("ts"), "timed_out")


def job_end_states(spark, d):
    """The log of all events as of some days before its end: jobs without a sign of life have failed."""
    log = _log(spark, d)
    last = log.agg(F.max("ts")).first()[0]
    as_of = F.expr(f"timestamp_ntz'{last - dt.timedelta(days=LATE_DAYS)}'").cast("timestamp") if last else None
    return _plain(states.end_states(log, as_of))


def streamed_job_states(spark, d):
    """The same by a stream: its watermark ends where ``job_end_states`` looks."""
    path = shared_path(spark, "job-changes")
    # a pattern, as the stream's source takes a folder or a pattern, and the table may be a file
    stream = spark.readStream.schema(_events(spark, d).schema).parquet(f"{d}/events.parque[t]")
    changes = states.job_changes(_over(spark, _LOG, stream), late=f"{LATE_DAYS} days")
    run = changes.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    run.start().awaitTermination()
    return _plain(states.newest_changes(spark.read.schema(changes.schema).parquet(f"{path}/out")))


def completed_batches(spark, d):
    """Batches all of whose jobs have ended, or been given up, with their counts by end state."""
    ends = job_end_states(spark, d)
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    tally = ends.groupBy("batch").agg(F.count("*").alias("total"), count("success"), count("partial"), count("failed"), F.max("ts").alias("ts"))
    return tally.filter("success + partial + failed = total")


_UPDATE = """SELECT user_id, ts, event_id, concat('{"status":"', event_type, '"',
 CASE WHEN event_id % 3 = 0 THEN concat(',"error":', CASE WHEN event_id % 2 = 0 THEN 'null' ELSE concat('"e', cast(event_id as string), '"') END) ELSE '' END,
 CASE WHEN event_id % 4 = 0 THEN concat(',"pages_fetched":', cast(event_id % 50 as string)) ELSE '' END,
 CASE WHEN event_id % 997 = 0 THEN ',"fees":{"domestic":"x"}' ELSE '' END, '}') AS doc FROM events"""


def updated_records(spark, d):
    """Every event as an update of some fields of its user's record."""
    rows = _over(spark, _UPDATE, _events(spark, d))
    fields = "status string, error string, pages_fetched long, fees struct<domestic:string>"
    out = updates.current(updates.json_updates(rows, "user_id", ["ts", "event_id"], "doc", fields), "user_id")
    return out.select("user_id", "status", "error", "pages_fetched", F.col("fees.domestic").alias("domestic"), F.array_join("set_fields", ",").alias("set_fields"))


def looked_up_records(spark, d):
    """Records by the ids that customers ask for, out of a table made for look-ups."""
    path = shared_path(spark, "records")
    lookups.write_lookup(derived.records(spark, d), path, "scrape", also=["batch"])
    asked = spark.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") * 7).alias("scrape"))
    return lookups.look_up(spark, path, "scrape", asked).select("scrape", "university_name", "status")


_RESULTS = "SELECT event_id AS scrape, cast(user_id as string) AS url, ts AS created_at, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'partial' ELSE 'failed' END AS status FROM events WHERE event_type NOT IN ('view', 'click')"
_REQUESTS = "SELECT event_id AS request, cast(user_id as string) AS url, ts FROM events WHERE event_type IN ('view', 'click')"


def cache_answers(spark, d):
    """What the cache has for each request of the last day's results."""
    events = _events(spark, d)
    out = states.cache_answers(_over(spark, _REQUESTS, events), _over(spark, _RESULTS, events))
    return out.select("request", "url", "scrape", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


def captured_pages(spark, d):
    """All pages, written as captured exchanges and read back."""
    path = shared_path(spark, "captures")
    rows = spark.read.parquet(f"{d}/pages.parquet")
    status = F.when(F.col("page_id") % 11 == 0, 403).when(F.col("page_id") % 13 == 0, 503).when(F.col("page_id") % 17 != 0, 200)
    captures.write_captures(rows.select("url", "html", status.alias("status_code"), F.concat("url", F.lit("?seen\n%")).alias("final_url")), path)
    return captures.read_captures(spark, path).select("host", "url", "final_url", F.col("status_code").cast("long").alias("status_code"), "error", F.md5("html").alias("html_md5"))


_DOCUMENT = """SELECT event_id, concat('{"id":', cast(event_id as string), ',"props":', props, ',"who":{"name.x":"u', cast(user_id as string), '"', CASE WHEN event_id % 3 = 0 THEN ',"note":null' WHEN event_id % 3 = 1 THEN ',"note":""' ELSE '' END,
 '},"seen":[{"v":', cast(event_id % 7 as string), '},{"v":"', event_type, '"}]', CASE WHEN event_id % 101 = 0 THEN '' ELSE '}' END) AS doc FROM events"""
#: Columns and the dotted paths and types that they are read by.
PATHS = {"id": ("id", "long"), "k": ("props.k", "long"), "first": ("seen[0].v", "long"), "second": ("seen[1].v", "string"), "wrong": ("seen[1].v", "long"), "note": ("who.note", "string"), "none": ("who.absent.x", "string")}
COVERED = ["id", "props.k", "who.note", "who.absent.x", "seen[1].v"]


def _documents(spark, d):
    rows = _over(spark, _DOCUMENT, _events(spark, d))
    return rows.select("event_id", documents.as_document(F.col("doc")).alias("doc"))


def document_paths(spark, d):
    return documents.select_paths(_documents(spark, d), "doc", PATHS, keep=["event_id"])


def document_coverage(spark, d):
    return documents.path_coverage(_documents(spark, d), "doc", COVERED)


def validation_report(spark, d):
    """A line for every record, some of which failed."""
    r = derived.records(spark, d)
    fields = {n: F.col(n.rpartition(".")[2]) for n in REPORTED}
    return records.validation_report(r, "scrape", fields, F.col("scrape") % 400 / F.lit(16.0), F.when(F.col("status") == "failed", F.lit("timed out after " + "x" * 60)))


#: Fields of the report by their dotted names.
REPORTED = ["university_name", "program_name", "degree_level", "program_duration", "application_deadlines", "min_academic_requirement", "english_requirements.ielts", "english_requirements.toefl", "tuition_fees.domestic", "tuition_fees.international"]

QUERIES = {
    f.__name__: f
    for f in (job_end_states, streamed_job_states, completed_batches, updated_records, looked_up_records, cache_answers, captured_pages, document_paths, document_coverage, validation_report)
}

# ---------------------------------------------------------------- SQL

_ENDS = f"""WITH l AS ({_LOG}), r AS (SELECT *, CASE status WHEN 'processing' THEN 0 WHEN 'running' THEN 1 ELSE 2 END AS rank FROM l),
g AS (SELECT job, min(batch) AS batch, max(ts) AS last, max({{'rank': rank, 'ts': ts, 'status': status}}) AS best FROM r GROUP BY 1),
e AS (SELECT *, best.rank < 2 AND last + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL {LATE_DAYS} DAY AS timed_out FROM g),
s AS (SELECT job, batch, CASE WHEN timed_out THEN 'failed' ELSE best.status END AS status, CASE WHEN timed_out THEN last + INTERVAL 30 MINUTE ELSE best.ts END AS ts, timed_out FROM e)"""
_NEWEST = lambda f, v: f"arg_max({{'v': {v}}}, {{'t': ts, 'i': event_id}}) FILTER (list_contains(json_keys(doc), '{f}'))"
_JSON = f"SELECT event_id, CASE WHEN json_valid(doc) THEN doc::JSON END AS doc FROM ({_DOCUMENT})"
_POINTER = {"id": "$.id", "props.k": "$.props.k", "who.note": "$.who.note", "who.absent.x": "$.who.absent.x", "seen[1].v": "$.seen[1].v", "seen[0].v": "$.seen[0].v"}


def _read(path: str, kind: str) -> str:
    text = f"(doc->>'{_POINTER[path]}')"
    return f"TRY_CAST({text} AS BIGINT)" if kind == "long" else text


ORACLE_SQL = {
    "job_end_states": f"{_ENDS} SELECT * FROM s",
    "streamed_job_states": f"{_ENDS} SELECT * FROM s",
    "completed_batches": f"""{_ENDS} SELECT batch, count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'failed') AS failed, max(ts) AS ts
 FROM s GROUP BY 1 HAVING bool_and(status IN ('success', 'partial', 'failed'))""",
    "updated_records": f"""WITH u AS ({_UPDATE}),
g AS (SELECT user_id, {_NEWEST('status', "doc->>'$.status'")} AS a, {_NEWEST('error', "doc->>'$.error'")} AS b, {_NEWEST('pages_fetched', "(doc->>'$.pages_fetched')::BIGINT")} AS c, {_NEWEST('fees', "doc->>'$.fees.domestic'")} AS e FROM u GROUP BY 1)
SELECT user_id, a.v AS status, b.v AS error, c.v AS pages_fetched, e.v AS domestic,
 concat_ws(',', CASE WHEN a IS NOT NULL THEN 'status' END, CASE WHEN b IS NOT NULL THEN 'error' END, CASE WHEN c IS NOT NULL THEN 'pages_fetched' END, CASE WHEN e IS NOT NULL THEN 'fees' END) AS set_fields FROM g""",
    "looked_up_records": f"SELECT scrape, university_name, status FROM {RECORDS} WHERE scrape IN (SELECT c_custkey * 7 FROM customer)",
    "cache_answers": f"""WITH r AS ({_REQUESTS}), s AS ({_RESULTS}),
j AS (SELECT request, r.url, max({{'created_at': created_at, 'scrape': scrape}}) FILTER (scrape IS NOT NULL) AS v FROM r LEFT JOIN s ON s.url = r.url AND s.status IN ('success', 'partial') AND created_at <= ts AND created_at >= ts - INTERVAL 24 HOUR GROUP BY 1, 2)
SELECT request, url, v.scrape AS scrape, v.created_at AS created_at FROM j""",
    "captured_pages": r"""WITH p AS (SELECT page_id, url, html, CASE WHEN page_id % 11 = 0 THEN 403 WHEN page_id % 13 = 0 THEN 503 WHEN page_id % 17 <> 0 THEN 200 END::BIGINT AS status_code FROM pages)
SELECT coalesce(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^www\.', ''), '') AS host, url, url || '?seen' || chr(10) || '%' AS final_url, status_code,
 CASE WHEN status_code IN (403, 503) THEN 'Access denied (HTTP ' || status_code || ')' END AS error, md5(html) AS html_md5 FROM p""",
    "document_paths": f"SELECT event_id, {', '.join(f'{_read(p, k)} AS {n}' for n, (p, k) in PATHS.items() if n != 'none')}, NULL::VARCHAR AS none FROM ({_JSON})",
    "validation_report": f"""WITH r AS (SELECT *, [n.k FOR n IN [{', '.join(f"{{'k': '{n.rpartition('.')[2]}', 'v': {n.rpartition('.')[2]}}}" for n in REPORTED)}] IF coalesce(n.v, '') = ''] AS gone FROM {RECORDS}),
c AS (SELECT *, {len(REPORTED)} - len(gone) AS found, (100 * ({len(REPORTED)} - len(gone))) // {len(REPORTED)} AS percent FROM r)
SELECT scrape, CASE WHEN status = 'failed' THEN 'error' WHEN percent >= 75 THEN 'good' WHEN percent >= 50 THEN 'fair' ELSE 'poor' END AS mark, CASE WHEN status <> 'failed' THEN found || '/{len(REPORTED)} (' || percent || '%)' END AS covered,
 round((scrape % 400) / 16.0::DOUBLE, 1) AS seconds, CASE WHEN status = 'failed' THEN 'timed out after ' || repeat('x', 34) ELSE array_to_string(gone[1:4], ', ') || CASE WHEN len(gone) > 4 THEN ' +' || (len(gone) - 4) || ' more' ELSE '' END END AS missing FROM c""",
    "document_coverage": " UNION ALL ".join(f"SELECT '{p}' AS path, count(*) AS n, count(*) FILTER (json_type(doc, '{_POINTER[p]}') IS NOT NULL) AS present, count(*) FILTER (coalesce(doc->>'{_POINTER[p]}', '') <> '') AS filled FROM ({_JSON})" for p in COVERED),
}
