"""Operators on stored results: listing, batches, cache, versions, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search_filter(search: str | None, status: str | None) -> Column:
    """Case-insensitive pattern on university or program, and a status."""
    out = F.lit(True)
    if search:
        out &= F.coalesce(F.col("university_name").rlike(f"(?i){search}"), F.lit(False)) | F.coalesce(F.col("program_name").rlike(f"(?i){search}"), F.lit(False))
    if status:
        out &= F.col("status") == status
    return out


def history_page(records: DataFrame, search: str | None = None, status: str | None = None, page: int = 1, limit: int = 20) -> DataFrame:
    """A page of the list, newest first (ties by id); a page holds 1 to 100 rows."""
    if not (page >= 1 and 1 <= limit <= 100):
        raise ValueError("page from 1 on, limit from 1 to 100")
    found = records.filter(search_filter(search, status)).orderBy(F.desc("created_at"), "scrape")
    return found.offset((page - 1) * limit).limit(limit).select("scrape", "university_name", "program_name", "status", "created_at")


SUMMARY = ("scrape", "university_name", "program_name", "status", "created_at", "url_requested")


def summary_page(records: DataFrame, search: str | None = None, status: str | None = None, page: int = 1, limit: int = 20) -> DataFrame:
    """A page of the list with ``source_count``, the number of source addresses (none where the list is null), in place of the list itself."""
    if not (page >= 1 and 1 <= limit <= 100):
        raise ValueError("page from 1 on, limit from 1 to 100")
    found = records.filter(search_filter(search, status)).orderBy(F.desc("created_at"), "scrape").offset((page - 1) * limit).limit(limit)
    return found.select(*SUMMARY, F.coalesce(F.size("source_urls"), F.lit(0)).cast("long").alias("source_count"))


def containing(records: DataFrame, words: str, columns: tuple[str, ...] = ("university_name", "program_name")) -> DataFrame:
    """Records that have the words, in any case, in one of the columns; a search for nothing finds all."""
    low = words.strip().lower()
    hit = F.lit(not low)
    for c in columns:
        hit |= F.coalesce(F.lower(c).contains(low), F.lit(False))
    return records.filter(hit)


def history_count(records: DataFrame, search: str | None = None, status: str | None = None, limit: int = 20) -> DataFrame:
    """Matching rows and the number of pages, one at least."""
    total = records.filter(search_filter(search, status)).agg(F.count("*").alias("total"))
    return total.select("total", F.greatest(F.ceil(F.col("total") / limit), F.lit(1)).cast("long").alias("pages"))


def batch_rows(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """A row for each scrape of each job ``(batch, scrapes)``; ``pending`` without a result."""
    ids = jobs.select("batch", F.explode("scrapes").alias("scrape"))
    joined = ids.join(results, "scrape", "left")
    return joined.select("batch", *("scrape" if c == "scrape" else F.coalesce("status", F.lit("pending")).alias("status") if c == "status" else c for c in results.columns))


def batch_tally(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Counts by status of each job; complete once nothing is processing. ``missing`` counts scrapes that were deleted."""
    busy = F.col("status").isin("processing", "running")
    count = lambda c, n: F.count_if(c).alias(n)
    rows = batch_rows(jobs, results.select("scrape", "status"))
    out = rows.groupBy("batch").agg(
        F.count("*").alias("total"),
        count(busy, "processing"),
        *(count(F.col("status") == s, s) for s in ("success", "partial", "failed")),
        count(F.col("status") == "pending", "missing"),
    )
    completed = F.col("total") - F.col("processing") - F.col("missing")
    return out.withColumns({"completed": completed, "job_status": F.when(F.col("processing") == 0, "complete").otherwise("processing")})


def batch_progress(tally: DataFrame) -> DataFrame:
    """Add ``percent``: of a job's scrapes, those that are done, rounded half up; 0 for a job without any."""
    share = F.when(F.col("total") > 0, F.round(100 * (F.col("success") + F.col("partial") + F.col("failed")) / F.col("total"))).otherwise(0)
    return tally.withColumn("percent", share.cast("long"))


def batch_export(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """The six columns of a job's table: address, names, status (``pending`` without a result), seconds and error, null as empty text."""
    rows = batch_rows(jobs, results)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return rows.select("batch", "scrape", *(text(c) for c in ("url_requested", "university_name", "program_name", "status", "elapsed_seconds", "error")))


def field_rows(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Two columns, ``field`` and ``value``, for every field of every record; null as empty text."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("value")) for f in fields))
    return records.select(key, F.explode(pairs).alias("p")).select(key, "p.field", "p.value")


def record_csv(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, csv``: each record as a table of two columns, field and value, every cell in quotes; null as empty text."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    lines = [F.concat(quoted(F.lit(f)), F.lit(","), quoted(F.coalesce(F.col(f).cast("string"), F.lit("")))) for f in fields]
    return records.select(key, F.concat_ws("\n", F.lit("field,value"), *lines).alias("csv"))


def elapsed(started: Column, ended: Column) -> Column:
    """Seconds between two times, with two decimals; null while one is missing."""
    return F.round((F.unix_micros(ended) - F.unix_micros(started)) / 1_000_000, 2)


def delete(records: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return records.join(gone.select(key).distinct(), key, "left_anti")


def delete_where(records: DataFrame, url: str | None = None, pattern: str | None = None, column: str = "url_requested") -> DataFrame:
    """Records left after all of one address, or all whose address matches a pattern, are deleted; a null address matches nothing."""
    if (url is None) == (pattern is None):
        raise ValueError("either url or pattern")
    hit = F.col(column) == url if url is not None else F.col(column).rlike(pattern)
    return records.filter(~F.coalesce(hit, F.lit(False)))


def averages(records: DataFrame) -> DataFrame:
    """``runs``, ``good`` (success or partial) and its ``percent`` of all, and the mean seconds and pages of those that did not fail."""
    good, done = F.col("status").isin("success", "partial"), F.when(F.col("status") != "failed", F.lit(1))
    mean = lambda c: F.round(F.avg(F.when(done.isNotNull(), F.col(c))), 2)
    out = records.agg(F.count("*").alias("runs"), F.count_if(good).alias("good"), mean("elapsed_seconds").alias("mean_seconds"), mean("pages_fetched").alias("mean_pages"))
    return out.withColumn("percent", F.round(100 * F.col("good") / F.col("runs"), 2))


def latest(versions: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest version of each key; versions are reduced before the shuffle."""
    rest = [c for c in versions.columns if c not in key]
    newest = versions.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v"))
    return newest.select(*key, "v.*")


def cached(results: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """For each URL the newest good result of the last hours before ``as_of``."""
    good = results.filter(F.col("status").isin("success", "partial") & (F.col("created_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("created_at") <= as_of))
    return latest(good, ["url"], ["created_at", "scrape"])


def rate_window(calls: DataFrame, key: str, ts: str, order: str, seconds: int = 60, most: int = 3) -> DataFrame:
    """``in_window``: calls of the same key in the ``seconds`` before each call; ``limited`` from ``most`` on."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    before = Window.partitionBy(key).orderBy(micros).rangeBetween(-seconds * 1_000_000, -1)
    return calls.withColumn("in_window", F.count("*").over(before)).withColumn("limited", F.col("in_window") >= most)


def stagger(rows: DataFrame, key: str, order: str, seconds: int = 25) -> DataFrame:
    """``delay_s``: every further row of a job starts so many seconds later."""
    return rows.withColumn("delay_s", (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) * seconds)


def call_waits(calls: DataFrame, key: str, ts: str, order: str, seconds: int = 60, most: int = 3, gap: float = 20, cooldown: float = 10) -> DataFrame:
    """What each call has to wait for, in seconds: ``window_wait`` until the oldest of at least ``most`` calls in the last ``seconds``
    leaves them, ``gap_wait`` until ``gap`` seconds after the call before, ``cooldown_wait`` until ``cooldown`` after it if it
    was good (boolean column ``good``), and ``wait``, the longest. Calls of one instant stand by ``order``. Measured at the times given,
    as if no call had waited."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    calls = calls.withColumn("_us", micros)
    last = Window.partitionBy(key).orderBy("_us", order)
    window = Window.partitionBy(key).orderBy("_us").rangeBetween(-seconds * 1_000_000, -1)
    left = lambda since, n: F.greatest(F.lit(0.0), F.coalesce((since + int(n * 1_000_000) - F.col("_us")) / 1_000_000, F.lit(0.0)))
    rows = calls.withColumns({"_n": F.count("*").over(window), "_oldest": F.min("_us").over(window), "_last": F.lag("_us").over(last), "_good": F.lag("good").over(last)})
    rows = rows.withColumns({
        "window_wait": F.when(F.col("_n") >= most, left(F.col("_oldest"), seconds)).otherwise(0.0),
        "gap_wait": left(F.col("_last"), gap),
        "cooldown_wait": F.when(F.col("_good"), left(F.col("_last"), cooldown)).otherwise(0.0),
    })
    return rows.withColumn("wait", F.greatest("window_wait", "gap_wait", "cooldown_wait")).drop("_us", "_n", "_oldest", "_last", "_good")


def paced_calls(calls: DataFrame, key: str, ts: str, order: str, seconds: int = 60, most: int = 3, gap: float = 20, cooldown: float = 10, block: float = 86_400) -> DataFrame:
    """When each call is made if the calls of a key wait for each other: ``called_us``, microseconds of the Unix epoch, and ``wait``, seconds since ``ts``.

    One call of a key runs at a time, in the order of ``ts``, then ``order``: it begins once that before has ended (``took`` seconds, null as 0, and
    ``cooldown`` more if it was ``good``) and ``gap`` seconds have passed since it began, so a wait moves all later calls. No more than ``most``
    begin in ``seconds``: with ``most * gap`` of at least ``seconds`` the gaps see to that, and other settings are a ValueError. Calls without a time or key have no wait.

    A call begins at the greatest, over itself and all calls before, of that one's time and what has to pass between the two; both are sums and maxima
    over the calls in order. They are taken in blocks of ``block`` seconds of a key first, then over the blocks, so a key with many calls is not a single task's.
    """
    if most * gap < seconds:
        raise ValueError("most * gap has to be seconds at least")
    micros = lambda n: int(n * 1_000_000)
    took = F.round(F.coalesce(F.col("took"), F.lit(0.0)) * 1_000_000).cast("long") + F.when(F.col("good"), micros(cooldown)).otherwise(0)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = calls.withColumns({"_us": us, "_after": F.greatest(took, F.lit(micros(gap)))}).withColumn("_block", F.floor(F.col("_us") / micros(block)))
    inside = Window.partitionBy(key, "_block").orderBy("_us", order)
    rows = rows.withColumn("_before", F.sum("_after").over(inside) - F.col("_after")).withColumn("_free", F.col("_us") - F.col("_before"))
    rows = rows.withColumn("_top", F.max("_free").over(inside))
    blocks = rows.groupBy(key, "_block").agg(F.sum("_after").alias("_sum"), F.max("_free").alias("_most"))
    along = Window.partitionBy(key).orderBy("_block")
    blocks = blocks.withColumn("_passed", F.sum("_sum").over(along) - F.col("_sum")).withColumn("_level", F.max(F.col("_most") - F.col("_passed")).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    # of the blocks before only the highest level counts, and the seconds passed in them
    both = rows.join(blocks.select(key, "_block", "_passed", "_level"), [key, "_block"], "left")
    called = F.col("_before") + F.greatest(F.col("_top"), F.col("_level") + F.col("_passed"))
    called = F.when(F.col(key).isNotNull(), called)
    return both.withColumns({"called_us": called, "wait": (called - F.col("_us")) / 1_000_000}).drop("_us", "_after", "_block", "_before", "_free", "_top", "_passed", "_level").select(*calls.columns, "called_us", "wait")
