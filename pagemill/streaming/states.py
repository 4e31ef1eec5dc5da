"""Stateful streams: states of jobs with timers, completion of batches, and a cache of results.

Logs of states may come late and out of order. What a job's state is depends only on the set of events seen, so a
stream ends with what ``end_states`` gives for the same rows; events older than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagemill.streaming.jobs import ORDER

#: Statuses from which a job does not come back.
ENDED = sorted(s for s, n in ORDER.items() if n == max(ORDER.values()))
CHANGES = "job string, batch string, status string, ts timestamp, heard timestamp, told timestamp, ended boolean, timed_out boolean"
COMPLETIONS = "batch string, total long, success long, partial long, failed long, ts timestamp"


def with_state_store(spark: SparkSession) -> None:
    """The state store that typed state, timers and its growth beyond memory need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _rank(status: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, n in ORDER.items():
        out = F.when(status == name, n).otherwise(out)
    return out


def _events(log: DataFrame) -> DataFrame:
    known = log.filter(F.col("job").isNotNull() & F.col("ts").isNotNull() & _rank(F.col("status")).isNotNull())
    return known.select(F.col("job").cast("string"), F.col("batch").cast("string"), "status", F.col("ts").cast("timestamp"))


def _stamp(*us: int) -> pd.DatetimeIndex:
    """Microseconds since 1970 as cells; with their zone, so that the session's plays no part."""
    return pd.to_datetime(list(us), unit="us", utc=True)


# ---------------------------------------------------------------- jobs


class _Jobs(StatefulProcessor):
    """The furthest state of each job, the latest of equally far ones; timers fail those that show no sign of life.

    A key is a bucket of jobs, as a call into Python, or to the state from there, costs much more than a job. Its state is a row of arrays
    with a place for each job, which is read and written whole; its one timer is that of the job that is due first.
    """

    def __init__(self, timeout_ms: int, keep_ms: int):
        self.timeout_ms, self.keep_ms = timeout_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = {"job": "string", "rank": "int", "us": "long", "status": "string", "last_us": "long", "timed_out": "boolean", "counted": "boolean", "batch": "string"}
        self.jobs = handle.getValueState("jobs", "due long, " + ", ".join(f"{n} array<{t}>" for n, t in fields.items()))

    def _load(self) -> tuple[int | None, dict[str, tuple]]:
        """When the timer is set to, and ``rank, us, status, last_us, timed_out, counted, batch`` of each job."""
        row = self.jobs.get()
        return (row[0], {job: v for job, *v in zip(*row[1:], strict=True)}) if row else (None, {})

    def _store(self, jobs: dict[str, tuple], timer: int | None) -> None:
        """Keep the jobs, with the timer at the first that is due; ``timer`` is what it is set to."""
        due = min((self._due(*v) for v in jobs.values()), default=None)
        if timer is not None and due != timer:
            self.handle.deleteTimer(timer)
        if due is not None and due != timer:
            self.handle.registerTimer(due)
        if jobs:
            self.jobs.update((due, list(jobs), *map(list, zip(*jobs.values(), strict=True))))
        else:
            self.jobs.clear()

    def _due(self, rank: int, us: int, status: str, last: int, timed_out: bool, *_) -> int:
        """When a job is given up or, if ended or given up, forgotten: milliseconds since 1970."""
        over = rank == max(ORDER.values())
        return last // 1000 + (0 if over else self.timeout_ms) + (self.keep_ms if over or timed_out else 0)

    def _rows(self, rows: list[tuple], watermark_ms: int) -> Iterator[pd.DataFrame]:
        """``job, batch, status, us, heard, ended, timed_out`` as rows of ``CHANGES``; none gives no table."""
        if rows:
            job, batch, status, us, heard, ended, timed_out = map(list, zip(*rows, strict=True))
            times = {"ts": _stamp(*us), "heard": _stamp(*heard), "told": _stamp(*(max(h, watermark_ms * 1000) for h in heard))}
            yield pd.DataFrame({"job": job, "batch": batch, "status": status, **times, "ended": ended, "timed_out": timed_out})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, jobs = self._load()
        before, new = {}, (-1, 0, "", 0, False, False, None)
        for part in rows:
            for job, b, s, t in zip(part["job"], part["batch"], part["status"], part["us"].tolist(), strict=True):
                had = jobs.get(job, new)
                before.setdefault(job, had)
                *now, last, timed_out, counted, batch = had
                batch = b if batch is None or (b is not None and b < batch) else batch
                jobs[job] = (*max(tuple(now), (ORDER[s], t, s)), max(last, t), timed_out, counted, batch)
        out = []
        for job, had in before.items():
            *now, last, timed_out, counted, batch = jobs[job]
            over = now[0] == max(ORDER.values())
            jobs[job] = (*now, last, False, counted or over, batch)
            if tuple(now) != tuple(had[:3]) or timed_out:
                out.append((job, batch, now[2], now[1], last, over and not counted, False))
        self._store(jobs, timer)
        yield from self._rows(out, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark_ms = timerValues.getCurrentWatermarkInMs()
        timer, jobs = self._load()
        out, left = [], {}
        for job, had in jobs.items():
            rank, us, status, last, timed_out, counted, batch = had
            if self._due(*had) <= watermark_ms and rank < max(ORDER.values()) and not timed_out:
                out.append((job, batch, "failed", last + self.timeout_ms * 1000, last, not counted, True))
                had = (rank, us, status, last, True, True, batch)
            if self._due(*had) > watermark_ms:
                left[job] = had
        self._store(left, timer)
        yield from self._rows(out, watermark_ms)

    def close(self) -> None:
        pass


def job_changes(log: DataFrame, late: str = "10 minutes", timeout_minutes: int = 30, keep_minutes: int = 1440, buckets: int = 4096) -> DataFrame:
    """A row for every change of a job's state, from a stream of ``job, batch, status, ts``.

    A state is only left for one further on (``ORDER``), or for a later one as far; events that would lead back change nothing, and so do
    unknown statuses and rows without job or time. ``heard`` is the time of the last event so far, ``told`` the row's own event time (that, or the watermark where it is later), ``ended`` marks the row with which
    a job first ends or is given up. ``timed_out`` marks jobs of which nothing was heard for ``timeout_minutes`` up to the watermark: they count as failed at that time until something newer is
    heard. State is dropped ``keep_minutes`` after the last event of an ended job, and after the timeout of one that was given up;
    a job heard of again after that begins anew. Jobs are dealt into ``buckets`` by their hash; a stream keeps their number for its life, and a call goes through the jobs of its bucket that are in state.
    """
    with_state_store(log.sparkSession)
    timed = _events(log).withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)
    jobs = _Jobs(timeout_minutes * 60_000, keep_minutes * 60_000)
    dealt = timed.withColumn("bucket", F.pmod(F.xxhash64("job"), F.lit(buckets)))
    return dealt.groupBy("bucket").transformWithStateInPandas(jobs, CHANGES, "Append", "EventTime", eventTimeColumnName="told")


def end_states(log: DataFrame, as_of: Column | None = None, timeout_minutes: int = 30) -> DataFrame:
    """The same for a table: ``job, batch, status, ts, timed_out`` as of a time (null: nothing times out).

    Of equally far states the latest counts, of equally late ones the last by name; the batch is the least one named.
    """
    best = F.max(F.struct(_rank(F.col("status")).alias("rank"), "ts", "status")).alias("best")
    out = _events(log).groupBy("job").agg(best, F.max("ts").alias("last"), F.min("batch").alias("batch"))
    given_up = F.col("last") + F.expr(f"INTERVAL {timeout_minutes} MINUTES")
    lost = F.lit(False) if as_of is None else (F.col("best.rank") < max(ORDER.values())) & F.coalesce(given_up <= as_of, F.lit(False))
    return out.select(
        "job", "batch",
        F.when(lost, "failed").otherwise(F.col("best.status")).alias("status"),
        F.when(lost, given_up).otherwise(F.col("best.ts")).alias("ts"),
        lost.alias("timed_out"),
    )


def newest_changes(changes: DataFrame) -> DataFrame:
    """The end state of each job from the rows that ``job_changes`` has given so far: that of the last word heard, given up or not."""
    by = F.struct("heard", "timed_out", _rank(F.col("status")), "ts", "status")
    return changes.groupBy("job").agg(F.max_by(F.struct("batch", "status", "ts", "timed_out"), by).alias("v")).select("job", "v.*")


# ---------------------------------------------------------------- batches


class _Batches(StatefulProcessor):
    """Counts of ended jobs; a batch is complete once as many ended as it has."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tally = handle.getValueState("tally", "total long, success long, partial long, failed long, us long, told boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, *counts, us, told = self.tally.get() if self.tally.exists() else (None, 0, 0, 0, 0, False)
        for part in rows:
            known = part["total"].dropna()
            total = int(known.max()) if len(known) else total
            ended = part["status"].dropna()
            counts = [n + int((ended == s).sum()) for n, s in zip(counts, ("success", "partial", "failed"), strict=True)]
            us = max(us, int(part["us"].max()))
        complete = total is not None and sum(counts) >= total
        self.tally.update((total, *counts, us, told or complete))
        if complete and not told:
            yield pd.DataFrame({"batch": [key[0]], "total": [total], "success": [counts[0]], "partial": [counts[1]], "failed": [counts[2]], "ts": _stamp(us)})

    def close(self) -> None:
        pass


def batch_completions(changes: DataFrame, batches: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One row for each batch, at the moment the last of its jobs ends.

    ``changes`` are those of ``job_changes``, ``batches`` a stream of ``batch, total, ts``. Jobs count once, when they first
    end or are given up, so a later change from one end to another does not complete a batch twice. What waits is a row of counts for each batch, whatever the number of its jobs.
    A batch without jobs is complete at once.
    """
    with_state_store(changes.sparkSession)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    ended = changes.filter("ended AND batch IS NOT NULL").select("batch", "status", none("total", "long"), F.unix_micros("ts").alias("us"), "told")
    sizes = batches.select(F.col("batch").cast("string"), none("status", "string"), F.col("total").cast("long"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("ts").cast("timestamp").alias("told"))
    both = ended.unionByName(sizes.withWatermark("told", late))
    return both.groupBy("batch").transformWithStateInPandas(_Batches(), COMPLETIONS, "Append", "EventTime")


# ---------------------------------------------------------------- the cache


def cache_answers(requests: DataFrame, results: DataFrame, hours: int = 24, late: str = "10 minutes") -> DataFrame:
    """The cached result of each request: ``request, url, ts, scrape, created_at``, the last two null where the cache has none.

    ``requests`` are ``request, url, ts``, ``results`` are ``scrape, url, status, created_at``; both may be streams. A result answers if it is good
    and at most ``hours`` older than the request; of several the newest, of equally new ones the greatest id. A request is answered once the
    watermark has passed it, as a result from before it may still come; rows of either side that are later than ``late`` are dropped.
    Spark drops results from state once no request can ask for them.
    """
    asked = requests.select("request", "url", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    good = results.filter(F.col("status").isin("success", "partial"))
    good = good.select("scrape", F.col("url").alias("_url"), F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    fits = (F.col("url") == F.col("_url")) & (F.col("created_at") <= F.col("ts")) & (F.col("created_at") >= F.col("ts") - F.expr(f"INTERVAL {hours} HOURS"))
    found = asked.join(good, fits, "left")
    newest = F.max_by(F.struct("scrape", "created_at"), F.struct("created_at", "scrape")).alias("v")
    return found.groupBy("request", "url", "ts").agg(newest).select("request", "url", "ts", "v.scrape", "v.created_at")
