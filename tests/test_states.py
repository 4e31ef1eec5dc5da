"""Stateful streams, partial updates, captures, look-ups and free-form documents."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import history, updates
from pagemill.sources import captures, documents, lookups
from pagemill.streaming import states

BASE = dt.datetime(2026, 1, 1)
LOG = "job string, batch string, status string, ts timestamp"


def rows_of(df, *columns):
    return sorted(map(repr, df.select(*columns or df.columns).collect()))


def write_parts(spark, rows, schema, path, parts):
    """Each part as a file of its own, in order."""
    for k in range(parts):
        spark.createDataFrame(rows[k::parts] if rows else [], schema).coalesce(1).write.mode("append").parquet(path)


def run(stream, out, checkpoint):
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def job_log(jobs, seed):
    rng, rows = random.Random(seed), []
    for j in range(jobs):
        t = BASE + dt.timedelta(minutes=rng.randrange(600))
        for status in ["processing", *(["running"] * (rng.random() < 0.9)), *([rng.choice(["success", "partial", "failed"])] if rng.random() < 0.7 else [])]:
            rows.append((f"j{j}", f"b{j % 4}", status, t))
            t += dt.timedelta(minutes=rng.randrange(0, 25))
    rows += [rows[0]] * 3 + [("j1", "b1", "unknown", BASE), (None, "b1", "running", BASE), ("j2", "b2", "running", None), ("j3", None, "partial", BASE + dt.timedelta(minutes=700)), ("j3", "b3", "failed", BASE + dt.timedelta(minutes=700))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_ends_with_the_states_of_the_table(spark, tmp_path, parts):
    rows = job_log(40, parts)
    write_parts(spark, rows, LOG, str(tmp_path / "in"), parts)
    table = spark.read.schema(LOG).parquet(str(tmp_path / "in"))
    log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes = states.job_changes(log, late="20 hours")
    run(changes, str(tmp_path / "out"), str(tmp_path / "state"))
    got = states.newest_changes(spark.read.parquet(str(tmp_path / "out")))
    as_of = F.lit(max(r[3] for r in rows if r[3])) - F.expr("INTERVAL 20 HOURS")
    assert rows_of(got, "job", "batch", "status", "ts", "timed_out") == rows_of(states.end_states(table, as_of), "job", "batch", "status", "ts", "timed_out")


def test_jobs_share_buckets(spark, tmp_path):
    rows = job_log(60, 7)
    write_parts(spark, rows, LOG, str(tmp_path / "in"), 3)
    log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes = states.job_changes(log, late="20 hours", buckets=2)
    query = changes.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    # what Python is called for, and has as state, is a bucket and not a job
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) <= 2 * 2
    as_of = F.lit(max(r[3] for r in rows if r[3])) - F.expr("INTERVAL 20 HOURS")
    want = states.end_states(spark.read.schema(LOG).parquet(str(tmp_path / "in")), as_of)
    got = states.newest_changes(spark.read.parquet(str(tmp_path / "out")))
    assert want.count() == 60 and rows_of(got, *want.columns) == rows_of(want)


def test_restart_timers_and_jobs_that_come_back(spark, tmp_path):
    at = lambda m: BASE + dt.timedelta(minutes=m)
    first = [("slow", "b", "running", at(0)), ("back", "b", "running", at(0)), ("early", "b", "success", at(1)), ("clock", "x", "processing", at(50))]
    second = [("back", "b", "processing", at(61)), ("early", "b", "running", at(45)), ("clock", "x", "processing", at(62))]
    third = [("back", "b", "partial", at(63)), ("slow", "b", "success", at(2)), ("clock", "x", "processing", at(150))]  # slow's is late by then
    where = [str(tmp_path / x) for x in ("in", "out", "state")]
    for part, rows in enumerate((first, second, third)):
        write_parts(spark, rows, LOG, where[0], 1)
        log = spark.readStream.schema(LOG).parquet(where[0])
        run(states.job_changes(log, late="5 minutes", timeout_minutes=30), *where[1:])  # the same checkpoint each time
        got = {r.job: (r.status, r.timed_out) for r in states.newest_changes(spark.read.parquet(where[1])).collect()}
        if part == 0:
            assert got == {"slow": ("failed", True), "back": ("failed", True), "early": ("success", False), "clock": ("processing", False)}
        if part == 1:
            assert got["back"] == ("running", False) and got["early"] == ("success", False)
    assert got["slow"] == ("failed", True) and got["back"] == ("partial", False) and got["clock"] == ("processing", False)
    ended = spark.read.parquet(where[1]).filter("ended").groupBy("job").count().collect()
    assert {r.job: r["count"] for r in ended} == {"slow": 1, "back": 1, "early": 1}


def test_batches_complete_once(spark, tmp_path):
    at = lambda m: BASE + dt.timedelta(minutes=m)
    log = [(f"{b}{k}", b, s, at(k)) for b, ends in (("a", ["success", "partial", "failed"]), ("c", ["success", "running"])) for k, s in enumerate(ends)]
    sizes = [("a", 3, at(0)), ("c", 2, at(0)), ("empty", 0, at(0))]
    more = [("a0", "a", "failed", at(5)), ("c1", "c", "success", at(6)), ("a1", "a", "running", at(7))]
    paths = [str(tmp_path / x) for x in ("log", "sizes", "out", "state")]
    write_parts(spark, sizes, "batch string, total long, ts timestamp", paths[1], 1)
    seen = []
    for rows in (log, more):
        write_parts(spark, rows, LOG, paths[0], 1)
        changes = states.job_changes(spark.readStream.schema(LOG).parquet(paths[0]), late="1 day")
        batches = spark.readStream.schema("batch string, total long, ts timestamp").parquet(paths[1])
        run(states.batch_completions(changes, batches, late="1 day"), *paths[2:])
        seen.append({(r.batch, r.total, r.success, r.partial, r.failed) for r in spark.read.parquet(paths[2]).collect()})
    assert seen[0] == {("a", 3, 1, 1, 1), ("empty", 0, 0, 0, 0)} and seen[1] == seen[0] | {("c", 2, 2, 0, 0)}
    assert spark.read.parquet(paths[2]).count() == 3


def test_cache_stream_answers_as_the_table(spark, tmp_path):
    rng = random.Random(6)
    asked = [(i, f"u{i % 7}", BASE + dt.timedelta(minutes=rng.randrange(4000))) for i in range(120)]
    done = [(i, f"u{rng.randrange(9)}", rng.choice(["success", "partial", "failed"]), BASE + dt.timedelta(minutes=rng.randrange(4000))) for i in range(80)]
    done += [(900, "u1", "success", asked[1][2]), (901, "u1", "success", asked[1][2]), (902, "u2", "success", asked[2][2] - dt.timedelta(hours=24)), (903, None, "success", BASE)]
    r_type, s_type = "request long, url string, ts timestamp", "scrape long, url string, status string, created_at timestamp"
    end = BASE + dt.timedelta(days=30)  # lets the watermark pass all requests
    write_parts(spark, [*asked, (-1, "end", end)], r_type, str(tmp_path / "r"), 2)
    write_parts(spark, [*done, (-1, "end", "failed", end), (-2, "end", "success", end)], s_type, str(tmp_path / "s"), 2)
    read = lambda x, t, how: how.schema(t).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / x))
    stream = states.cache_answers(read("r", r_type, spark.readStream), read("s", s_type, spark.readStream), late="4 days")
    run(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    table = states.cache_answers(read("r", r_type, spark.read), read("s", s_type, spark.read)).filter("request >= 0")
    assert rows_of(got.filter("request >= 0")) == rows_of(table) and table.count() == 120
    for i in (1, 2):
        results = spark.createDataFrame(done, s_type)
        want = history.cached(results, F.lit(asked[i][2])).filter(F.col("url") == asked[i][1]).first()
        answer = table.filter(F.col("request") == i).first()
        assert (answer.scrape, answer.created_at) == (want.scrape, want.created_at)


# ------------------------------------------------------------ partial updates

FIELDS = "status string, pages long, fees struct<domestic:string>, sources map<string,string>"


def test_updates_by_field(spark):
    docs = [
        ("a", 1, '{"status": "processing", "pages": 3, "sources": {"x": "y"}}'), ("a", 3, '{"status": null}'), ("a", 2, '{"status": "running", "fees": {"domestic": "1"}, "other": 5}'),
        ("b", 1, "no json"), ("b", 2, None), ("c", 5, '{"pages": "not a number"}'), ("c", 4, '{"pages": 7}'), (None, 1, '{"pages": 1}'), ("a", 3, '{"status": null}'),
    ]
    log = updates.json_updates(spark.createDataFrame(docs, "scrape string, n int, doc string").repartition(4), "scrape", ["n"], "doc", FIELDS)
    got = {r.scrape: r for r in updates.current(log, "scrape").collect()}
    assert (got["a"].status, got["a"].pages, got["a"].fees.domestic, got["a"].sources, got["a"].set_fields) == (None, 3, "1", {"x": "y"}, ["status", "pages", "fees", "sources"])
    assert got["b"].set_fields == [] and (got["c"].pages, got["c"].set_fields) == (None, ["pages"]) and got[None].pages == 1
    halves = [updates.merged_updates(log.filter(f), "scrape") for f in ("scrape <> 'a' OR scrape IS NULL", "scrape = 'a'")]
    again = updates.current(halves[1].unionByName(halves[0]).unionByName(log), "scrape")
    assert rows_of(again) == rows_of(updates.current(log, "scrape"))


def test_update_table_survives_replays_and_compaction(spark, tmp_path):
    rng, state = random.Random(8), {}
    table = updates.UpdateTable(spark, str(tmp_path / "t"), "scrape string", FIELDS, "n long")
    assert table.log().count() == 0 and table.compact() is None and table.vacuum() == 0
    for batch in range(6):
        docs = []
        for n in range(batch * 100, batch * 100 + 100):
            key, change = f"k{rng.randrange(12)}", rng.choice([{"status": f"s{n}"}, {"pages": n}, {"status": None}, {"pages": n, "fees": {"domestic": str(n)}}])
            docs.append((key, n, json.dumps(change)))
            state.setdefault(key, {}).update(change)
        log = updates.json_updates(spark.createDataFrame(docs, "scrape string, n long, doc string"), "scrape", ["n"], "doc", FIELDS)
        table.writer()(log, batch)
        if batch in (1, 4):
            table.writer()(log, batch)  # a replay
        if batch == 2:
            assert table.compact() == 2
        if batch == 3:
            assert table.vacuum() == 3
    want = {k: (v.get("status"), v.get("pages"), (v.get("fees") or {}).get("domestic")) for k, v in state.items()}
    read = lambda: {r.scrape: (r.status, r.pages, r.fees.domestic if r.fees else None) for r in updates.current(table.log(), "scrape").collect()}
    assert read() == want
    assert table.compact() == 5 and read() == want
    (tmp_path / "t" / "compact" / f"{9:020d}").mkdir()  # one that was cut off
    assert read() == want and table.vacuum() == 4 and read() == want


def test_update_stream(spark, tmp_path):
    docs = [(f"k{i % 5}", i, json.dumps({"pages": i} if i % 2 else {"status": str(i)})) for i in range(40)]
    write_parts(spark, docs, "scrape string, n long, doc string", str(tmp_path / "in"), 4)
    table = updates.UpdateTable(spark, str(tmp_path / "t"), "scrape string", FIELDS, "n long")
    for _ in range(2):
        stream = spark.readStream.schema("scrape string, n long, doc string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        log = updates.json_updates(stream, "scrape", ["n"], "doc", FIELDS)
        log.writeStream.foreachBatch(table.writer()).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {r.scrape: (r.status, r.pages) for r in updates.current(table.log(), "scrape").collect()}
    assert got == {f"k{k}": (str(max(i for i in range(40) if i % 5 == k and i % 2 == 0)), max(i for i in range(40) if i % 5 == k and i % 2)) for k in range(5)}


# ------------------------------------------------------------ captures

PAGES = [
    ("https://WWW.a.org/x?y#z", "<p>é\r\n\r\nHTTP/1.1 200</p>" * 20, 200, "text/html", BASE), ("https://a.org/2", "", 403, None, BASE + dt.timedelta(days=1)), (None, "no address", None, "text/html; charset=nothing", None),
    ("https://b.org/\n%0A", None, 503, "text/html", BASE + dt.timedelta(days=2)), ("c.org", "x" * 300_000, 200, "a\r\nb", BASE), ("https://a.org/2", "", 403, None, BASE + dt.timedelta(days=1)), ("https://d.org/", "ü", 200, "text/html;charset=UTF-8", BASE + dt.timedelta(days=9)),
]
PAGE_TYPE = "url string, html string, status_code int, content_type string, fetched_at timestamp"


def test_captures_round_trip(spark, tmp_path):
    where = f"file://{tmp_path / 'c'}"
    table = spark.createDataFrame(PAGES, PAGE_TYPE).withColumn("other", F.lit(1))
    captures.write_captures(table, where, 3)
    got = captures.read_captures(spark, where)
    assert rows_of(got, *PAGE_TYPE.replace(" string", "").replace(" int", "").replace(" timestamp", "").split(", ")) == rows_of(table.drop("other"))
    assert {(r.host, r.error) for r in got.collect()} == {("a.org", None), ("a.org", "Access denied (HTTP 403)"), ("", None), ("b.org", "Access denied (HTTP 503)"), ("d.org", None)}
    captures.write_captures(table.limit(0), where)
    assert captures.read_captures(spark, where).count() == len(PAGES)
    captures.write_captures(table.limit(2), where, mode="overwrite")
    assert captures.read_captures(spark, where).count() == 2


def test_captures_read_no_more_files_than_needed(spark, tmp_path):
    where = str(tmp_path / "c")
    rows = [(f"https://h{k:02d}.org/{i}", f"{k} {i}", 200, None, BASE + dt.timedelta(days=k)) for k in range(20) for i in range(5)]
    captures.write_captures(spark.createDataFrame(rows, PAGE_TYPE), where, 10)
    every = captures.read_captures(spark, where)
    assert every.count() == 100 and every.rdd.getNumPartitions() >= 8
    some = captures.read_captures(spark, where, hosts=["h03.org", "absent.org"])
    assert some.count() == 5 and some.rdd.getNumPartitions() <= 2
    late = captures.read_captures(spark, where, since=BASE + dt.timedelta(days=17), until=BASE + dt.timedelta(days=19))
    assert late.count() == 10 and late.rdd.getNumPartitions() <= 3
    assert every.filter("host = 'h03.org'").count() == 5 and every.count() == 100


def test_captures_stream_and_what_failed_tasks_leave(spark, tmp_path):
    where, out, state = (str(tmp_path / x) for x in ("c", "o", "s"))
    table = spark.createDataFrame(PAGES, PAGE_TYPE)
    total = 0
    for n in (3, 7, 0):
        captures.write_captures(table.limit(n), where, 2)
        left = next((tmp_path / "c" / "data").iterdir())
        (tmp_path / "c" / "data" / f"left-{n}.http.zst").write_bytes(left.read_bytes())  # in no manifest
        run(spark.readStream.format("captures").option("path", where).load(), out, state)
        total += n
        assert spark.read.parquet(out).count() == total
    bad = captures.write_captures  # a sink whose rows fail leaves no manifest
    with pytest.raises(Exception, match="boom|SparkRuntime"):
        bad(table.withColumn("url", F.when(F.col("status_code") == 503, F.raise_error(F.lit("boom"))).otherwise(F.col("url"))), where)
    assert captures.read_captures(spark, where).count() == total


@pytest.mark.parametrize("spoil", [lambda b: b[: len(b) // 2], lambda b: b.replace(b"Content-Length: 5", b"Content-Length: 9"), lambda b: b.replace(b"GET ", b"PUT ")])
def test_damaged_captures_are_found(spoil):
    import io

    import zstandard

    out = io.BytesIO()
    captures.write_exchange(out, "https://a.org", None, 5, 200, "text/html; charset=latin-1", "hello")
    packed = lambda b: io.BytesIO(zstandard.ZstdCompressor().compress(b))
    assert list(captures.read_exchanges(packed(out.getvalue()))) == [("https://a.org", None, 5, 200, "text/html; charset=latin-1", "hello")]
    with pytest.raises(ValueError):
        list(captures.read_exchanges(packed(spoil(out.getvalue()))))


# ------------------------------------------------------------ look-ups


def scanned(df):
    """Rows that the scan of a plan without exchanges gave on."""
    df.collect()
    leaves, out = df._jdf.queryExecution().executedPlan().collectLeaves(), 0
    for k in range(leaves.size()):
        metric = leaves.apply(k).metrics().get("numOutputRows")
        out += metric.get().value() if metric.isDefined() else 0
    return out


def test_look_ups_read_few_rows(spark, tmp_path):
    path, n = str(tmp_path / "t"), 60_000
    rows = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("scrape"), F.sha2((F.col("id") % 20_000).cast("string"), 224).alias("url"), F.col("id").alias("v"), F.lit(1).alias("bucket"))
    rows = rows.unionByName(spark.createDataFrame([(None, "null", -1, 1)], rows.schema))
    lookups.write_lookup(rows, path, "scrape", also=["url"], buckets=8, row_group=64 << 10, expected=2000)
    keys = [r.scrape for r in rows.filter("v % 3000 = 7").collect()]
    found = lookups.look_up(spark, path, "scrape", [*keys, "absent", None, keys[0]], buckets=8)
    want = rows.filter(F.col("scrape").isin(keys)).drop("bucket")
    assert rows_of(found) == rows_of(want) and found.count() == 20
    assert scanned(found) < 0.5 * n  # row groups of ranges that hold a key
    urls = [r.url for r in rows.filter("v IN (5, 6)").collect()]
    by_url = lookups.look_up_where(spark, path, "url", urls)
    assert rows_of(by_url) == rows_of(rows.filter(F.col("url").isin(urls)).drop("bucket")) and by_url.count() == 6
    assert scanned(by_url) < 0.6 * n  # row groups whose bloom filter holds one
    many = rows.filter("v % 40 = 0").select("scrape").unionByName(spark.createDataFrame([(None,), ("absent",)], "scrape string"))
    joined = lookups.look_up(spark, path, "scrape", many.unionByName(many), buckets=8)
    assert joined.count() == n // 40 and rows_of(joined, "v") == rows_of(rows.filter("v % 40 = 0"), "v")
    assert lookups.look_up(spark, path, "scrape", [None], buckets=8).count() == 0 == lookups.look_up_where(spark, path, "url", []).count()


# ------------------------------------------------------------ free-form documents


@pytest.mark.parametrize(("path", "want"), [("a", "$['a']"), ("a.b[0].c", "$['a']['b'][0]['c']"), ("it's.x y", "$['it\\'s']['x y']")])
def test_variant_paths(path, want):
    assert documents.variant_path(path) == want


@pytest.mark.parametrize("path", ["", ".", ".a", "a[x]", "a[0"])
def test_no_variant_paths(path):
    with pytest.raises(ValueError, match="no path"):
        documents.variant_path(path)


def test_documents(spark, tmp_path):
    docs = ['{"a": {"b c": [1, {"d": "x"}]}, "n": null}', '{"a": {"b c": "2"}}', "[1]", "no", None, '{"n": ""}']
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i long, doc string").withColumn("doc", documents.as_document(F.col("doc")))
    got = documents.select_paths(rows, "doc", {"d": ("a.b c[1].d", "string"), "b": ("a.b c", "long"), "a": ("a", "string")}, keep=["i"]).orderBy("i").collect()
    assert [(r.d, r.b) for r in got] == [("x", None), (None, 2), (None, None), (None, None), (None, None), (None, None)] and json.loads(got[0].a) == {"b c": [1, {"d": "x"}]}
    cover = {r.path: (r.n, r.present, r.filled) for r in documents.path_coverage(rows, "doc", ["n", "a.b c", "z"]).collect()}
    assert cover == {"n": (6, 2, 0), "a.b c": (6, 2, 2), "z": (6, 0, 0)}
    assert "OBJECT" in documents.found_schema(rows.filter("i IN (0, 1)"), "doc").first()["schema"]
    documents.append_documents(rows, str(tmp_path / "d"))
    documents.append_documents(rows.limit(2).withColumn("extra", F.lit(5)).select("extra", "doc", "i"), str(tmp_path / "d"))
    merged = documents.read_documents(spark, str(tmp_path / "d"))
    assert merged.count() == 8 and merged.filter("extra = 5").count() == 2
