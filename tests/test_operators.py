"""Operators on small inputs with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagemill.functions import extract, text, urls, validate
from pagemill.functions import lexicon as L
from pagemill.operators import crawl, extraction, history, pages, records, relevance
from pagemill.plans import queries, record_queries
from pagemill.sources import html, tables
from pagemill.streaming import jobs


def one(spark, column, **given):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in given.items()))
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("link", "want"),
    [
        ("", None), ("mailto:a@b.c", None), ("#top", None), ("JavaScript:x()", None), ("/fees/?a=1#b", "https://www.u.edu/fees"),
        ("//cdn.u.edu/x/", "https://cdn.u.edu/x"), ("HTTP://A.b/", "HTTP://A.b/"), ("../x/./y", "https://www.u.edu/x/y"), ("z.pdf", "https://www.u.edu/p/z.pdf"),
    ],
)
def test_normalize(spark, link, want):
    assert one(spark, urls.normalize_url(F.col("l"), F.col("b")), l=link, b="https://www.u.edu/p/q") == want


def test_url_functions(spark):
    assert one(spark, urls.host(F.col("u")), u="https://WWW.Example.org:80/a?b") == "example.org:80"
    assert one(spark, urls.url_type(F.col("u")), u="https://x.org/feed") == "tuition"
    assert one(spark, urls.url_type(F.col("u")), u=None) == "other"
    # "fees" holds "fee": 10 for both, and one more as two strong words are there
    assert one(spark, urls.link_score(F.col("u"), F.col("t")), u="https://x.org/fees", t="") == 11
    assert one(spark, urls.link_score(F.col("u"), F.col("t")), u="https://x.org/news", t="Blog") == 0
    got = one(spark, urls.candidate_urls(F.col("b"), F.array(F.lit("fees"))), b="https://x.org/a/b")
    assert got == ["https://x.org/a/fees", "https://x.org/a/b/fees", "https://x.org/fees", "https://x.org/a/fees.html"]


def test_clean_lines(spark):
    raw = "Home\n\nab\n\nWe use cookies\nTuition fee cookies\nÉèà 12\n--- 12\nsame line\nsame line\nfee line\nfee line\r\nABOUT US\n![x](data:image/png;base64,AAAA) end"
    got = one(spark, text.clean_lines(F.col("t")), t=raw).split("\n")
    assert "We use cookies" not in got and "ABOUT US" not in got and "--- 12" not in got
    assert got.count("same line") == 1 and got.count("fee line") == 2 and "Éèà 12" in got
    assert one(spark, text.clean_lines(F.col("t")), t="") == ""


def test_truncate(spark):
    t = "x" * 100 + "\n\n" + "tuition fee " * 8 + "\n\n" + "y" * 100
    assert one(spark, text.truncate(F.col("t"), 400), t=t) == t
    got = one(spark, text.truncate(F.col("t"), 190), t=t)
    assert got.startswith("tuition fee") and "x" not in got.split("\n")[0] and "truncated" in got
    big = "z" * 13000
    assert "[...content truncated...]" in one(spark, text.truncate(F.col("t")), t=big)


def test_extraction(spark):
    t = "IELTS score of 6.5 overall, at least 6.0. Tuition: £9,250 per year for home students\nInternational fee: £21,000. Duration 2 years full-time. Apply by 15 January 2025."
    h = one(spark, extract.hints(F.col("t")), t=t)
    assert h["ielts"] == "IELTS score of 6.5 overall, no band below 6.0"
    assert h["domestic_fee"] is None or h["domestic_fee"].startswith("£")
    assert h["international_fee"] == "£21,000"
    assert h["deadlines"] == ["15 January 2025"]
    assert h["duration"].startswith("2 years")
    assert one(spark, extract.json_object(F.col("r"), "a INT, b STRING"), r='Sure:\n```json\n{"a": 1}\n```').asDict() == {"a": 1, "b": None}
    assert one(spark, extract.json_object(F.col("r"), "a INT"), r="nothing") is None
    assert one(spark, extract.currency(F.array(F.lit("£5"), F.lit("USD 7"), F.lit("$9"))), x=1) == "USD"
    assert one(spark, extract.hint_lines(extract.hints(F.col("t"))), t="") == ""


def test_validation(spark):
    check = lambda d, g: one(spark, validate.duration_verdict(F.col("d"), F.col("g")), d=d, g=g)
    assert [check("1 year", "PhD"), check("18 months", "Master"), check("9 years", "undergraduate"), check("long", "PhD"), check(None, "PhD"), check("1 year", None)] == ["implausible", "ok", "long", "unclear", None, "ok"]
    assert one(spark, validate.with_warnings(F.col("n"), F.array(F.lit("a"), F.lit("b"))), n="x") == "x. Validation warnings: a; b"


def test_gaps(spark):
    e = "struct(cast(null as string) ielts, cast(null as string) toefl, cast(null as string) pte, cast(null as string) duolingo, 'only notes' notes)"
    f = "struct('£9' domestic, cast(null as string) international)"
    row = spark.sql(f"SELECT {e} e, {f} f, cast(null as string) d, 'x' m")
    missing = records.missing_fields(F.col("e"), F.col("f"), F.col("d"), F.col("m"))
    got = row.select(missing.alias("m"), records.suggested_pages(missing, F.array(F.lit("x-ielts"))).alias("s")).first()
    assert got.m == ["english_requirements", "application_deadlines"]
    assert got.s == ["english-language-requirements", "language-requirements", "english-requirements", "toefl", "language-proficiency"]


def test_merge_of_empty_lists_and_ties(spark):
    rows = spark.createDataFrame([(1, 1, "a", None, ["May", " May", ""]), (1, 2, "b", "v", []), (2, 1, "c", None, None)], "k int, o int, src string, v string, l array<string>")
    got = {r.k: r for r in records.merge_records(rows, "k", "o", "src", ["v"], ["l"]).collect()}
    assert got[1].v == "v" and got[1].l == ["May"] and got[1].field_sources == {"v": "b", "l": "a"}
    assert got[2].v is None and got[2].l is None and got[2].field_sources == {}


def test_page_filters(spark):
    rows = spark.createDataFrame([(1, "word " * 40), (2, "404 " + "word " * 40), (3, "few words"), (4, None)], "id int, content string")
    assert [r.id for r in pages.useful_pages(rows).collect()] == [1]
    assert one(spark, pages.blocked(F.col("h")), h="Please enable cookies") is True
    assert one(spark, pages.blocked(F.col("h")), h="just a moment") is False
    same = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "id int, t string").withColumn("g", F.lit(0))
    assert sorted(r.id for r in pages.first_copies(same, "t", "id", ["g"]).collect()) == [1, 3, 5]


def test_html_text():
    page = "<html><body><nav>menu</nav><main><h1>Fees</h1><table><tr><th>A</th><th>B</th></tr><tr><td><span>1,0</span>&nbsp;<p>x</p><td>2 &amp; 3</table><p hidden>kept</main><footer>end</footer></body></html>"
    got = html.html_text(page)
    assert "| A | B |" in got and "| 1,0 x | 2 & 3 |" in got and "kept" in got and "menu" not in got and "end" not in got
    assert html.html_text(None) == "" and html.html_text("plain") == "plain"


def test_html_column(spark):
    rows = spark.createDataFrame([(1, "<body><p>a<script>b</script></body>"), (2, None)], "id int, html string")
    assert [r.content.strip() for r in html.add_text(rows).orderBy("id").collect()] == ["a", ""]


def test_crawl_against_queue(spark):
    """The wave joins against a plain queue."""
    words = {p: 60 if p % 5 else 10 for p in range(30)}
    digest = {p: p % 11 for p in range(30)}
    edges = [(p, q) for p in range(30) for q in (2 * p + 1, 2 * p + 2, (7 * p + 3) % 30) if q < 30]
    seen, kept, texts, wave = {1}, [], set(), [1]
    for depth in range(4):
        following = []
        for p in sorted(wave):
            if words[p] < 50 or digest[p] in texts:
                continue
            texts.add(digest[p])
            kept.append((p, depth))
            following.append(p)
        wave = sorted({q for p, q in edges if p in following} - seen)
        seen |= set(wave)
    seeds = spark.createDataFrame([(0, 1)], "crawl_id int, page int")
    found = crawl.crawl(seeds, spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(p, words[p], digest[p]) for p in range(30)], "page int, words int, digest int"), max_depth=3)
    assert sorted((r.page, r.depth) for r in found.collect()) == sorted(kept)


def test_crawl_query_reaches(spark):
    rows = queries.crawl_waves(spark, "/root/testdata/sf0.001").collect()
    assert rows and {r.depth for r in rows} <= set(range(5))


def test_history(spark):
    rows = spark.createDataFrame([(i, f"Uni {i}", None, "success" if i % 2 else "failed", dt.datetime(2024, 1, i)) for i in range(1, 6)], "scrape int, university_name string, program_name string, status string, created_at timestamp")
    assert [r.scrape for r in history.history_page(rows, status="success", limit=2).collect()] == [5, 3]
    assert history.history_count(rows, search="nothing").first().asDict() == {"total": 0, "pages": 1}
    with pytest.raises(ValueError):
        history.history_page(rows, limit=101)


def test_new_results_and_versions(spark, tmp_path):
    first = tables.new_results(spark.createDataFrame([("http://a",), ("http://b",)], "url string"))
    path = str(tmp_path / "results")
    tables.append_versions(first, path)
    got = spark.read.parquet(path).select("scrape_id", "status", "university_name", "url_requested").collect()
    assert len({r.scrape_id for r in got}) == 2 and {r.status for r in got} == {"processing"} and {r.university_name for r in got} == {None}


def test_streams(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, m), u) for m, u in ((0, "a"), (1, "a"), (2, "b"), (3, "a"))]
    spark.createDataFrame(rows, "ts timestamp, url string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, url string").parquet(str(tmp_path / "in"))
    for name, df in (("first", jobs.first_in_window(stream, "url")), ("rates", jobs.rates(stream, "url")), ("sessions", jobs.sessions(stream, "url"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        assert q.exception() is None
    assert sorted(r.url for r in spark.table("first").collect()) == ["a", "b"]


def test_job_state(spark):
    log = spark.createDataFrame([("x", "running", 2), ("x", "processing", 1), ("y", "success", 3), ("y", "running", 4)], "scrape_id string, status string, ts int")
    assert {r.scrape_id: r.status for r in jobs.job_state(log).collect()} == {"x": "running", "y": "success"}


def queued(seeds, links, words, digest, signs, max_depth, max_pages, enough):
    """The crawl as a plain queue, for each seed."""
    out = []
    for crawl_id, start in seeds:
        seen, texts, kept, wave = {start}, set(), [], [start]
        for depth in range(max_depth + 1):
            following = []
            for p in sorted(wave):
                if words[p] >= 50 and digest[p] not in texts:
                    texts.add(digest[p])
                    following.append(p)
                    kept.append((p, depth))
            if len(kept) >= max_pages or (depth >= 1 and len(kept) >= enough and all(any(s[p] for p, _ in kept) for s in signs)):
                break
            best = {}
            for p, q, score in links:
                if p in following and score > 0 and q not in seen:
                    best[q] = max(best.get(q, 0), score)
            wave = sorted(best, key=lambda q: (-best[q], q))[: max_pages - len(kept)]
            seen |= set(wave)
        out += [(crawl_id, p, d) for p, d in kept]
    return sorted(out)


@pytest.mark.parametrize(("max_pages", "enough"), [(9, 100), (40, 4)])
def test_crawl_with_scores_slots_and_needs(spark, max_pages, enough):
    n = 40
    words = {p: 60 if p % 7 else 10 for p in range(n)}
    digest = {p: p % 29 for p in range(n)}
    links = [(p, (3 * p + 7 * k) % n, (p + k) % 4) for p in range(n) for k in range(5)] + [(p, 1, 1) for p in range(n)]
    signs = [{p: p % 3 == 0 for p in range(n)}, {p: p % 5 == 0 for p in range(n)}]
    seeds = [(100 + p, p) for p in (1, 2, 5, 7)]
    known = spark.createDataFrame([(p, words[p], digest[p], signs[0][p], signs[1][p]) for p in range(n)], "page int, words int, digest int, a boolean, b boolean")
    got = crawl.crawl(spark.createDataFrame(seeds, "crawl_id int, page int"), spark.createDataFrame(links, "src int, dst int, score int"), known, 3, max_pages, needs=["a", "b"], enough=enough)
    want = queued(seeds, links, words, digest, signs, 3, max_pages, enough)
    assert sorted((r.crawl_id, r.page, r.depth) for r in got.collect()) == want and len(want) > 20


def test_best_fetch_stops_at_a_blocked_first_kind(spark):
    rows = [("a", 1, 403, 5, True), ("a", 2, 200, 900, False), ("b", 1, 200, 100, False), ("b", 2, 200, 300, True), ("c", 1, 500, 900, None)]
    got = pages.best_fetch(spark.createDataFrame(rows, "url string, tier int, status_code int, word_count int, blocked boolean"))
    assert {r.url: r.tier for r in got.collect()} == {"a": 1, "b": 2, "c": 1}


def test_labels_keep_given_types(spark):
    rows = [(1, 0, "http://h/x/fees", "", None), (2, 0, "http://h/x/fees/", "", "news"), (3, 1, "http://h/", None, ""), (4, 0, "http://h/x/fees", "", "")]
    got = pages.label_pages(spark.createDataFrame(rows, "page_id int, scrape int, url string, content string, page_type string"), "scrape")
    assert {r.page_id: r.label for r in got.collect()} == {1: "MAIN PAGE", 2: "FEES (NEWS)", 3: "MAIN PAGE", 4: "FEES (TUITION)"}


def test_links_of_a_page_are_each_its_first(spark):
    anchors = "".join(f'<a href="{h}">{t}</a>' for h, t in (("/a", "one"), ("/A/", "two"), ("b", "<b>three</b>"), ("#x", "no"), ("/x.pdf", "no"), ("http://o.org/a", "no"), ("../p", "self"), ("/c?d=1#e", "four")))
    got = pages.page_links(spark.createDataFrame([(1, "https://www.h.org/p", anchors), (2, "https://h.org", None), (3, None, anchors)], "page_id int, url string, html string")).collect()
    assert [(r.page_id, r.pos, r.target, r.link_text) for r in got] == [(1, 0, "https://www.h.org/a", "one"), (1, 2, "https://www.h.org/b", "three"), (1, 7, "https://www.h.org/c", "four")]


def test_line_repeats_are_dropped_unless_relevant(spark):
    many = "\n".join(["same line here"] * 3 + ["Tuition fees are high"] * 2 + ["", "", "other line", "same line here"])
    assert one(spark, text.clean_lines(F.col("t")), t=many) == "same line here\nTuition fees are high\nTuition fees are high\n\nother line"


def test_html_is_told_from_text(spark):
    for t, want in (("<p>", True), ("a < b > c", False), ("<" + "x" * 200 + ">", False), (None, False), ("", False)):
        assert one(spark, text.looks_like_html(F.col("t")), t=t) is want


def test_page_texts_against_a_plain_reader(spark):
    """Every page of the smallest tables: what the query reads is what stands between the tags of its article."""
    import hashlib
    import html as entities
    import re

    got = {r.page_id: r for r in record_queries.page_texts(spark, "/root/testdata/sf0.001").collect()}
    raw = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert set(got) == set(raw)
    plain = []
    for i, page in raw.items():
        body = re.search(r"(?s)<article>(.*?)</article>", page or "")
        if body and "<table" not in body[1]:
            inner = re.sub(r"(?s)<(script|style|nav|footer|aside|header|form|svg|noscript|iframe)\b.*?</\1>|<!--.*?-->", "", body[1])
            plain.append((i, "\n".join(entities.unescape(x) for x in re.split(r"<[^>]*>", inner) if x)))
    assert len(plain) > 20
    cleaned = spark.createDataFrame(plain, "page_id long, t string").select("page_id", text.clean_lines(F.col("t")).alias("t")).collect()
    same = sum(got[r.page_id].text_md5 == hashlib.md5(r.t.encode()).hexdigest() for r in cleaned)
    assert same == len(cleaned)


def test_section_hints_fill_gaps_and_fall_back(spark):
    talk = "=== PROGRAM INFORMATION ===\nIELTS 6.5 overall.\n=== OTHER ===\nIELTS 5.0 overall. PTE Academic 58 overall."
    heads = F.array(F.lit("=== OTHER ==="), F.lit("=== PROGRAM INFORMATION ==="), F.lit("=== MISSING ==="))
    h = one(spark, extract.section_hints(F.col("t"), heads, width=47), t=talk)
    assert h.ielts.startswith("IELTS 6.5") and h.pte is None
    h = one(spark, extract.section_hints(F.col("t"), heads), t=talk)
    assert h.ielts.startswith("IELTS 6.5") and h.pte.startswith("PTE Academic 58")
    h = one(spark, extract.section_hints(F.col("t"), F.array(F.lit("=== NONE ==="))), t=talk)
    assert h.ielts.startswith("IELTS 6.5")


def test_extraction_checks_fills_and_notes(spark):
    given = spark.createDataFrame([(1, "IELTS 6.5 overall. Tuition for home students is £9,000 per year.\n\nDuration 1 year. A GPA of 3.2 is the minimum for entry."), (2, None)], "k int, text string")
    record = "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in [*((n, {"program_duration": "'1 year'", "degree_level": "'PhD'", "confidence_notes": "'guess'"}.get(n, "cast(null as string)")) for n in L.SCALAR_FIELDS), ("english_requirements", "named_struct('ielts', 'IELTS 12', 'toefl', cast(null as string), 'pte', cast(null as string), 'duolingo', cast(null as string), 'notes', cast(null as string))"), ("tuition_fees", "cast(null as struct<domestic:string,international:string,currency:string,notes:string>)")]) + ")"
    rows = extraction.extract_records(extraction.contexts(given).withColumn("given", F.expr(f"case when k = 1 then {record} end")), given="given")
    got = {r.k: r for r in rows.collect()}
    r = got[1].record
    assert r.english_requirements.ielts == "IELTS 12" and r.tuition_fees.domestic == "£9,000 per year" and r.tuition_fees.currency == "GBP"
    assert r.program_duration == "1 year" and r.min_academic_requirement.startswith("GPA of 3.2")  # the given duration goes, the text's comes in
    assert r.confidence_notes == "guess. Validation warnings: Duration: Duration of 1.0 years is implausible for a PhD — likely hallucinated; English requirements: IELTS score 12.0 outside normal range (4.0-9.0)"
    assert got[2].record.program_duration is None and got[2].hint_block == "" and got[2].context == ""


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é"), (2, None), (3, "")], "scrape int, name string")
    with pytest.raises(ValueError, match="ids"):
        records.selected_results(rows)
    with pytest.raises(LookupError):
        records.selected_results(rows, ids=rows.filter("scrape > 5"))
    assert [r.scrape for r in records.selected_results(rows, every=True, limit=2).collect()] == [1, 2]
    assert sorted(r.scrape for r in records.selected_results(rows, ids=rows.filter("scrape > 1")).collect()) == [2, 3]
    assert [r.json for r in records.json_rows(rows).orderBy("scrape").collect()] == ['{"scrape":1,"name":"é"}', '{"scrape":2,"name":null}', '{"scrape":3,"name":""}']
    tables.write_csv(rows.coalesce(1), str(tmp_path / "csv"), bom=True)
    assert next((tmp_path / "csv").glob("part-*")).read_bytes().startswith(b"\xef\xbb\xbfscrape,name\n")
    tables.write_json(rows.coalesce(1), str(tmp_path / "json"))
    assert '{"scrape":2,"name":null}' in next((tmp_path / "json").glob("part-*")).read_text()
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    assert [bytes(r.content) for r in tables.read_binary(spark, str(tmp_path)).collect()] == [b"%PDF"]


def test_lists_and_deletes(spark):
    rows = spark.createDataFrame([(1, "Uni.A", None, "success", dt.datetime(2024, 1, 1), "http://a", ["x", "y"]), (2, None, "uni b", "failed", dt.datetime(2024, 1, 2), None, None)], "scrape int, university_name string, program_name string, status string, created_at timestamp, url_requested string, source_urls array<string>")
    assert [(r.scrape, r.source_count) for r in history.summary_page(rows).collect()] == [(2, 0), (1, 2)]
    assert [r.scrape for r in history.containing(rows, "NI.a").collect()] == [1] and history.containing(rows, " ").count() == 2
    assert [r.scrape for r in history.delete_where(rows, url="http://a").collect()] == [2]
    assert [r.scrape for r in history.delete_where(rows, pattern="^http").collect()] == [2]
    with pytest.raises(ValueError, match="either"):
        history.delete_where(rows)


def test_waits(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    calls = [(1, "k", at(0), True), (2, "k", at(5), False), (3, "k", at(12), True), (4, "k", at(30), True), (5, "o", at(30), True)]
    got = {r.id: (r.window_wait, r.gap_wait, r.cooldown_wait, r.wait) for r in history.call_waits(spark.createDataFrame(calls, "id int, key string, ts timestamp, good boolean"), "key", "ts", "id").collect()}
    assert got == {1: (0, 0, 0, 0), 2: (0, 15, 5, 15), 3: (0, 13, 0, 13), 4: (30, 2, 0, 30), 5: (0, 0, 0, 0)}


def test_attribution_names_pages_of_groups(spark):
    sources = F.create_map(F.lit("english_requirements"), F.lit("e"))
    english = F.struct(F.lit("6").alias("ielts"), F.lit(None).cast("string").alias("toefl"))
    out = relevance.field_sources({"english_requirements": english, "program_name": F.lit("p"), "scholarships": F.lit(None).cast("string")}, sources, F.lit("final"), {"english_requirements": ["ielts", "toefl"]})
    assert one(spark, out, t="") == {"english_requirements": "e", "english_requirements.ielts": "e", "program_name": "final"}
