"""Queries over the given tables, one for each group of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import extract, text, urls, validate
from pagemill.functions import lexicon as L
from pagemill.operators import crawl, history, pages, records, relevance
from pagemill.plans import derived


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


# ------------------------------------------------------------ pages and links


def page_links_topk(spark, d):
    found = pages.top_links(pages.page_links(derived.pages(spark, d)))
    return found.select("page_id", "rank", "target", "score", F.col("pos").cast("long"))


def page_type_counts(spark, d):
    return derived.pages(spark, d).groupBy(urls.url_type(F.col("url")).alias("page_type")).agg(F.count("*").alias("n"))


def host_counts(spark, d):
    return _read(spark, d, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


def same_domain_pairs(spark, d):
    counts = _read(spark, d, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    return counts.select("host", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))


def normalized_urls(spark, d):
    base = F.regexp_replace("url", "[?#].*$", "")
    made = derived.pages(spark, d).select("page_id", base.alias("base"), F.posexplode(F.array(*map(F.lit, ["/a/b?x=1", "//h.org/q/", "mailto:x@y.org", "#top", "c/d.html", "../up/", "http://z.org/", ""]))).alias("pos", "link"))
    return made.select("page_id", F.col("pos").cast("long"), urls.normalize_url(F.col("link"), F.col("base")).alias("target"))


def pdf_links(spark, d):
    made = derived.pages(spark, d).select("page_id", F.concat("url", F.when(F.col("page_id") % 3 == 0, ".PDF").when(F.col("page_id") % 3 == 1, "/pdf/x").otherwise("")).alias("u"))
    return made.filter(urls.is_pdf(F.col("u"))).select("page_id", F.col("u").alias("pdf_url"))


def page_labels(spark, d):
    return pages.label_pages(derived.pages(spark, d), "scrape").select("page_id", "label")


def useful_pages(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("Error 404. "), "text")).otherwise(F.col("text")).alias("content"))
    return pages.useful_pages(docs).select("doc_id", text.word_count(F.col("content")).cast("long").alias("n_words"))


def antibot_flags(spark, d):
    html = F.when(F.col("page_id") % 4 == 0, F.concat("html", F.lit("Please ENABLE cookies"))).when(F.col("page_id") % 4 == 1, F.concat("html", F.lit("Ray ID: 7"))).otherwise(F.col("html"))
    return _read(spark, d, "pages").select("page_id", pages.blocked(html).alias("blocked"))


def best_fetches(spark, d):
    e = _read(spark, d, "events")
    rows = e.select("event_id", F.col("user_id").cast("string").alias("url"), (F.col("event_id") % 3 + 1).alias("tier"), F.when(F.col("event_type") == "error", 403).otherwise(200).alias("status_code"), (F.col("event_id") % 400).alias("word_count"))
    return pages.best_fetch(rows, order="event_id").select("url", "tier", "status_code", "event_id")


def doc_first_copies(spark, d):
    return pages.first_copies(_read(spark, d, "documents").select("doc_id", "source", "text"), "text", "doc_id", ["source"]).select("source", "doc_id")


def crawl_waves(spark, d):
    """A crawl of each host from its first page, over the links in the pages; every page links to page 0 too."""
    p = _read(spark, d, "pages")
    n = p.agg(F.max("page_id") + 1).first()[0]
    href = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    made = F.transform(href, lambda h, i: F.struct(((F.length(h) * 37 + F.col("page_id") * 5 + i * 11) % n).cast("long").alias("dst"), (F.length(h) % 7).cast("long").alias("score")))
    links = p.select(F.col("page_id").alias("src"), F.explode(F.array_append(made, F.struct(F.lit(0).cast("long").alias("dst"), F.lit(1).cast("long").alias("score")))).alias("l")).select("src", "l.*")
    sign = lambda k: F.col("page_id") % k == 0
    known = p.select(F.col("page_id").alias("page"), text.word_count(F.col("html")).alias("words"), F.md5("html").alias("digest"), sign(5).alias("fees"), sign(3).alias("english"), sign(2).alias("entry"))
    seeds = p.groupBy(urls.host(F.col("url")).alias("host")).agg(F.min("page_id").alias("page")).select(F.col("page").alias("crawl_id"), "page")
    return crawl.crawl(seeds, links, known, max_depth=3, max_pages=20, needs=["fees", "english", "entry"]).select("crawl_id", "page", F.col("depth").cast("long"))


def crawl_depths(spark, d):
    out = crawl.crawl_depths(crawl_waves(spark, d))
    return out.select("crawl_id", "n", F.array_join(F.transform("depths", lambda x: x.cast("string")), ",").alias("depths"), "max_depth")


# ------------------------------------------------------------ text


def clean_documents(spark, d):
    out = text.clean_lines(F.col("text"))
    return _read(spark, d, "documents").select("doc_id", F.md5(out).alias("clean_md5"), F.length(out).cast("long").alias("n_chars"))


def truncated_documents(spark, d):
    out = text.truncate(F.col("text"), 3000, "\n+")
    return _read(spark, d, "documents").select("doc_id", F.md5(out).alias("cut_md5"), F.length(out).cast("long").alias("n_chars"))


def program_sections(spark, d):
    s = text.sections(F.col("text"))
    out = derived.programs(spark, d).select("k", s.alias("s"))
    return out.select("k", *(F.length(F.col("s")[n]).cast("long").alias(n) for n in [*L.SECTIONS, "other"]), F.md5(text.focused_text(F.col("s"))).alias("focused_md5"))


def content_votes(spark, d):
    best = text.content_votes(F.col("text"))
    return derived.programs(spark, d).select("k", best["type"].alias("page_type"), best["votes"].cast("long").alias("votes"))


def combined_texts(spark, d):
    parts = F.collect_list(F.struct("turn", F.col("role").alias("label"), "text"))
    return _read(spark, d, "conversations").groupBy("conv_id").agg(F.md5(text.combine(parts)).alias("combined_md5"))


# ------------------------------------------------------------ relevance


def _scored(spark, d):
    p = derived.pages(spark, d).select("scrape", F.col("page_id").alias("pos"), "url", "content")
    return relevance.score_pages(p.withColumn("page_type", text.page_type(F.col("url"), F.col("content"))))


def relevance_scores(spark, d):
    return _scored(spark, d).select("pos", "field_group", F.col("score").cast("long"))


def relevance_histogram(spark, d):
    return relevance.score_histogram(_scored(spark, d))


def packed_contexts(spark, d):
    contents = derived.pages(spark, d).select("scrape", F.col("page_id").alias("pos"), "content")
    out = relevance.pack_contexts(_scored(spark, d), "scrape", contents)
    return out.select("scrape", "field_group", F.md5("context").alias("context_md5"), F.length("context").cast("long").alias("n_chars"), F.col("pages").cast("long"))


def best_sources(spark, d):
    return relevance.best_sources(_scored(spark, d), "scrape").select("scrape", "field_group", "source_url", F.col("score").cast("long"))


# ------------------------------------------------------------ extraction


def extracted_hints(spark, d):
    h = extract.hints(F.col("text"))
    rows = derived.programs(spark, d).select("k", h.alias("h"))
    lists = {"fee_amounts", "deadlines"}
    names = ["ielts", "toefl", "pte", "duolingo", "fee_amounts", "domestic_fee", "international_fee", "duration", "gpa", "deadlines"]
    return rows.select("k", *(F.array_join(F.col(f"h.{n}"), "; ").alias(n) if n in lists else F.col(f"h.{n}").alias(n) for n in names))


def hint_blocks(spark, d):
    return derived.programs(spark, d).select("k", extract.hints(F.col("text")).alias("h")).select("k", F.md5(extract.hint_lines(F.col("h"))).alias("block_md5"))


def filled_records(spark, d):
    e = F.struct(F.when(F.col("k") % 2 == 0, F.lit("IELTS 7.0")).alias("ielts"), *(F.lit(None).cast("string").alias(n) for n in ("toefl", "pte", "duolingo", "notes")))
    f = F.struct(F.when(F.col("k") % 6 == 0, F.lit("£1")).alias("domestic"), *(F.lit(None).cast("string").alias(n) for n in ("international", "currency", "notes")))
    given = {"ielts": e["ielts"], "domestic_fee": f["domestic"]}
    h = extract.hints(F.col("text"), extract.ENGLISH_GAPS + extract.FEE_GAPS, given)
    rows = derived.programs(spark, d).select("k", h.alias("h"))
    rows = rows.select("k", extract.fill_english(e, F.col("h")).alias("e"), extract.fill_fees(f, F.col("h")).alias("f"))
    return rows.select("k", "e.ielts", "e.toefl", "e.pte", "f.domestic", "f.international", "f.currency", F.col("f.notes").alias("fee_notes"))


def validated_records(spark, d):
    rows = derived.programs(spark, d).select("k", "degree", "text", extract.hints(F.col("text"), ("ielts", "toefl", "duration", "gpa")).alias("h"))
    return rows.select(
        "k",
        validate.duration_verdict(F.col("h.duration"), F.col("degree")).alias("duration_verdict"),
        validate.checked_duration(F.col("h.duration"), F.col("degree")).alias("duration"),
        validate.grade_is_internal(F.col("h.gpa"), F.col("text")).alias("internal_grade"),
        F.array_join(validate.english_issues(F.col("h")), ",").alias("english_issues"),
    )


def parsed_props(spark, d):
    raw = F.concat(F.lit("Result:\n```json\n"), "props", F.lit("\n```"))
    return _read(spark, d, "events").select("event_id", extract.json_object(raw, "k BIGINT, absent STRING").alias("j")).select("event_id", "j.k", "j.absent")


# ------------------------------------------------------------ records

_FIELDS = ["university_name", "program_name", "degree_level", "program_duration", "application_deadlines", "min_academic_requirement", "accepted_qualifications"]


def _nested(rows: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    english = F.struct("ielts", "toefl", none.alias("pte"), none.alias("duolingo"), none.alias("notes"))
    fees = F.struct("domestic", "international", F.when(F.coalesce("domestic", "international").isNotNull(), F.lit("GBP")).alias("currency"), none.alias("notes"))
    return rows.withColumns({"english_requirements": F.when(F.coalesce("ielts", "toefl").isNotNull(), english), "tuition_fees": F.when(F.coalesce("domestic", "international").isNotNull(), fees)})


def record_status(spark, d):
    rows = _nested(derived.records(spark, d))
    values = [F.col(c) for c in (*_FIELDS, "english_requirements", "tuition_fees")]
    return rows.select("scrape", records.record_status(values, F.col("university_name"), F.col("program_name")).alias("result_status"))


def record_coverage(spark, d):
    rows = derived.records(spark, d)
    c = records.coverage({n: F.col(n) for n in (*_FIELDS, "ielts", "toefl", "domestic", "international")})
    return rows.select("scrape", c.alias("c")).select("scrape", F.col("c.found").cast("long").alias("found"), F.array_join("c.missing", ",").alias("missing"))


def coverage_total(spark, d):
    c = records.coverage({n: F.col(n) for n in (*_FIELDS, "ielts", "toefl", "domestic", "international")})
    rows = derived.records(spark, d).filter("status != 'failed'").select(c.alias("c"))
    total = rows.agg(F.sum("c.found").alias("found"), F.sum("c.total").alias("total"))
    return total.select("found", "total", (F.col("found") * 100 / F.col("total")).cast("int").cast("long").alias("percent"))


def success_rates(spark, d):
    rows = derived.records(spark, d)
    good = F.col("status").isin("success", "partial")
    return rows.groupBy(F.col("batch")).agg(F.count_if(good).alias("good"), F.count("*").alias("n"), F.count_if(F.col("ielts").isNotNull()).alias("with_english"))


def gap_reports(spark, d):
    rows = _nested(derived.records(spark, d))
    missing = records.missing_fields(F.col("english_requirements"), F.col("tuition_fees"), F.col("application_deadlines"), F.col("min_academic_requirement"))
    seen = F.array(F.when(F.col("scrape") % 2 == 0, F.lit("tuition-and-fees")).otherwise(F.lit("overview")), F.when(F.col("scrape") % 3 == 0, F.lit("entry-requirements")).otherwise(F.lit("main")))
    rows = rows.select("scrape", missing.alias("missing"), records.suggested_pages(missing, seen).alias("suggested"))
    return rows.select("scrape", F.array_join("missing", ",").alias("missing"), F.array_join("suggested", ",").alias("suggested"), (F.size("suggested") > 0).alias("needs_recrawl"))


def candidate_urls(spark, d):
    base = F.regexp_replace("url", "[?#].*$", "")
    made = _read(spark, d, "pages").select("page_id", F.posexplode(urls.candidate_urls(base, F.array(F.lit("fees"), F.lit("english")))).alias("pos", "candidate"))
    return made.select("page_id", F.col("pos").cast("long"), "candidate")


def merged_records(spark, d):
    rows = _nested(derived.records(spark, d)).withColumn("source", F.concat(F.lit("s"), F.col("scrape").cast("string")))
    rows = rows.withColumn("intake_months", F.when(F.col("scrape") % 3 == 0, F.array(F.concat(F.lit(" m"), (F.col("scrape") % 5).cast("string")), F.lit("May"))))
    m = records.merge_records(rows, "batch", "scrape", "source", _FIELDS, ["intake_months"], L.NESTED_FIELDS)
    return m.select("batch", *_FIELDS, F.array_join("intake_months", ",").alias("intake_months"), "english_requirements.ielts", "english_requirements.toefl", "tuition_fees.domestic", F.col("field_sources")["program_duration"].alias("duration_source"), F.col("field_sources")["english_requirements.ielts"].alias("ielts_source"), F.size("field_sources").cast("long").alias("n_sources"))


# ------------------------------------------------------------ history, batches, export


def history_page(spark, d):
    return history.history_page(derived.records(spark, d), search="program 1[0-9]$", status="success", page=2, limit=10)


def history_count(spark, d):
    return history.history_count(derived.records(spark, d), search="program 1[0-9]$", status="success", limit=10)


def batch_tally(spark, d):
    r = derived.records(spark, d)
    jobs = r.groupBy("batch").agg(F.collect_list("scrape").alias("scrapes"))
    return history.batch_tally(jobs, r.filter(F.col("scrape") % 50 != 0).select("scrape", "status"))


def batch_rows(spark, d):
    r = derived.records(spark, d)
    jobs = r.groupBy("batch").agg(F.collect_list("scrape").alias("scrapes"))
    return history.batch_rows(jobs, r.filter(F.col("scrape") % 50 != 0).select("scrape", "status", "university_name"))


def exported_rows(spark, d):
    none = F.lit(None).cast("string")
    rows = _nested(derived.records(spark, d)).select(
        F.col("scrape").cast("string").alias("scrape_id"), *_FIELDS, F.array(F.lit("May"), F.lit("June")).alias("intake_months"), "english_requirements", "tuition_fees",
        *(none.alias(n) for n in ("other_fees", "scholarships", "work_experience", "other_requirements", "confidence_notes")), "status",
        F.array(F.lit("u1"), F.concat(F.lit("u"), F.col("scrape").cast("string"))).alias("source_urls"), "created_at",
    )
    return records.export_rows(rows)


def record_fields(spark, d):
    rows = derived.records(spark, d)
    return history.field_rows(rows, "scrape", _FIELDS)


def remaining_after_delete(spark, d):
    r = derived.records(spark, d)
    return history.delete(r, r.filter(F.col("scrape") % 7 == 3).select("scrape"), "scrape").groupBy("status").agg(F.count("*").alias("n"))


def latest_versions(spark, d):
    e = _read(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return history.latest(e, ["user_id"], ["event_id"]).select("user_id", "event_id", "event_type")


def cache_hits(spark, d):
    e = _read(spark, d, "events").select(F.col("user_id").alias("url"), F.col("event_id").alias("scrape"), F.when(F.col("event_type").isin("view", "click"), "success").otherwise("failed").alias("status"), F.col("ts").alias("created_at"))
    as_of = F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    return history.cached(e, as_of).select("url", "scrape")


def rate_waits(spark, d):
    e = _read(spark, d, "events").select("event_id", "user_id", "ts")
    return history.rate_window(e, "user_id", "ts", "event_id", 3600).select("event_id", "in_window", F.col("limited"))


def staggered(spark, d):
    r = derived.records(spark, d)
    return history.stagger(r, "batch", "scrape", 25).select("scrape", F.col("delay_s").cast("long"))


QUERIES = {f.__name__: f for f in (
    page_links_topk, page_type_counts, host_counts, same_domain_pairs, normalized_urls, pdf_links, page_labels, useful_pages, antibot_flags, best_fetches,
    doc_first_copies, crawl_waves, crawl_depths, clean_documents, truncated_documents, program_sections, content_votes, combined_texts, relevance_scores,
    relevance_histogram, packed_contexts, best_sources, extracted_hints, hint_blocks, filled_records, validated_records, parsed_props, record_status,
    record_coverage, coverage_total, success_rates, gap_reports, candidate_urls, merged_records, history_page, history_count, batch_tally, batch_rows,
    exported_rows, record_fields, remaining_after_delete, latest_versions, cache_hits, rate_waits, staggered,
)}
