"""Whole scrapes against contexts and records written out by hand."""

from pyspark.sql import functions as F

from pagemill.functions import lexicon as L
from pagemill.operators import extraction, pages

PAGES = "scrape long, pos int, url string, page_type string, content string"
FEES = "Tuition fees: home £9,000 per year. IELTS 6.5 overall."


def run(spark, scrapes, rows, **kw):
    table = spark.createDataFrame(scrapes, "scrape long, url string, text string, answer string")
    table = table.withColumn("given", extraction.read_answer(F.col("answer"))).withColumn("record", F.lit("clashing name"))
    return {r.scrape: r for r in extraction.extract_scrapes(table, spark.createDataFrame(rows, PAGES), "scrape", given="given", **kw).collect()}


def test_contexts_go_under_their_headers_best_first(spark):
    rows = [
        (1, 0, "https://u.edu/a", "other", "plain"),
        (1, 1, "https://u.edu/fees", "tuition", FEES),
        (1, 2, "https://u.edu/tuition-fees", "tuition", None),
        (1, 3, "https://u.edu/apply", "admissions", "Deadline: 1 May 2026. Intake in September."),
    ]
    got = run(spark, [(1, "https://u.edu/a", "not looked at", None)], rows)[1]
    parts = got.focused.split("\n\n=== ")
    assert [p.split(" ===")[0].removeprefix("=== ") for p in parts] == ["PROGRAM INFORMATION", "ENGLISH REQUIREMENTS", "FEES INFORMATION", "ADMISSION DETAILS", "INTAKE & DATES"]
    # fees: 50 + 100 + 200 + 40 for the address of page 2; page 1 has 50 + 100 + 40 and £, "tuition fee", "per year"
    fees = parts[2].split("\n", 1)[1]
    assert fees.startswith("\n--- TUITION (score:390) | https://u.edu/tuition-fees ---\n\n\n--- TUITION (score:250) | https://u.edu/fees ---\n" + FEES)
    assert got.field_sources["tuition_fees.domestic"] == got.field_sources["tuition_fees"] == "https://u.edu/tuition-fees"
    assert got.record.english_requirements.ielts.startswith("IELTS 6.5")
    assert "not looked at" not in got.prompt


def test_intake_that_repeats_admission_is_left_out(spark):
    maps = spark.createDataFrame([({"intake_months": "same ", "application_deadlines": " same"},), ({"intake_months": "own"},), ({},)], "c map<string,string>")
    got = [r[0] for r in maps.select(extraction.targeted_text(F.col("c"))).collect()]
    assert "INTAKE" not in got[0] and got[1].endswith("=== INTAKE & DATES ===\nown")
    assert got[2] == "=== PROGRAM INFORMATION ===\n\n\n=== ENGLISH REQUIREMENTS ===\n\n\n=== FEES INFORMATION ===\n\n\n=== ADMISSION DETAILS ==="


def test_answers_nulls_repeats_and_scrapes_without_pages(spark):
    answer = 'Sure: {"university_name": "U", "program_name": "P", "intake_months": ["May"], "tuition_fees": {"domestic": "£1", "breakdown": "Books: £2 | Total: £3"}, "surprise": 1} done'
    scrapes = [(1, "https://u.edu", "Tuition fees are £7,000.", answer), (2, "https://v.edu", None, "no object"), (None, "https://w.edu", "IELTS 7.0 overall", None), (3, None, None, '{"intake_months": []}')]
    rows = [(3, 0, None, None, None), (3, 1, "https://x.edu/news", "other", ""), (None, 0, "https://w.edu", "tuition", FEES)]
    got = run(spark, scrapes, rows)
    one = got[1]
    assert (one.status, one.record.tuition_fees.domestic, one.record.intake_months) == ("partial", "£1", ["May"])
    assert one.field_sources["intake_months"] == one.field_sources["tuition_fees.domestic"] == "https://u.edu"
    assert one.record.tuition_fees.breakdown == "Books: £2 | Total: £3" and "tuition_fees.breakdown" in one.field_sources
    assert "scholarships" not in one.field_sources
    assert got[2].status == got[3].status == "failed" and got[2].focused == "" and got[3].record.intake_months is None
    assert got[None].record.english_requirements.ielts.startswith("IELTS 7.0")
    assert got[3].focused.startswith("=== PROGRAM INFORMATION ===")
    twice = spark.createDataFrame([(1, "u", "IELTS 6.0")] * 2, "scrape long, url string, text string")
    assert extraction.extract_scrapes(twice, spark.createDataFrame([], PAGES), "scrape").count() == 2


def test_a_long_page_is_cut_to_its_groups_budget(spark):
    rows = [(1, 0, "https://u.edu/tuition-fees", "tuition", "fee £5 " * 400_000)]
    got = run(spark, [(1, "u", None, None)], rows)[1]
    fees = got.focused.split("=== FEES INFORMATION ===\n")[1].split("\n\n=== ")[0]
    assert len(fees) <= L.GROUP_BUDGETS["tuition_fees"] and fees.endswith("...[truncated]")
    assert len(got.prompt) < L.PROMPT_CHARS + 2000


def test_prompts_do_not_fill_in_inserted_names(spark):
    row = spark.range(1).select(extraction.prompt("{a}|{b}|{a}", a=F.lit("{b}"), b=F.lit(None).cast("string")).alias("p")).first()
    assert row.p == "{b}||{b}"
    assert spark.range(1).select(extraction.read_answer(F.lit(extraction.answer_shape())).alias("a")).first().a.tuition_fees.currency is None


def test_first_pdfs_and_listed_pages(spark):
    html = "<a href=x.PDF>1</a><!-- <a href='/no.pdf'>n</a> --><a href='/c/x.PDF'>same</a><a href=\"https://o.org/pdf/y\">2</a><a href=/z.pdf>3</a>"
    table = spark.createDataFrame([(1, "https://u.edu/c/p", html), (2, "https://u.edu", None), (3, "https://u.edu", "<a href=/q>q</a>")], "page_id int, url string, html string")
    assert sorted(map(tuple, pages.page_pdfs(table).collect())) == [(1, 0, "https://u.edu/c/x.PDF"), (1, 1, "https://o.org/pdf/y")]
    rows = [(1, k, f"u{k}", "tuition" if k else None, "") for k in range(12)] + [(None, 0, None, "other", "")]
    got = {r.scrape: r.listed for r in pages.listed_pages(spark.createDataFrame(rows, PAGES), "scrape").collect()}
    assert got[1].split("\n") == ["- u0 (unknown)"] + [f"- u{k} (tuition)" for k in range(1, 10)]
    assert got[None] == "- unknown (other)"
