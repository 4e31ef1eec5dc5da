"""Extraction of records from texts by rules: context, findings, checks, filling, notes."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import extract, text, validate
from pagemill.functions import lexicon as L
from pagemill.operators import records, relevance

GIVEN = "struct<{}>".format(
    ",".join(f"{n}:string" for n in L.SCALAR_FIELDS)
    + "".join(f",{n}:struct<{','.join(f'{s}:string' for s in subs)}>" for n, subs in L.NESTED_FIELDS.items())
)
#: What an extractor answers for a scrape: ``GIVEN``, the months of intake and the parts of fees, which no rule finds.
ANSWERED_FIELDS = L.NESTED_FIELDS | {"tuition_fees": [*L.NESTED_FIELDS["tuition_fees"], "breakdown"]}
ANSWER = GIVEN[:-2] + ",breakdown:string>,intake_months:array<string>>"
#: Characters of a text that an extractor is given.
CONTEXT = 12_000


def contexts(rows: DataFrame, source: str = "text") -> DataFrame:
    """Add ``focused``: the cleaned text's sections that matter for admission, or the cleaned text where it has none; null counts as empty.

    What looks like HTML must have been read by ``sources.html.add_text`` before.
    """
    cleaned = text.clean_lines(F.coalesce(F.col(source), F.lit("")))
    focused = text.let(cleaned, lambda c: text.let(text.focused_text(text.sections(c)), lambda f: F.when(f == "", c).otherwise(f)))
    return rows.withColumn("focused", focused)


def extract_records(rows: DataFrame, focused: str = "focused", given: str | None = None, context: int = CONTEXT) -> DataFrame:
    """Add ``record``, ``hint_block`` and ``context`` (the best paragraphs that fit, for an extractor) to rows with a focused text.

    ``given`` is a column of type ``GIVEN`` with what some extractor found; without one, or where it is null, records start empty.
    Given values are checked first: implausible durations go, and warnings are put into the notes. Gaps are then filled from the
    text's findings. Headers of the form ``=== NAME ===`` part a text into sections.
    """
    empty = F.lit(None).cast(GIVEN)
    lines = F.transform(F.split(focused, "\n"), F.trim)
    headers = F.filter(lines, lambda x: x.startswith("===") & x.endswith("==="))
    names = F.when(F.col(focused).contains("==="), headers).otherwise(F.array().cast("array<string>"))
    found = rows.withColumns({"_h": extract.section_hints(F.col(focused), names), "_g": F.col(given) if given else empty})
    g, h = F.col("_g"), F.col("_h")
    notes = validate.warnings(g["program_duration"], g["degree_level"], g["min_academic_requirement"], F.col(focused), g["english_requirements"])
    english = g["english_requirements"]
    fees = g["tuition_fees"]
    filled = {
        "program_duration": extract.fill_text(validate.checked_duration(g["program_duration"], g["degree_level"]), h["duration"]),
        "min_academic_requirement": extract.fill_text(g["min_academic_requirement"], h["gpa"]),
        "application_deadlines": extract.fill_text(g["application_deadlines"], F.array_join(h["deadlines"], "; ")),
        "confidence_notes": validate.with_warnings(g["confidence_notes"], notes),
        "english_requirements": extract.fill_english(english, h),
        "tuition_fees": extract.fill_fees(fees, h),
    }
    record = F.struct(*(filled.get(n, g[n]).alias(n) for n in (*L.SCALAR_FIELDS, *L.NESTED_FIELDS)))
    out = found.withColumns({"record": record, "hint_block": extract.hint_lines(h), "context": text.truncate(F.col(focused), context)})
    return out.drop("_h", "_g")


# ------------------------------------------------------------ whole scrapes

#: Order to an extractor, with ``answer_shape()`` as its form.
INSTRUCTIONS = """Read the pages of a study program below and answer with one JSON object of exactly this form:
{shape}
Take values from the text only and keep their units, currencies and dates as they stand there. A field that the text does not state is null.
Fees of home and of international students stand apart. Put real doubts into confidence_notes."""


def answer_shape() -> str:
    """The JSON object that ``read_answer`` reads, all null."""
    return json.dumps({n: None for n in (*L.SCALAR_FIELDS, "intake_months")} | {n: dict.fromkeys(subs) for n, subs in ANSWERED_FIELDS.items()}, indent=1)


def prompt(template: str, **values: Column) -> Column:
    """A template with its ``{names}`` replaced by columns (null: nothing); names inside the inserted texts stay as they are."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.coalesce(values[x], F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(parts)))


def read_answer(raw: Column) -> Column:
    """An extractor's answer as ``ANSWER``, fences and prose around the object aside; null where there is no object."""
    return extract.json_object(raw, ANSWER)


def targeted_text(contexts: Column) -> Column:
    """One text of a map from field groups to contexts: each under its header, that on intake only where it says other things than that on admission."""
    of = lambda g: F.coalesce(F.try_element_at(contexts, F.lit(g)), F.lit(""))
    intake = of("intake_months")
    told = (intake != "") & (text.strip(intake) != text.strip(of("application_deadlines")))
    part = lambda g: F.concat(F.lit(f"=== {L.GROUP_HEADERS[g]} ===\n"), of(g))
    parts = [F.when(told, part(g)) if g == "intake_months" else part(g) for g in L.GROUP_HEADERS]
    return text.strip(F.concat_ws("\n\n", *parts))


def page_contexts(pages: DataFrame, within: str) -> DataFrame:
    """``within, contexts, sources``: maps from field groups to the text of the best pages and to the best page's address.

    ``pages`` has ``within, pos, url, page_type, content``. A group without a page at the threshold has an empty context, but a source.
    Groups are five, so a row's maps are small; texts meet the scores again only for the pages that are taken.
    """
    scored = relevance.score_pages(pages)
    best = relevance.best_sources(scored, within).select(within, "field_group", "source_url")
    packed = relevance.pack_contexts(scored, within, pages.select(within, "pos", "content")).select(within, "field_group", "context")
    both = best.join(packed, [within, "field_group"], "left")
    return both.groupBy(within).agg(
        F.map_from_entries(F.collect_list(F.struct("field_group", F.coalesce("context", F.lit("")).alias("c")))).alias("contexts"),
        F.map_from_entries(F.collect_list(F.struct("field_group", "source_url"))).alias("sources"),
    )


def extract_scrapes(scrapes: DataFrame, pages: DataFrame, within: str, given: str | None = None, hint: str | None = None, template: str = L.PROMPT) -> DataFrame:
    """Add ``focused``, ``record``, ``field_sources``, ``status``, ``hint_block`` and ``prompt`` to scrapes (``within, url, text``).

    What is extracted from is the text of the scrape's best ``pages`` for each group of fields (``page_contexts``); for a scrape without
    pages it is ``text``, as in ``contexts``. ``given`` is a column of type ``ANSWER`` (``read_answer`` of what a model said to the prompt);
    without one, or where it is null, the record has what rules find. Every field with a value has the best page of its group as its source,
    or ``url`` where there is none. A second pass with the pages of a re-scan is a second call. Rows of scrapes with a null key have no
    pages; rows that repeat get equal results; given columns with the added names give way.
    """
    added = ["focused", "record", "field_sources", "status", "hint_block", "prompt", "context"]
    rows = scrapes.drop(*(n for n in added if n != given))
    of_pages = page_contexts(pages, within).withColumnsRenamed({"contexts": "_contexts", "sources": "_sources"})
    rows = contexts(rows.join(of_pages, within, "left"))
    rows = rows.withColumn("focused", F.when(F.col("_contexts").isNotNull(), targeted_text(F.col("_contexts"))).otherwise(F.col("focused")))
    out = extract_records(rows, given=given, context=L.PROMPT_CHARS)
    answer = F.col(given) if given else F.lit(None).cast(ANSWER)
    months, fees = answer["intake_months"], F.col("record.tuition_fees")
    fees = F.when(fees.isNotNull(), fees.withField("breakdown", answer["tuition_fees"]["breakdown"]))
    out = out.withColumn("record", F.col("record").withField("intake_months", F.when(F.size(months) > 0, months)).withField("tuition_fees", fees))
    record = {n: F.col(f"record.{n}") for n in L.FIELD_GROUP}
    out = out.withColumns({
        "field_sources": relevance.field_sources(record, F.coalesce("_sources", F.create_map().cast("map<string,string>")), F.col("url"), ANSWERED_FIELDS),
        "status": records.record_status(list(record.values()), record["university_name"], record["program_name"]),
        "prompt": prompt(template, url=F.col("url"), hint=F.coalesce(F.col(hint), F.lit(L.ANY_HINT)) if hint else F.lit(L.ANY_HINT), findings=F.col("hint_block"), text=F.col("context")),
    })
    return out.drop("_contexts", "_sources", "context")
