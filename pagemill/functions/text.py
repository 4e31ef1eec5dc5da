"""Text cleaning, sections and truncation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import lexicon as L
from pagemill.functions.urls import first_type, let, url_type

#: Line ends: also form feed, separators and the Unicode ones.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
SPACE = r"^[\s\x{85}\x{A0}]+|[\s\x{85}\x{A0}]+$"
#: Characters at an end with which ``SPACE`` may fit; what ends a line may stand after it.
ENDS = r"[\s\x{85}\x{A0}\x{2028}\x{2029}]"


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0)))


def strip(text: Column) -> Column:
    ends = lambda t: F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1))
    return let(text, lambda t: F.when(ends(t).rlike(ENDS), F.regexp_replace(t, SPACE, "")).otherwise(t))


def strip_noise(text: Column) -> Column:
    """Without embedded images and encoded drawings. A pattern is tried where the text holds what each of its matches holds."""
    for pattern, put, held in (
        (r"!\[[^\]]*\]\(data:[^)]*\)", "", "]("),
        (r"\[!\[[^\]]*\]\(data:[^)]*\)\]\([^)]*\)", "", "[!["),
        (r"data:image/\S{10,}", "[image]", "data:image/"),
        (r"%3[cC]svg\S{20,}", "", "svg"),
        (r"\n{3,}", "\n\n", "\n\n\n"),
    ):
        text = let(text, lambda t, pattern=pattern, put=put, held=held: F.when(t.contains(held), F.regexp_replace(t, pattern, put)).otherwise(t))
    return strip(text)


def clean_lines(text: Column, boilerplate: str = L.BOILERPLATE, relevant: str = L.RELEVANT, navigation: str = L.NAVIGATION) -> Column:
    """Lines without boilerplate, navigation, junk and repeats, unless they are relevant; one blank line at most in a row."""
    lines = F.transform(F.split(strip_noise(text), LINE_END), strip)
    lines = F.transform(lines, lambda s: F.when(F.length(s) < 4, F.lit("")).otherwise(s))
    useful = lambda s: s.rlike(relevant)
    # a line is only looked through for what makes it relevant where something speaks against it
    against = lambda s: s.rlike(boilerplate) | ((F.length(s) < 50) & s.rlike(navigation))
    dropped = lambda s: (s != "") & (s.rlike(L.JUNK) | (against(s) & ~useful(s)))

    def once(kept: Column) -> Column:
        # lines that may repeat are told apart by their number, so that one pass over a hash set drops the other repeats
        marked = F.transform(kept, lambda s, i: F.concat(F.when((s == "") | useful(s), i.cast("string")).otherwise(F.lit("")), F.lit("\x01"), s))
        first = F.transform(F.array_distinct(marked), lambda x: F.substring(x, F.position(F.lit("\x01"), x) + 1, F.length(x)))
        alone = let(F.filter(kept, lambda s: s != ""), lambda k: F.size(F.array_distinct(k)) == F.size(k))
        return F.when(alone, kept).otherwise(first)

    first = let(F.filter(lines, lambda s: ~dropped(s)), once)
    calm = let(first, lambda f: F.filter(f, lambda s, i: (s != "") | (i == 0) | (F.get(f, F.greatest(i - 1, F.lit(0))) != "")))
    return strip(F.array_join(calm, "\n"))


def paragraphs(text: Column, gap: str = "\n\n") -> Column:
    return F.filter(F.transform(F.split(text, gap), strip), lambda p: p != "")


def section_of(paragraph: Column, sections: dict[str, list[str]] = L.SECTIONS) -> Column:
    return first_type(F.lower(paragraph), sections, "other")


def sections(text: Column, gap: str = "\n\n", names: dict[str, list[str]] = L.SECTIONS) -> Column:
    """Map from section to its paragraphs, joined by blank lines, in order."""
    all_names = [*names, "other"]
    parts = F.transform(paragraphs(text, gap), lambda p: F.struct(section_of(p, names).alias("s"), p.alias("p")))
    of = lambda all_parts, n: F.array_join(F.transform(F.filter(all_parts, lambda x: x["s"] == n), lambda x: x["p"]), "\n\n")
    return let(parts, lambda x: F.map_from_arrays(F.array(*map(F.lit, all_names)), F.array(*(of(x, n) for n in all_names))))


def focused_text(found: Column, other_chars: int = 2000) -> Column:
    """Sections that matter for admission, the most telling first."""
    parts = lambda m: F.array(m["admissions"], m["english"], m["fees"], m["scholarships"], F.substring(m["other"], 1, other_chars))
    return F.array_join(F.filter(let(found, parts), lambda p: p != ""), "\n\n")


def paragraph_score(p: Column, high: str = L.HIGH_PRIORITY, medium: str = L.MEDIUM_PRIORITY) -> Column:
    return F.regexp_count(p, F.lit(high)) * 3 + F.regexp_count(p, F.lit(medium))


def truncate(text: Column, most: int = 12000, gap: str = "\n{2,}") -> Column:
    """The best paragraphs that fit into ``most`` characters, in their order; the text itself if it is short enough.

    Paragraphs are tried by score, then place; one that does not fit is passed over.
    """
    budget = most - 80
    scored = F.array_sort(F.transform(paragraphs(text, gap), lambda p, i: F.struct((-paragraph_score(p)).alias("rank"), i.alias("at"), p.alias("p"))))
    start = F.expr("struct(0 as used, cast(array() as array<struct<at:int,p:string>>) as kept)")
    chosen = F.aggregate(
        scored,
        start,
        lambda acc, x: F.when(
            acc["used"] + F.length(x["p"]) + 2 <= budget,
            F.struct((acc["used"] + F.length(x["p"]) + 2).alias("used"), F.array_append(acc["kept"], F.struct(x["at"].alias("at"), x["p"].alias("p"))).alias("kept")),
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )
    joined = F.array_join(F.transform(F.array_sort(chosen), lambda x: x["p"]), "\n\n")
    ends = F.concat(F.substring(text, 1, 8000), F.lit(L.MIDDLE_MARK), F.substring(text, -4000, 4000))
    marked = lambda j: F.when(j == "", ends).when(F.length(j) < F.length(text) * 0.9, F.concat(j, F.lit(L.CUT_MARK))).otherwise(j)
    return F.when(F.length(text) <= most, text).otherwise(let(joined, marked))


def content_votes(text: Column, types: dict[str, list[str]] = L.CONTENT_TYPES) -> Column:
    """Struct of the best type and its number of pattern hits; the first of equals."""
    def vote(low: Column) -> Column:
        votes = [
            F.struct(sum((F.regexp_count(low, F.lit(p)) for p in patterns), F.lit(0)).alias("votes"), F.lit(-k).alias("rank"), F.lit(name).alias("type"))
            for k, (name, patterns) in enumerate(types.items())
        ]
        return F.array_max(F.array(*votes))

    return let(F.lower(F.coalesce(text, F.lit(""))), vote)


def page_type(url: Column, text: Column) -> Column:
    """Type by URL; where that says nothing, by content; else ``other``."""
    by_content = let(content_votes(text), lambda best: F.when(best["votes"] > 0, best["type"]).otherwise("other"))
    return let(url_type(url), lambda by_url: F.when(by_url != "other", by_url).otherwise(by_content))


def looks_like_html(text: Column) -> Column:
    """Whether a text holds a tag; null holds none."""
    return F.coalesce(text.rlike("<[a-zA-Z][^>]{0,100}>"), F.lit(False))


def combine(rows: Column) -> Column:
    """One text of an array of structs ``(order, label, text)``: blank texts are left out, the others stand in order under their labels."""
    some = F.filter(F.array_sort(rows), lambda x: strip(x["text"]) != "")
    return F.array_join(F.transform(some, lambda x: F.concat(F.lit("=== SOURCE: "), F.upper(x["label"]), F.lit(" ===\n"), strip(x["text"]))), "\n\n")
