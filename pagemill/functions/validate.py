"""Checks of extracted values: a note for what looks wrong."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import lexicon as L
from pagemill.functions.urls import let


def _any(text: Column, words: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for w in words:
        out |= low.contains(w)
    return out


def years_of(duration: Column) -> Column:
    low = F.lower(duration)
    years = F.nullif(F.regexp_extract(low, r"(\d+(?:\.\d+)?)\s*years?", 1), F.lit("")).cast("double")
    months = F.nullif(F.regexp_extract(low, r"(\d+)\s*months?", 1), F.lit("")).cast("double")
    return F.coalesce(years, months / 12)


def duration_kind(degree: Column) -> Column:
    """``undergraduate``, ``doctoral``, ``masters`` or null: the first whose words a degree has."""
    return F.when(_any(degree, ["undergraduate"]), "undergraduate").when(_any(degree, L.DOCTORAL), "doctoral").when(_any(degree, L.MASTERS), "masters")


#: Years of each kind: least, most, and the verdict below the least.
YEARS = {"undergraduate": (2.5, 6, "short"), "doctoral": (2, 10, "implausible"), "masters": (0.5, 3, "short")}


def duration_verdict(duration: Column, degree: Column) -> Column:
    """Verdict on a duration: ``ok``, ``short``, ``long``, ``implausible`` or ``unclear``; null without a duration."""

    def of(years: Column, kind: Column) -> Column:
        verdict = F.when(F.nullif(duration, F.lit("")).isNull(), F.lit(None).cast("string")).when(years.isNull(), "unclear")
        for name, (low, high, below) in YEARS.items():
            verdict = verdict.when((kind == name) & (years < low), below).when((kind == name) & (years > high), "long")
        return verdict.otherwise("ok")

    return let(years_of(duration), lambda years: let(duration_kind(degree), lambda kind: of(years, kind)))


def duration_note(duration: Column, degree: Column) -> Column:
    """What is said of a duration that is not ok; else null."""
    verdict, kind, years = duration_verdict(duration, degree), duration_kind(degree), years_of(duration).cast("string")

    def said(v: Column, k: Column) -> Column:
        note = F.when(v == "unclear", L.UNCLEAR_DURATION)
        for (name, word), text in L.DURATION_NOTES.items():
            note = note.when((k == name) & (v == word), F.replace(F.lit(text), F.lit("%s"), years))
        return note

    return let(verdict, lambda v: F.when(v != "ok", let(kind, lambda k: said(v, k))))


def checked_duration(duration: Column, degree: Column) -> Column:
    """The duration, null if implausible."""
    return F.when(duration_verdict(duration, degree) == "implausible", F.lit(None)).otherwise(duration)


def grade_is_internal(grade: Column, context: Column) -> Column:
    """Whether the text around a grade speaks of progress within a programme rather than of admission."""
    count = lambda low, words: sum((low.contains(w).cast("int") for w in words), F.lit(0))
    more = lambda low: count(low, L.INTERNAL_FLAGS) > count(low, L.ADMISSION_FLAGS)
    return F.nullif(grade, F.lit("")).isNotNull() & let(F.lower(F.coalesce(context, F.lit(""))), more)


def grade_note(grade: Column, context: Column) -> Column:
    """What is said of a grade in such a context; else null."""
    low = F.lower(F.coalesce(context, F.lit("")))
    found = let(low, lambda x: F.array_compact(F.array(*(F.when(x.contains(w), w) for w in L.INTERNAL_FLAGS))))
    return F.when(grade_is_internal(grade, context), F.concat(F.lit(L.INTERNAL_NOTE), F.array_join(found, ", ")))


def _number(value: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(value, pattern, 1), F.lit("")).cast("double")


IELTS_NUMBER, TOEFL_NUMBER = r"(\d+\.?\d*)", r"(\d+)"


def score_outside(value: Column, pattern: str, low: float, high: float) -> Column:
    return F.coalesce(let(_number(value, pattern), lambda n: (n < low) | (n > high)), F.lit(False))


def english_issues(english: Column) -> Column:
    """Tests whose score is outside the test's range."""
    outside = [F.when(score_outside(english["ielts"], IELTS_NUMBER, 4, 9), "ielts"), F.when(score_outside(english["toefl"], TOEFL_NUMBER, 30, 120), "toefl")]
    return F.array_compact(F.array(*outside))


def english_note(english: Column) -> Column:
    """What is said of scores outside their ranges; else null."""
    ielts, toefl = _number(english["ielts"], IELTS_NUMBER).cast("string"), _number(english["toefl"], TOEFL_NUMBER).cast("long").cast("string")
    text = {"ielts": F.replace(F.lit(L.IELTS_NOTE), F.lit("%s"), ielts), "toefl": F.replace(F.lit(L.TOEFL_NOTE), F.lit("%s"), toefl)}
    return let(english_issues(english), lambda x: F.when(F.size(x) > 0, F.array_join(F.transform(x, lambda t: F.when(t == "ielts", text["ielts"]).otherwise(text["toefl"])), "; ")))


def warnings(duration: Column, degree: Column, grade: Column, context: Column, english: Column) -> Column:
    """All notes on a record, each under its heading."""
    notes = {"Duration: ": duration_note(duration, degree), "Academic requirement: ": grade_note(grade, context), "English requirements: ": english_note(english)}
    return F.array_compact(F.array(*(F.concat(F.lit(head), note) for head, note in notes.items())))


def with_warnings(notes: Column, found: Column) -> Column:
    """Notes with the warnings (an array) after them."""

    def added(warnings: Column) -> Column:
        text = F.concat(F.lit("Validation warnings: "), F.array_join(warnings, "; "))
        both = F.when(F.nullif(notes, F.lit("")).isNotNull(), F.concat(notes, F.lit(". "), text)).otherwise(text)
        return F.when(F.size(warnings) > 0, both).otherwise(notes)

    return let(found, added)
