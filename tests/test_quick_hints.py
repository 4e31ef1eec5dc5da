"""Findings in a text need no lower case and no look ahead at each place."""

from pyspark.sql import functions as F
from test_quick_patterns import odd_texts

from pagemill.functions import extract
from pagemill.functions import lexicon as L


def test_no_look_ahead_at_each_place(spark):
    assert not [p for p in extract.BEGINS if extract.quick(p).startswith("(?i)(?=")]
    plan = spark.createDataFrame([("x",)], "text string").select(extract.hints(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(" not in plan


def test_hints_are_those_of_the_plain_patterns(spark):
    words = "IELTS|toefl iBT|PTE|Duolingo|6.5|100|95|no band below|at least|overall|in each|Deadline|closing date|apply by|APPLICATIONS due|applications\nclose|1st|2 |May|Dec|Sept|March|2024|, |.|GPA|3.5|grade point average|2:1|first-class|third class|65%|two|years|months|tuition|credit\nhour|UK|non-UK|arkansas|resident|foreign\nstudent|£|900|usd|K|ſ".split("|")
    t = F.col("text")
    first = lambda p: F.nullif(F.trim(F.regexp_extract(t, p, 0)), F.lit(""))
    dates = F.arrays_zip(*(F.regexp_extract_all(t, F.lit(L.DEADLINE), F.lit(g)).alias(n) for g, n in ((1, "a"), (2, "b"))))
    dates = F.slice(F.array_distinct(F.transform(dates, lambda z: F.trim(F.when(z["a"] != "", z["a"]).otherwise(z["b"])))), 1, 3)
    band = F.regexp_extract(first(L.IELTS_BAND), r"\S+$", 0)
    plain = {
        "ielts": F.concat(first(L.IELTS), F.coalesce(F.concat(F.lit(", no band below "), band), F.lit(""))),
        "toefl": first(L.TOEFL),
        "pte": first(L.PTE),
        "duolingo": first(L.DUOLINGO),
        "duration": first(L.DURATION),
        "gpa": F.coalesce(first(L.GPA), first(L.UK_GRADE)),
        "deadlines": F.when(F.size(dates) > 0, dates),
    }
    rows = odd_texts(spark, words, 3000, 7).select(extract.hints(t).alias("h"), *(c.alias(n) for n, c in plain.items()))
    got = rows.select(*(F.count_if(~F.col(f"h.{n}").eqNullSafe(F.col(n))).alias(n) for n in plain), *(F.count(n).alias(f"{n}_found") for n in plain)).first()
    assert [got[n] for n in plain] == [0] * len(plain) and min(got[f"{n}_found"] for n in plain) > 20
