"""Patterns with a look ahead find what they find without."""

import random
import time

from pyspark.sql import functions as F

from pagemill.functions import extract


def odd_texts(spark, words, n, seed):
    rng = random.Random(seed)
    rows = [("".join(rng.choice(words) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(40))),) for _ in range(n)]
    return spark.createDataFrame(rows, "text string").repartition(4)


def test_quick_patterns_find_the_same(spark):
    words = "tuition|FEE|cost|UK|home|In-State|arkansas resident|international|non-EU|foreign|student|credit|hour|£|€|$|usd|GBP |jpy 5|1|12,5|.|9.5|2:1|First class|lower second degree 60%|GPA|3.25|/4.0|one|TWENTY-four|years|Month|-|to|3 to 4 terms|deadline|apply by|May|Sept 2|1st|march 5, 2024|no band below|at least|7.5|minimum of|1.234 £|\x0b|\u017f|\u212a|price 7 cad".split("|")
    assert len(extract.BEGINS) == 9
    plain = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    differ = [F.count_if(extract.all_matches(F.col("text"), p) != plain(p)) for p in extract.BEGINS]
    found = [F.count_if(F.size(plain(p)) > 0) for p in extract.BEGINS]
    got = odd_texts(spark, words, 3000, 5).select(F.array(*differ).alias("differ"), F.array(*found).alias("found")).first()
    assert got.differ == [0] * 9 and min(got.found) > 20


def test_tables_are_looked_for_in_linear_time(spark):
    began = time.perf_counter()
    row = spark.createDataFrame([("no band below 6 " * 40_000,)], "text string").select(extract.toefl(F.col("text")).alias("t")).first()
    assert row.t is None and time.perf_counter() - began < 10
