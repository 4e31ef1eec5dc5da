"""Quick forms of stripping and of section types."""

import random

from pyspark.sql import functions as F

from pagemill.functions import lexicon as L
from pagemill.functions import text, urls


def odd_texts(spark, words, n, seed):
    rng = random.Random(seed)
    rows = [("".join(rng.choice(words) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(40))),) for _ in range(n)]
    return spark.createDataFrame(rows, "text string").repartition(4)


def test_strip_and_types_as_by_plain_patterns(spark):
    words = ["a", "b c", " ", "\n", "\t", "\u0085", "\u00a0", "\u2028", "\u2029", "\x0b", "\x1c", "fee", "fees", "entry requirements", "semester 1", "ielts", "year", "how to apply"]
    rows = odd_texts(spark, words, 3000, 6)
    kind = F.lit("other")
    for name, patterns in reversed(L.SECTIONS.items()):
        kind = F.when(F.col("text").rlike("|".join(f"(?:{p})" for p in patterns)), name).otherwise(kind)
    assert all(urls.begins("|".join(p)) for p in L.SECTIONS.values())
    assert [urls.begins(p) for p in ("abc|de?f", "(abc)", "fees?|cost")] == ["", "", "(?=[cf][eo][es])"]
    assert rows.filter(text.strip(F.col("text")) != F.regexp_replace("text", text.SPACE, "")).count() == 0
    assert rows.filter(text.section_of(F.col("text")) != kind).count() == 0
