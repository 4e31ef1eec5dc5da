"""Noise goes as by the plain patterns, which are only tried where they may fit."""

import random

from pyspark.sql import functions as F

from pagemill.functions import text

PLAIN = ((r"!\[[^\]]*\]\(data:[^)]*\)", ""), (r"\[!\[[^\]]*\]\(data:[^)]*\)\]\([^)]*\)", ""), (r"data:image/\S{10,}", "[image]"), (r"%3[cC]svg\S{20,}", ""), (r"\n{3,}", "\n\n"))


def test_noise_as_by_plain_patterns(spark):
    rng = random.Random(3)
    words = ["![", "[![", "x](data:y)", "](z)", "data:image/", "0123456789abcdefghijkl", "%3csvg", "%3Csvg", "\n", "\n\n", " ", "a", None]
    rows = [("".join(filter(None, (rng.choice(words) for _ in range(rng.randrange(14))))),) for _ in range(3000)] + [(None,)]
    df = spark.createDataFrame(rows, "text string").repartition(4)
    want = F.col("text")
    for pattern, put in PLAIN:
        want = F.regexp_replace(want, pattern, put)
    want = F.regexp_replace(want, text.SPACE, "")
    assert df.filter(~text.strip_noise(F.col("text")).eqNullSafe(want)).count() == 0
    assert df.filter(want != F.regexp_replace("text", text.SPACE, "")).count() > 300
