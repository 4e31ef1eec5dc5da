"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.shared import drop_staged, staged, staged_so_far


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)`` that is not itself the least of its component.

    Rounds of large-star and small-star: every node's neighbours are hung on its least neighbour,
    first the larger ones, then the smaller ones, until nothing changes. Links stay in tables, of which
    the last one is left; the driver sees a count and a checksum of each round. Loops, repeated links
    and links with a null end do no harm; without links there are no rows.
    """
    since = staged_so_far()
    pair = lambda x, y: F.struct(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    edges = staged(links.filter("a != b").select(pair("a", "b").alias("e")).select("e.*").distinct(), "links0")
    before, rounds = None, 0
    while True:
        rounds += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        hung = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(hung.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), f"links{rounds}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        drop_staged(since, keep=(f"links{rounds}",))
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
