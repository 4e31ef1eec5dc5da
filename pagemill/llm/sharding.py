"""Sharding by a minimax contiguous partition, in DataFrame functions only.

Rows of equal text form one atomic group; groups stand in the order of their digest. Running sums of
the group sizes are kept in a table, and the smallest capacity for which a greedy pass needs no more
than the wished shards is found by binary search. The driver sees only a bounded digest of the sums:
the ends of at most ``RESOLUTION`` blocks for each shard. Where a cut may fall inside a block, that
block alone is read again in finer blocks, until the capacity is exact.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from pagemill.llm.shared import staged

RESOLUTION = 256
ROWS_PER_SLOT_RUN = 100_000
#: Hex digits of the digest by which running sums are split over tasks.
PREFIX_DIGITS = 3


class _Sums:
    """Known ends of groups, and the gaps in which further ends lie."""

    def __init__(self, table: DataFrame, total: int, shards: int, resolution: int):
        self.table, self.total, self.shards, self.resolution = table, total, shards, resolution
        self.ends: list[int] = [0]
        self.gaps: dict[int, tuple[int, int]] = {}  # known end before the gap: known end after it, step
        self._read(None, total)

    def _read(self, where, length: int, below: int = 0) -> None:
        # powers of two, so that finer blocks lie within coarser ones
        step = 1 << max(0, (length // (self.shards * self.resolution)).bit_length() - 1)
        if below:
            step = min(step, below // 2)
        rows = self.table if where is None else self.table.filter(where)
        blocks = rows.groupBy(F.expr(f"end div {step}").alias("block")).agg(F.min("end"), F.max("end"), F.count("*")).collect()
        for _, low, high, n in blocks:  # at most one per step of the length
            self.ends += [low, high]
            if n > 2:
                self.gaps[low] = (high, step)
        self.ends = sorted(set(self.ends))

    def cuts(self, capacity: int, hopeful: bool) -> list[int]:
        """Ends of the shards of a greedy pass. hopeful: inside a gap, any place counts as an end."""
        out, at = [], 0
        for _ in range(self.shards):
            goal = at + capacity
            low = self.ends[bisect_right(self.ends, goal) - 1]
            at = min(goal, self.gaps[low][0]) if hopeful and low in self.gaps else low
            out.append(at)
        return out

    def least(self, hopeful: bool) -> int:
        low, high = -(-self.total // self.shards), self.total
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, hopeful)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def refine(self, low: int, high: int) -> None:
        """Read again the gaps in which a cut may fall for capacities from low to high."""
        wanted = set()
        for a, b in zip(self.cuts(low, False), self.cuts(high, True), strict=True):
            k = max(0, bisect_right(self.ends, a) - 1)
            while k < len(self.ends) and self.ends[k] <= b:
                if self.ends[k] in self.gaps:
                    wanted.add(self.ends[k])
                k += 1
        steps: dict[int, list[int]] = {}
        length = 0
        for x in wanted:
            high_end, step = self.gaps.pop(x)
            steps.setdefault(step, []).append(x // step)
            length += high_end - x
        where = F.lit(False)
        for step, blocks in steps.items():
            where |= F.expr(f"end div {step}").isin(blocks)
        self._read(where, length, min(steps))


def smallest_cuts(table: DataFrame, total: int, shards: int, resolution: int = RESOLUTION) -> list[int]:
    """Cut points of the smallest feasible capacity over ``table.end``, the running sums of ordered groups."""
    sums = _Sums(table, total, shards, resolution)
    while True:
        low, high = sums.least(True), sums.least(False)
        if low == high:
            return sums.cuts(high, False)
        sums.refine(low, high)


def shard(
    docs: DataFrame,
    shards: int,
    doc_id: str = "doc_id",
    text: str = "text",
    overhead: int = 16,
    resolution: int = RESOLUTION,
    rows_per_run: int = ROWS_PER_SLOT_RUN,
) -> DataFrame:
    """Put rows into ``shards`` shards of nearly equal bytes; rows of equal text stay together.

    Returns ``doc_id``, ``size`` (UTF-8 bytes and ``overhead``), ``text_crc32``, ``digest``, ``shard``
    and ``slot``, which counts a shard's rows from 0 without gaps. A null text counts as an empty one;
    repeated rows keep a slot each; an empty table gives no rows; other columns are not looked at.

    Groups larger than an even share get a shard each and go before the others (there are fewer
    than ``shards`` of them); the rest is cut by the smallest feasible capacity.
    """
    filled = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc"),
        (F.octet_length(filled) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(filled.cast("binary")).alias("text_crc32"),
        F.sha2(filled, 256).alias("digest"),
    )
    rows = staged(rows, "sizes")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    groups = staged(groups, "groups")

    total, count = (x or 0 for x in groups.agg(F.sum("bytes"), F.sum("n")).first())
    left, large = shards, []
    for digest, size in groups.orderBy(F.desc("bytes"), "digest").select("digest", "bytes").limit(shards - 1).collect():
        if size * left <= total:
            break
        large.append(digest)
        total, left = total - size, left - 1
    rest = groups.filter(~F.col("digest").isin(large)) if large else groups

    bucket = F.substring("digest", 1, PREFIX_DIGITS)
    before = rest.groupBy(bucket.alias("bucket")).agg(F.sum("bytes").alias("_all"))  # 16 ** PREFIX_DIGITS rows at most
    before = before.select("bucket", (F.sum("_all").over(Window.orderBy("bucket")) - F.col("_all")).alias("_before"))
    run = F.sum("bytes").over(Window.partitionBy("bucket").orderBy("digest"))
    sums = rest.withColumn("bucket", bucket).join(F.broadcast(before), "bucket").select("digest", (F.col("_before") + run).alias("end"))
    cuts: list[str] = []
    if total:
        sums = staged(sums, "sums")
        ends = [x for x in smallest_cuts(sums, total, left, resolution) if x < total]
        cuts = sorted(r[0] for r in sums.filter(F.col("end").isin(ends)).select("digest").collect())  # under `shards`

    place = F.lit(len(large))
    if cuts:
        place = place + F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("digest")))
    for k, digest in enumerate(large):
        place = F.when(F.col("digest") == digest, F.lit(k)).otherwise(place)
    runs = max(1, count // (shards * rows_per_run))
    rows = rows.withColumn("shard", place.cast("int")).withColumn("_run", F.pmod(F.xxhash64("doc", "digest"), F.lit(runs)))
    counts = rows.groupBy("shard", "_run").agg(F.count("*").alias("_n"))
    first = counts.select("shard", "_run", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_run")) - F.col("_n")).alias("_first"))
    numbered = rows.withColumn("_row", F.row_number().over(Window.partitionBy("shard", "_run").orderBy("doc", "digest")))
    return numbered.join(first, ["shard", "_run"]).select(
        F.col("doc").alias(doc_id), "size", "text_crc32", "digest", "shard", (F.col("_first") + F.col("_row") - 1).alias("slot")
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
