"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of the k-gram hashes of every ``window`` consecutive words, the smallest is a fingerprint (ties: the
leftmost). Two texts that share a window share its fingerprint at the same place in it, so joining
fingerprints finds every shared window; each hit is then extended word by word to both sides and
kept if it holds a whole window. Items with fewer words than a window are looked up by one hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.shared import staged

#: What stands between words; words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the lower-cased text.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A fingerprint is a long: 40 bits of hash, then the place of its first word in 24 bits.
PLACE_BITS = 24
PLACES = 1 << PLACE_BITS
#: Fingerprints of a test set that are broadcast at most, at about 300 bytes each; beyond, a shuffled join is used.
BROADCAST_FINGERPRINTS = 250_000


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased and nothing else; null has none."""
    ascii_only = F.length(text) == F.octet_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(low, GAP), ""), F.array().cast("array<string>"))


def _from(x: Column, n: int) -> Column:
    return F.slice(x, n + 1, F.size(x)) if n else x


def _with_grams(df: DataFrame, n: int, out: str) -> DataFrame:
    """Add ``out``: the hash of the n words from each word on, built from lengths that double."""
    df = df.withColumn("_g1", F.transform("words", lambda w: F.xxhash64(w)))
    size, last, done = 1, None, 0
    pair = lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))
    while size <= n:
        have = F.col(f"_g{size}")
        if n & size:
            df = df.withColumn("_sum", have if last is None else pair(F.col("_sum"), _from(have, done)))
            last, done = "_sum", done + size
        if size * 2 <= n:
            df = df.withColumn(f"_g{size * 2}", pair(have, _from(have, size)))
        size *= 2
    left = F.greatest(F.size("words") - (n - 1), F.lit(0))
    return df.withColumn(out, F.slice("_sum", F.lit(1), left)).drop("_sum", *(f"_g{1 << i}" for i in range(n.bit_length())))


def _packed(grams: Column, kind: int) -> Column:
    return F.transform(
        grams,
        lambda h, i: F.shiftleft(h if not kind else F.xxhash64(h, F.lit(kind)), PLACE_BITS).bitwiseOR(
            i.cast("long").bitwiseAND(F.lit(PLACES - 1))
        ),
    )


def _with_fingerprints(df: DataFrame, window: int, k: int) -> DataFrame:
    """Add ``prints``: the winnowed fingerprints of ``words``."""
    df = _with_grams(df, k, "_h").withColumn("_m1", _packed(F.col("_h"), 0))
    least = lambda a, b: F.zip_with(a, b, lambda x, y: F.least(x, y))
    width, size = window - k + 1, 1
    while size * 2 <= width:
        df = df.withColumn(f"_m{size * 2}", least(F.col(f"_m{size}"), _from(F.col(f"_m{size}"), size)))
        size *= 2
    low = F.col(f"_m{size}") if size == width else least(F.col(f"_m{size}"), _from(F.col(f"_m{size}"), width - size))
    left = F.greatest(F.size("words") - (window - 1), F.lit(0))
    return df.withColumn("prints", F.array_distinct(F.slice(low, F.lit(1), left))).drop("_h", *(f"_m{1 << i}" for i in range(width.bit_length())))


def fingerprints(items: DataFrame, item: str, text: str, window: int = 10, k: int = 5) -> DataFrame:
    """A row per fingerprint of the test set: ``key``, ``item``, the words around it and how many must match."""
    df = _with_fingerprints(items.select(F.col(item).alias("item"), words_of(F.col(text)).alias("words")), window, k)
    short = F.size("words") < window
    whole = F.lit(None).cast("array<bigint>")
    for n in range(1, window):
        df = _with_grams(df, n, "_h")
        whole = F.when(F.size("words") == n, _packed(F.col("_h"), n)).otherwise(whole)
        df = df.withColumn("_whole", whole).drop("_h")
        whole = F.col("_whole")
    df = df.select("item", "words", F.explode_outer(F.when(short, F.col("_whole")).otherwise(F.col("prints"))).alias("_v")).filter(F.col("_v").isNotNull())
    place = F.col("_v").bitwiseAND(F.lit(PLACES - 1)).cast("int")
    return df.select(
        F.shiftright("_v", PLACE_BITS).alias("key"),
        "item",
        F.transform(F.sequence(F.lit(k - window), F.lit(window - 1)), lambda r: F.when(place + r >= 0, F.get("words", place + r))).alias("around"),
        F.least(F.size("words"), F.lit(window)).alias("need"),
    )


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    k: int = 5,
    broadcast_fingerprints: int = BROADCAST_FINGERPRINTS,
) -> DataFrame:
    """Where texts repeat passages of a test set.

    Returns ``doc_id``, ``n_words`` long, ``n_hit`` long (words inside any occurrence of a window),
    ``spans`` (first word and end of each stretch of such words), ``items`` (ids with an occurrence) and
    ``text_hash`` (xxhash64 of the text, which tells apart rows of one id).
    A window is ``window`` consecutive words of an item; an item of fewer words is one window, one
    without words has none. A null or empty text has no words; texts of any length are read whole. Repeated rows each have
    their row, all alike, and so have items, whose repeats change nothing; null ids of documents stay null; where windows of
    several items meet, all of these are named; other columns are not looked at; with no items, or no documents, nothing is hit.

    The test set's fingerprints are counted first: up to ``broadcast_fingerprints`` they are
    broadcast and texts are read once without a shuffle; beyond, fingerprints are joined by a
    shuffle and only the hits meet their texts again.
    """
    prints = staged(fingerprints(items, item_id, item_text, window, k), "prints")
    lengths = [r[0] for r in prints.filter(F.col("need") < window).select("need").distinct().collect()]  # under `window` values
    small = prints.count() <= broadcast_fingerprints

    df = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("_same"), words_of(F.col(text)).alias("words"))
    df = _with_fingerprints(df.withColumn("n_words", F.size("words").cast("long")), window, k)
    for n in lengths:
        df = _with_grams(df, n, "_h").withColumn("prints", F.concat("prints", _packed(F.col("_h"), n))).drop("_h")
    none = F.array(F.lit(None).cast("long"))  # a row that every text keeps
    df = df.withColumn("prints", F.concat(none, F.col("prints")))
    keep = ["doc", "_same", "n_words"]
    split = [F.shiftright("_v", PLACE_BITS).alias("key"), F.col("_v").bitwiseAND(F.lit(PLACES - 1)).cast("int").alias("place")]
    if small:
        found = df.select(*keep, "words", F.explode_outer("prints").alias("_v")).select(*keep, "words", F.col("_v").isNull().alias("_base"), *split)
        found = found.join(F.broadcast(prints), "key", "left").filter(F.col("_base") | F.col("need").isNotNull())
        rows = _verified(found, keep, window, k)
    else:
        every = df.select(*keep, F.explode_outer("prints").alias("_v")).filter(F.col("_v").isNotNull()).select("doc", "_same", *split)
        hits = every.join(prints, "key").drop("key").withColumnsRenamed({"doc": "_doc", "_same": "_text"})
        found = hits.join(df.select(*keep, "words"), F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("_same") == F.col("_text")))
        found = found.select(*keep, "words", F.lit(False).alias("_base"), "place", "item", "around", "need")
        base = df.select(*keep, *(F.lit(None).cast(t).alias(c) for c, t in (("item", prints.schema["item"].dataType), ("from", "int"), ("to", "int"))))
        rows = base.unionByName(_verified(found, keep, window, k))

    grouped = rows.groupBy(*keep).agg(
        F.array_sort(F.collect_set(F.when(F.col("from").isNotNull(), F.struct("from", "to")))).alias("_hits"),
        F.collect_set("item").alias("items"),
        F.count_if(F.col("from").isNull()).cast("int").alias("_times"),  # each row of a text sends one without a hit
    )
    hit = F.transform("_hits", lambda x: F.sequence(x["from"], x["to"] - 1))
    out = grouped.withColumn("_hit", F.sort_array(F.array_distinct(F.flatten(hit))))
    # a stretch begins at a hit word without a hit neighbour before it, and ends likewise
    begins = F.filter("_hit", lambda w, i: (i == 0) | (F.get("_hit", F.greatest(i - 1, F.lit(0))) != w - 1))
    ends = F.filter("_hit", lambda w, i: F.coalesce(F.get("_hit", i + 1) != w + 1, F.lit(True)))
    spans = F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("from"), (b + 1).alias("to")))
    out = out.select(F.col("doc").alias(doc_id), "n_words", F.size("_hit").cast("long").alias("n_hit"), spans.alias("spans"), "items", F.col("_same").alias("text_hash"), "_times")
    return out.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_time", "_times")


def _verified(found: DataFrame, keep: list[str], window: int, k: int) -> DataFrame:
    """Extend each hit to both sides within a window's reach; keep those that hold a whole window."""
    reach = F.sequence(F.lit(k - window), F.lit(window - 1))
    # a place is stored modulo PLACES, so longer texts have several
    places = F.when(F.col("need").isNotNull(), F.sequence(F.col("place"), F.greatest(F.col("n_words").cast("int") - 1, F.col("place")), F.lit(PLACES)))
    df = found.select(*keep, "words", "_base", "item", "around", "need", F.explode_outer(places).alias("p"))
    differs = F.filter(
        F.zip_with(reach, F.col("around"), lambda r, w: F.when(F.coalesce((F.col("p") + r >= 0) & (F.get("words", F.greatest(F.col("p") + r, F.lit(0))) == w), F.lit(False)), F.lit(None)).otherwise(r)),
        lambda r: r.isNotNull(),
    )
    df = df.withColumn("_differs", differs)
    begin = F.coalesce(F.array_max(F.filter("_differs", lambda r: r < 0)) + 1, F.lit(k - window))
    end = F.coalesce(F.array_min(F.filter("_differs", lambda r: r >= 0)), F.lit(window))
    df = df.select(*keep, "_base", "item", "need", (F.col("p") + begin).alias("from"), (F.col("p") + end).alias("to"))
    df = df.filter(F.col("_base") | (F.col("to") - F.col("from") >= F.col("need")))
    return df.select(*keep, "item", "from", "to")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the benchmark table, one row per document."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    ids = F.sort_array(F.transform("items", lambda x: x.cast("string")))
    return decontaminate(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
