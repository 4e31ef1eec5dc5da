"""Result tables for point and ``$in`` look-ups.

A table is dealt into folders by a hash of its key, and each folder is sorted by it. A look-up knows the folders of its keys; inside
them Parquet's ranges, and bloom filters for keys that are no ranges (random ids, addresses), leave out row groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: Keys of a look-up that are written into the plan; more are joined.
LITERAL_KEYS = 1000
#: Bytes of a row group.
ROW_GROUP = 8 << 20


def bucket_of(key: Column, buckets: int) -> Column:
    """The folder of a key; null keys have one as well."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def write_lookup(rows: DataFrame, path: str, key: str, also: Sequence[str] = (), buckets: int = BUCKETS, parts: int = 1, row_group: int = ROW_GROUP, expected: int = 1_000_000, mode: str = "overwrite") -> None:
    """Write ``rows`` for look-ups by ``key``, and with bloom filters for the columns ``also``.

    Each folder has ``parts`` files of key ranges; a key with very many rows is dealt over them by the rows' hash. ``expected`` is the number
    of distinct values of a file that its bloom filters are made for. A column ``bucket`` of the rows is replaced.
    """
    rest = [c for c in rows.columns if c != "bucket"]
    dealt = rows.select(*rest, bucket_of(F.col(key), buckets).alias("bucket"))
    dealt = dealt.repartition(buckets * parts, "bucket", F.pmod(F.xxhash64(*rest_hashable(rows, rest)), F.lit(parts))).sortWithinPartitions("bucket", key)
    writer = dealt.write.mode(mode).partitionBy("bucket").option("parquet.block.size", row_group)
    for c in (key, *also):
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(expected))
    writer.parquet(path)


def rest_hashable(rows: DataFrame, names: Sequence[str]) -> list[Column]:
    """Columns that Spark can hash (maps and variants can't be)."""
    kinds = dict(rows.dtypes)
    return [F.col(c) for c in names if "map<" not in kinds[c] and "variant" not in kinds[c]]


def look_up(spark: SparkSession, path: str, key: str, keys: Sequence | DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows whose ``key`` is one of ``keys``: a list, or a DataFrame with a column of that name. Nulls find nothing, repeats count once.

    ``buckets`` is that of the table. Up to ``LITERAL_KEYS`` keys prune folders and row groups when the query is planned. More are joined by folder and
    key; where Spark finds them small enough to broadcast, it prunes folders while the query runs.
    """
    table = spark.read.parquet(path)
    kind = table.schema[key].dataType
    if isinstance(keys, DataFrame):
        few = [r[0] for r in keys.select(key).filter(F.col(key).isNotNull()).distinct().limit(LITERAL_KEYS + 1).collect()]
    else:
        few = sorted({k for k in keys if k is not None})
    if len(few) <= LITERAL_KEYS:
        if not few:
            return table.drop("bucket").limit(0)
        where = spark.range(1).select(F.explode(F.array(*(F.lit(k).cast(kind) for k in few))).alias("k")).select(bucket_of(F.col("k"), buckets)).distinct()
        return table.filter(F.col("bucket").isin(*(r[0] for r in where.collect())) & F.col(key).isin(*few)).drop("bucket")
    asked = keys.select(key) if isinstance(keys, DataFrame) else spark.createDataFrame([(k,) for k in few], f"{key} {kind.simpleString()}")
    asked = asked.filter(F.col(key).isNotNull()).distinct().withColumn("bucket", bucket_of(F.col(key), buckets))
    return table.join(asked, ["bucket", key], "left_semi").select(*(c for c in table.columns if c != "bucket"))


def look_up_where(spark: SparkSession, path: str, column: str, values: Sequence) -> DataFrame:
    """Rows by a column that is not the key: every folder is asked, its bloom filters leave out row groups."""
    found = sorted({v for v in values if v is not None})
    table = spark.read.parquet(path)
    return (table.filter(F.col(column).isin(*found)) if found else table.limit(0)).drop("bucket")
