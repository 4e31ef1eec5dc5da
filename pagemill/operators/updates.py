"""Updates of some fields: a log of partial updates, merged by field, and its table with replays and compaction.

An update names the fields it sets; a field set to null is not the same as one that is not named. In the log every field is
a struct of the order of its update and its value, or null where nothing set it. Merging is then the newest struct of
each field, which does not depend on order or repetition, so merged rows can be merged again with more of the log.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------- the log


def partial_updates(rows: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], named: Column) -> DataFrame:
    """Log rows ``key`` and a struct ``(at, v)`` for each field, from rows with the fields as columns and ``named``, an array of the fields that a row sets.

    ``at`` is the struct of the ``order`` columns, which must tell updates of a key apart. A null ``named`` sets nothing; names of other fields are
    not looked at; a null key is a key of its own.
    """
    at = F.struct(*order)
    return rows.select(key, *(F.when(F.array_contains(named, f), F.struct(at.alias("at"), F.col(f).alias("v"))).alias(f) for f in fields))


def json_updates(rows: DataFrame, key: str, order: Sequence[str], document: str, fields: str) -> DataFrame:
    """As ``partial_updates``, from JSON objects, with the ``fields`` and types of a DDL string: a member that is absent is not set, one that is ``null`` is set to null.

    Members that ``fields`` does not declare are left out; a document that is no JSON object sets nothing, and one value that does not fit its type is set to null.
    """
    read = rows.withColumn("_doc", F.from_json(document, fields)).withColumn("_named", F.json_object_keys(document))
    names = read.select("_doc.*").columns
    plain = read.select(key, *order, "_named", *(F.col(f"_doc.`{f}`").alias(f) for f in names))
    return partial_updates(plain, key, order, names, F.col("_named"))


def merged_updates(log: DataFrame, key: str) -> DataFrame:
    """One log row for each key: the newest update of every field. Updates are reduced before the shuffle, also those of a hot key."""
    fields = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(*(F.max_by(F.col(f), F.col(f"{f}.at")).alias(f) for f in fields))


def current(log: DataFrame, key: str) -> DataFrame:
    """The documents that the log makes: ``key``, the fields (null if unset or set to null) and ``set_fields``, the names of those ever set."""
    merged = merged_updates(log, key)
    fields = [c for c in merged.columns if c != key]
    names = F.array_compact(F.array(*(F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields)))
    return merged.select(key, *(F.col(f"{f}.v").alias(f) for f in fields), names.alias("set_fields"))


# ---------------------------------------------------------------- its table


class UpdateTable:
    """A log of updates in a folder: one folder a batch, and compacted ones that stand for all batches up to theirs.

    Batches are overwritten when they are replayed, and a compaction counts once its ``_SUCCESS`` file is there, so whatever is
    cut off half-way is done again or not seen. One writer and one compaction at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, fields: str, order: str):
        """``key``, ``fields`` and ``order`` are DDL strings of one column, the fields, and the columns that order updates."""
        parsed = lambda ddl: spark.createDataFrame([], ddl).schema.fields
        at = T.StructType(parsed(order))
        logged = lambda f: T.StructField(f.name, T.StructType([T.StructField("at", at), T.StructField("v", f.dataType)]))
        self.spark, self.path = spark, path.rstrip("/")
        self.key = parsed(key)[0].name
        self.schema = T.StructType([*parsed(key), *map(logged, parsed(fields))])

    def writer(self) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``: a batch that is given again takes the place of what it wrote before."""

        def write(log: DataFrame, batch: int) -> None:
            log.write.mode("overwrite").parquet(f"{self.path}/log/{batch:020d}")

        return write

    def _numbers(self, kind: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = lambda x: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(path) if x.getPath().getName().isdigit() and done(x))

    def _parts(self) -> tuple[int | None, list[int]]:
        """The newest compaction, and the batches after it."""
        base = max(self._numbers("compact"), default=None)
        return base, [n for n in self._numbers("log") if base is None or n > base]

    def log(self) -> DataFrame:
        """All that is needed to make the documents: the newest compaction and later batches."""
        base, batches = self._parts()
        paths = [f"{self.path}/compact/{n:020d}" for n in (base,) if n is not None] + [f"{self.path}/log/{n:020d}" for n in batches]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def compact(self) -> int | None:
        """Merge what there is into one row a key; the batch up to which this stands, or None if there is nothing new."""
        _, batches = self._parts()
        if not batches:
            return None
        merged_updates(self.log(), self.key).write.mode("overwrite").parquet(f"{self.path}/compact/{batches[-1]:020d}")
        return batches[-1]

    def vacuum(self) -> int:
        """Delete batches and compactions for which a newer compaction stands; returns how many folders went. Not while older readers run."""
        base, _ = self._parts()
        gone = 0
        for kind, keeps in (("log", lambda n: n > base), ("compact", lambda n: n == base)):
            for n in self._numbers(kind) if base is not None else []:
                if not keeps(n):
                    path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{n:020d}")
                    gone += bool(path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True))
        return gone
