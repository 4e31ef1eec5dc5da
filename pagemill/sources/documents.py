"""Free-form documents: VARIANT columns, dotted paths given as data, and appends that bring new fields."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("string", "long", "double", "boolean")


def variant_path(dotted: str) -> str:
    """``a.b[0].c`` as a path into a VARIANT; names may hold any characters but dots and brackets."""
    out = "$"
    for name, place in re.findall(r"([^.\[\]]+)|\[(\d+)\]", dotted):
        out += f"[{place}]" if place else "['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"
    if out == "$" or re.sub(r"[^.\[\]]+|\[\d+\]", "", dotted).strip(".") or dotted.startswith("."):
        raise ValueError(f"no path: {dotted!r}")
    return out


def as_document(text: Column) -> Column:
    """JSON text as a VARIANT; null for what is no JSON. Spark reads up to the end of the first value and no further."""
    return F.try_parse_json(text)


def at_path(document: Column, dotted: str, kind: str = "string") -> Column:
    """The value at a dotted path; null where there is none, where it is null, or where it can't be read as ``kind``.

    An object or a list read as a string is its JSON text.
    """
    return F.try_variant_get(document, variant_path(dotted), kind)


def has_path(document: Column, dotted: str) -> Column:
    """Whether there is something at a path, be it null."""
    return F.try_variant_get(document, variant_path(dotted), "variant").isNotNull()


def select_paths(rows: DataFrame, document: str, paths: Mapping[str, tuple[str, str]], keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` and a column for each of ``paths``, {column: (dotted path, type)}: paths are data, not code. The document is read once."""
    return rows.select(*keep, *(at_path(F.col(document), path, kind).alias(name) for name, (path, kind) in paths.items()))


def path_coverage(rows: DataFrame, document: str, paths: Sequence[str]) -> DataFrame:
    """``path, n, present, filled``: of n documents, those that have a path, and those where its text is neither null nor empty."""
    one = F.array(*(F.struct(F.lit(p).alias("path"), has_path(F.col(document), p).alias("present"), F.coalesce(at_path(F.col(document), p) != "", F.lit(False)).alias("filled")) for p in paths))
    each = rows.select(F.explode(one).alias("p")).select("p.*")
    return each.groupBy("path").agg(F.count("*").alias("n"), F.count_if("present").alias("present"), F.count_if("filled").alias("filled"))


def found_schema(rows: DataFrame, document: str) -> DataFrame:
    """One row, ``schema``: the type that all documents fit, merged in the tasks first."""
    return rows.agg(F.schema_of_variant_agg(document).alias("schema"))


def append_documents(rows: DataFrame, path: str) -> None:
    """Append rows that may have other columns, in another order, than what is there; readers merge them by name."""
    rows.write.mode("append").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """All appended rows with the columns of all appends; null where an append had no such column. A column keeps one type."""
    return spark.read.option("mergeSchema", True).parquet(path)
