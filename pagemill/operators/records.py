"""Operators on extracted records: merge, status, coverage, gaps, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import lexicon as L


def merge_records(rows: DataFrame, key: str, order: str, source: str, scalars: list[str], lists: list[str] = (), nested: dict[str, list[str]] | None = None) -> DataFrame:
    """One record per key: the first value in ``order`` of each scalar and sub-field, the union of each list, and ``field_sources``.

    Aggregates only, so rows of a key are combined before the shuffle; lists are gathered in order.
    """
    aggs, origins = [], []

    def first(value: Column, name: str) -> Column:
        place = F.when(value.isNotNull(), F.col(order))
        origins.append((name, F.min_by(F.col(source), place)))
        return F.min_by(value, place)

    for f in scalars:
        aggs.append(first(F.col(f), f).alias(f))
    for f in lists:
        some = F.size(F.col(f)) > 0
        origins.append((f, F.min_by(F.col(source), F.when(some, F.col(order)))))
        aggs.append(F.array_sort(F.collect_list(F.when(some, F.struct(F.col(order).alias("o"), F.col(f).alias("v"))))).alias(f))
    for parent, subs in (nested or {}).items():
        aggs.append(F.struct(*(first(F.col(f"{parent}.{s}"), f"{parent}.{s}").alias(s) for s in subs)).alias(parent))
    merged = rows.groupBy(key).agg(*aggs, *(o.alias(f"_o{k}") for k, (_, o) in enumerate(origins)))
    out = [F.col(key), *scalars]
    for f in lists:
        values = F.array_distinct(F.filter(F.transform(F.flatten(F.transform(f, lambda x: x["v"])), lambda x: F.trim(x)), lambda v: v != ""))
        out.append(F.when(F.size(values) > 0, values).alias(f))
    for parent, subs in (nested or {}).items():
        out.append(F.when(F.coalesce(*(F.col(f"{parent}.{s}") for s in subs)).isNotNull(), F.col(parent)).alias(parent))
    pairs = F.array(*(F.struct(F.lit(n).alias("k"), F.col(f"_o{k}").alias("v")) for k, (n, _) in enumerate(origins)))
    out.append(F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("field_sources"))
    return merged.select(*out)


def record_status(values: list[Column], university: Column, program: Column) -> Column:
    """failed without names; success with a university and eight values (names count); else partial."""
    found = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    return F.when(university.isNull() & program.isNull(), "failed").when(university.isNotNull() & (found >= 8), "success").otherwise("partial")


def coverage(values: dict[str, Column]) -> Column:
    """Struct of ``found``, ``total`` and the names of ``missing`` fields; null and empty text count as missing."""
    gone = {n: F.coalesce(F.nullif(v.cast("string"), F.lit("")), F.lit(None)).isNull() for n, v in values.items()}
    missing = F.filter(F.array(*(F.when(g, n) for n, g in gone.items())), lambda x: x.isNotNull())
    return F.struct((F.lit(len(values)) - F.size(missing)).alias("found"), F.lit(len(values)).alias("total"), missing.alias("missing"))


def missing_fields(english: Column, fees: Column, deadlines: Column, minimum: Column) -> Column:
    """Critical fields without a value; notes alone do not count."""
    blank = lambda *c: F.coalesce(*(F.nullif(x, F.lit("")) for x in c)).isNull()
    return F.filter(
        F.array(
            F.when(blank(fees["domestic"], fees["international"]), "tuition_fees"),
            F.when(blank(english["ielts"], english["toefl"], english["pte"], english["duolingo"]), "english_requirements"),
            F.when(deadlines.isNull(), "application_deadlines"),
            F.when(minimum.isNull(), "min_academic_requirement"),
        ),
        lambda x: x.isNotNull(),
    )


def suggested_pages(missing: Column, seen: Column, most: int = L.SUGGESTIONS) -> Column:
    """Page types to look for, in order, without those that some page seen already resembles."""
    table = F.create_map(*(x for k, v in L.FIELD_PAGES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    wanted = F.array_distinct(F.flatten(F.transform(missing, lambda f: table[f])))
    fresh = F.filter(wanted, lambda t: ~F.exists(seen, lambda s: s.contains(t)))
    return F.slice(fresh, 1, most)


def export_rows(records: DataFrame) -> DataFrame:
    """Records as flat text columns: lists joined by "; ", source URLs by " | ", null as empty text, times in ISO form."""
    c = F.col
    special = {
        "intake_months": F.array_join("intake_months", "; "),
        "source_urls": F.array_join("source_urls", " | "),
        "created_at": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"),
    }
    special |= {f"english_{k}": c(f"english_requirements.{k}") for k in ("ielts", "toefl", "pte", "duolingo", "notes")}
    special |= {f"tuition_{k}": c(f"tuition_fees.{k}") for k in ("international", "domestic", "currency", "notes")}
    return records.select(*(F.coalesce(special.get(n, c(n)).cast("string"), F.lit("")).alias(n) for n in L.EXPORT_COLUMNS))


#: Results that an export of all gives at most.
EXPORT_LIMIT = 10_000


def selected_results(records: DataFrame, ids: DataFrame | None = None, every: bool = False, key: str = "scrape", limit: int = EXPORT_LIMIT) -> DataFrame:
    """The records to export: those whose ``key`` is in ``ids``, or the first ``limit`` of all by key.

    Neither is an error, and so is an export without records, which is found here by asking for one row.
    """
    if not every and ids is None:
        raise ValueError("give ids, or every=True")
    found = records.orderBy(key).limit(limit) if every else records.join(ids.select(key).distinct(), key, "left_semi")
    if found.isEmpty():
        raise LookupError("no record to export")
    return found


def json_rows(records: DataFrame, key: str = "scrape") -> DataFrame:
    """``key, json``: each record as one JSON text, null fields included."""
    return records.select(key, F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("json"))


def coverage_mark(percent: Column) -> Column:
    """``good`` from 75 percent on, ``fair`` from 50, else ``poor``."""
    return F.when(percent >= 75, "good").when(percent >= 50, "fair").otherwise("poor")


def zipped(rows: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """``key, pos, left, right``: the values of two arrays by place, as far as both reach; null arrays have none."""
    pairs = F.arrays_zip(F.col(left).alias("l"), F.col(right).alias("r"))
    both = F.least(F.size(left), F.size(right))
    return rows.select(key, F.posexplode(F.slice(pairs, F.lit(1), F.greatest(F.coalesce(both, F.lit(0)), F.lit(0)))).alias("pos", "p")).select(key, F.col("pos").cast("long").alias("pos"), F.col("p.l").alias(left), F.col("p.r").alias(right))


def shown(value: Column, kind: str = "string") -> Column:
    """Whether a value is shown: not null, and neither an empty text, the text ``null`` nor an empty list."""
    if kind.startswith("array"):
        return F.coalesce(F.size(value) > 0, F.lit(False))
    return F.coalesce(~value.cast("string").isin("", "null"), F.lit(False))


def field_counts(simple: tuple[str, ...], parts: dict[str, tuple[str, ...]], lists: tuple[str, ...] = ()) -> dict[str, Column]:
    """``simple_fields``: fields, and ``lists``, with a value that is shown; ``total_fields``: those and the groups of parts of which some has one."""
    each = [*(shown(F.col(n)) for n in simple), *(shown(F.col(n), "array") for n in lists)]
    found = sum((x.cast("int") for x in each), F.lit(0))
    grouped = sum((F.greatest(*(shown(F.col(n)) for n in names), F.lit(False)).cast("int") for names in parts.values()), F.lit(0))
    return {"simple_fields": found, "total_fields": found + grouped}


def validation_report(records: DataFrame, key: str, fields: dict[str, Column], elapsed: Column, error: Column, most: int = 4) -> DataFrame:
    """A line of the report for each record: ``mark`` (``error`` for one that failed, else that of its coverage), ``covered`` (found of all, and
    the percent rounded down), ``seconds``, and ``missing``: the last names of the first ``most`` missing fields and how many more, or the head of the error.
    """
    c = coverage(fields)
    rows = records.select(key, c.alias("c"), elapsed.alias("_s"), error.alias("_e"))
    percent = F.floor(100 * F.col("c.found") / F.col("c.total"))
    names = F.array_join(F.transform(F.slice("c.missing", 1, most), lambda f: F.element_at(F.split(f, "[.]"), -1)), ", ")
    more = F.size("c.missing") - most
    listed = F.when(more > 0, F.concat(names, F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(names)
    failed = F.col("_e").isNotNull()
    covered = F.concat(F.col("c.found").cast("string"), F.lit("/"), F.col("c.total").cast("string"), F.lit(" ("), percent.cast("string"), F.lit("%)"))
    return rows.select(
        key,
        F.when(failed, "error").otherwise(coverage_mark(percent)).alias("mark"),
        F.when(~failed, covered).alias("covered"),
        F.round("_s", 1).alias("seconds"),
        F.when(failed, F.substring("_e", 1, 50)).otherwise(listed).alias("missing"),
    )
