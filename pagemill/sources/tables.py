"""Scans and sinks of stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_SCHEMA = """scrape_id string, batch_id string, status string, created_at timestamp, started_at timestamp, completed_at timestamp,
 url_requested string, context_hint string, source_urls array<string>, university_name string, program_name string, degree_level string,
 program_duration string, intake_months array<string>, application_deadlines string, min_academic_requirement string, accepted_qualifications string,
 english_requirements struct<ielts:string,toefl:string,pte:string,duolingo:string,notes:string>,
 tuition_fees struct<domestic:string,international:string,currency:string,breakdown:string,notes:string>,
 other_fees string, scholarships string, work_experience string, other_requirements string, confidence_notes string,
 field_sources map<string,string>, method_used string, tier_used int, pages_fetched int, llm_model string, elapsed_seconds double, error string"""


def new_results(seeds: DataFrame) -> DataFrame:
    """A first record, status processing and all fields null, for each ``url`` of ``seeds`` (and its other result columns)."""
    schema = seeds.sparkSession.createDataFrame([], RESULT_SCHEMA).schema
    given = set(seeds.columns)
    fixed = {"scrape_id": F.expr("uuid()"), "status": F.lit("processing"), "url_requested": F.col("url"), "created_at": F.current_timestamp()}
    return seeds.select(*((F.col(f.name) if f.name in given else fixed.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in schema.fields))


def append_versions(results: DataFrame, path: str) -> None:
    """Append versions of results; readers keep the latest of each (``operators.history.latest``)."""
    results.write.mode("append").parquet(path)


def write_csv(rows: DataFrame, path: str, bom: bool = False) -> None:
    """Flat rows (``operators.records.export_rows``) as CSV with a header; an empty text stays empty.

    ``bom`` puts a byte order mark before the header of each file, by which spreadsheets know UTF-8.
    """
    first, *rest = rows.columns
    named = rows.withColumnRenamed(first, "\ufeff" + first) if bom else rows
    named.write.option("header", True).option("emptyValue", "").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """A JSON object for each row, one to a line, null fields included."""
    rows.write.option("ignoreNullFields", False).json(path)


def read_binary(spark: SparkSession, path: str, suffix: str = "*.pdf") -> DataFrame:
    """Files with their bytes, for a text extractor given to ``mapInPandas``; none is built in."""
    return spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(path)
