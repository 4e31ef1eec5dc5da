"""Corpus pipeline: language ID, near duplicates, repeated passages, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given; ``run`` writes each
stage's result as Parquet to the shared folder and hands the table on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.decontaminate import decontaminate
from pagemill.llm.jaccard import near_duplicates, text_digest
from pagemill.llm.langid import UNKNOWN, fit, predict
from pagemill.llm.packing import pack, vocabulary_path
from pagemill.llm.shared import drop_staged, staged, staged_so_far
from pagemill.llm.substring import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text whose letters, times what its best score is below the first value, reach the second is no language. Of
#: 10,000 labelled rows those of 64 letters or more score 0.48 at least, and shorter ones come to 1.9 at most.
LEAST_SCORE, EVIDENCE = 0.4, 8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which some language is found.

    Those go whose text is null or has no letter, and those whose letters speak against every learned language, as noise
    has the rest: by ``LEAST_SCORE`` less the score, summed over the letters, so the fewer letters a text has, the lower its
    score must be. Where there is nothing to learn from, lettered documents stay. Repeated rows and null ids are treated as any other; an empty
    table gives no rows; other columns than ``COLUMNS`` go.
    """
    docs, model = docs.select(*COLUMNS), fit(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    letters = F.length(F.regexp_replace("text", r"\P{L}+", ""))
    judged = predict(docs, model).filter(F.col("lang_pred") != UNKNOWN)
    return judged.filter(letters * (F.lit(LEAST_SCORE) - F.col("score")) < EVIDENCE).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the least id (under one id, the least digest).

    Texts without words and documents with null ids are near to nothing and stay. Of rows that repeat an id and text
    one stays. An empty table gives no rows; other columns than ``COLUMNS`` go.
    """
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), "_digest"]
    first = near_duplicates(docs.select("doc_id", "text")).filter("is_first").withColumnRenamed("digest", "_digest").select(*key).distinct()
    rows = docs.select(*COLUMNS, text_digest("text").alias("_digest")).select("*", key[0])
    return rows.join(first, ["_id", "_digest"], "left_semi").dropDuplicates(["_id", "_digest"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in an earlier one; those left without words go, null texts among them.

    Documents with null ids lose nothing; rows that repeat an id and text do not count against each other. An empty
    table gives no rows; other columns than ``COLUMNS`` go.
    """
    kept = remove_repeats(docs.select(*COLUMNS)).filter(F.col("text") != "")
    changed = F.col("n_removed") > 0
    return kept.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and empty texts hold none. Rows are judged by id and text, so one of several under an id can go alone; repeated
    rows go or stay together. An empty table gives no rows; other columns than ``COLUMNS`` go.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontaminate(docs.select("doc_id", "text"), items).filter("n_hit > 0").select(F.col("doc_id").alias("_id"), "text_hash")
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("_hash"))
    return rows.join(hit, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("text_hash")), "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token windows that hold all documents, each of repeated rows by itself; null texts have their end id alone.

    An empty table gives no pieces.
    """
    return pack(docs, vocabulary_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("clean_of_benchmark", clean_of_benchmark),
    ("packed", packed),
]

#: A network and a tokenizer decide on its rows, which SQL cannot express; tests hold it against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table; of the tables in the shared folder the last stage's is left."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), staged_so_far()
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_staged(since, keep=(f"stage-{name}",))
    return docs
