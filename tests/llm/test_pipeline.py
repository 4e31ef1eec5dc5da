"""The pipeline's stages against plain versions, and the entry module with and without the subpackage."""

import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from test_ops import check_packing  # noqa: E402

import corpus_pipeline as pipeline  # noqa: E402

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def test_stages_on_hard_documents(spark, tmp_path):
    rows = brute.documents(60)
    items = [(1, " ".join(rows[9][1].split()[2:14])), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(pipeline.STAGES)
    docs = table(spark, rows)

    docs = pipeline.staged(stages["language"](spark, docs, str(tmp_path)), "a")
    lettered = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(lettered)

    docs = pipeline.staged(stages["near_copies"](spark, docs, str(tmp_path)), "b")
    kept = [(i, t) for i, t in lettered if brute.classes(lettered)[i][0] == i]
    assert sorted(r.doc_id for r in docs.collect()) == sorted(i for i, _ in kept)

    docs = pipeline.staged(stages["repeated_passages"](spark, docs, str(tmp_path)), "c")
    cut = [(i, t) for i, (_, _, t) in brute.without_repeats(kept).items() if t]
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(cut)

    docs = pipeline.staged(stages["clean_of_benchmark"](spark, docs, str(tmp_path)), "d")
    hit = brute.decontaminated(cut, items)
    clean = [(i, t) for i, t in cut if not hit[i][1]]
    assert len(clean) < len(cut) and sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(clean)
    assert docs.columns == list(pipeline.COLUMNS)

    check_packing(stages["packed"](spark, docs, str(tmp_path)).collect(), clean, 4096)


def test_language_stage_without_labels_keeps_texts_with_letters(spark):
    rows = [(1, "clean text"), (2, "12 !?"), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], SCHEMA)
    assert [r.doc_id for r in pipeline.language(spark, docs, DIR).collect()] == [1]


def test_language_stage_drops_letters_that_are_no_language(spark):
    """Of the labelled documents all stay; the network's score, not the letters, decides on the others."""
    import random

    rng = random.Random(5)
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*pipeline.COLUMNS)
    noise = [(-1 - k, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(80)), None, "s", 0) for k in range(10)]
    got = {r.doc_id for r in pipeline.language(spark, given.unionByName(spark.createDataFrame(noise, SCHEMA)), DIR).collect()}
    lettered = {r.doc_id for r in given.collect() if any(c.isalpha() for c in r.text or "")}
    assert got == lettered


def test_stages_on_repeated_ids_and_rows(spark, tmp_path):
    """Rows are judged by id and text; the result of each stage has its rows' own columns."""
    prose = lambda x, n=40: " ".join(f"{x}word{i}" for i in range(n))
    passage = " ".join(f"bench{i}" for i in range(12))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(0, prose("a")), (0, prose("a")), (1, prose("a")), (1, prose("b")), (None, prose("c")), (None, prose("c")), (2, prose("d") + " " + passage), (2, prose("e")), (3, None), (4, "")]
    docs = table(spark, rows).withColumns({c: F.lit("clash") for c in ("_id", "_digest", "_hash", "score", "n_words", "text_hash")})
    stages = dict(pipeline.STAGES)
    told = lambda df: sorted((repr(r.doc_id), repr(r.text)) for r in df.collect())
    show = lambda rows: sorted((repr(i), repr(t)) for i, t in rows)

    near = stages["near_copies"](spark, docs, str(tmp_path))
    assert told(near) == show([(0, prose("a")), (1, prose("b")), (None, prose("c")), *rows[6:]])
    clean = stages["clean_of_benchmark"](spark, docs, str(tmp_path))
    assert told(clean) == show([*rows[:6], *rows[7:]])
    cut = stages["repeated_passages"](spark, docs, str(tmp_path))
    assert told(cut) == show([*rows[:2], *rows[3:8]])
    pieces = stages["packed"](spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(i for i, _ in rows)
    assert all(df.columns == list(pipeline.COLUMNS) for df in (near, clean, cut))


def test_run_equals_the_stages_one_by_one(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    lettered = [(i, t) for i, t in docs if any(c.isalpha() for c in t or "")]
    classes = brute.classes(lettered)
    cut = [(i, t) for i, (_, _, t) in brute.without_repeats([(i, t) for i, t in lettered if classes[i][0] == i]).items() if t]
    hit = brute.decontaminated(cut, items)
    check_packing(pipeline.run(spark, DIR).collect(), [(i, t) for i, t in cut if not hit[i][1]], 4096)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_on_empty_tables(spark, name):
    assert dict(pipeline.STAGES)[name](spark, spark.createDataFrame([], SCHEMA), DIR).count() == 0


def test_entry_names_all_queries():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{k}" for k in range(1, 14)] and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
