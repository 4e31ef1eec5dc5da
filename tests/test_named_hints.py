"""Queries look only for the findings that they show, and for none that is given."""

import __spark_entry__
from pyspark.sql import functions as F
from test_quick_patterns import odd_texts

from pagemill.functions import extract
from pagemill.functions import lexicon as L


def _patterns(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return {n for n, p in {"ielts": L.IELTS, "pte": L.PTE, "duolingo": L.DUOLINGO, "duration": L.DURATION, "gpa": L.GPA, "fees": L.FEE_CONTEXT, "deadlines": L.DEADLINE}.items() if extract.quick(p)[:40] in plan or (n == "deadlines" and extract._LABEL in plan)}


def test_queries_look_for_what_they_show(spark, tmp_path):
    spark.range(5).select(F.col("id").alias("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 100_000)
    found = {n: _patterns(__spark_entry__.queries()[n](spark, str(tmp_path))) for n in ("filled_records", "validated_records", "extracted_hints")}
    assert found == {"filled_records": {"ielts", "pte", "fees"}, "validated_records": {"ielts", "duration", "gpa"}, "extracted_hints": {"ielts", "pte", "duolingo", "duration", "gpa", "fees", "deadlines"}}


def test_keys_are_dealt_out_without_a_sort(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    rows = __spark_entry__.queries()["filled_records"](spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert "RoundRobinPartitioning" not in rows._jdf.queryExecution().executedPlan().toString()


def test_records_filled_from_named_findings_are_those_filled_from_all(spark):
    words = "IELTS|6.5|no band below|at least|TOEFL iBT|100|Band B|PTE|79|tuition|fee|cost|home|UK|international|overseas|£|$|€|900|usd 5|cad 7|per year|1,000|.".split("|")
    t = F.col("text")
    n = F.crc32("text") % 4
    none = F.lit(None).cast("string")
    e = F.struct(F.when(n == 0, "7.0").when(n == 1, "").alias("ielts"), none.alias("toefl"), none.alias("pte"), none.alias("duolingo"), none.alias("notes"))
    f = F.struct(F.when(n == 1, "£1").when(n == 2, "").alias("domestic"), none.alias("international"), none.alias("currency"), none.alias("notes"))
    some = extract.hints(t, extract.ENGLISH_GAPS + extract.FEE_GAPS, {"ielts": e["ielts"], "domestic_fee": f["domestic"]})
    rows = odd_texts(spark, words, 3000, 11).union(spark.createDataFrame([(None,), ("",)], "text string")).select("text", some.alias("s"), extract.hints(t).alias("h"))
    filled = lambda h: F.struct(extract.fill_english(e, F.col(h)), extract.fill_fees(f, F.col(h)))
    got = rows.select(F.count_if(~filled("s").eqNullSafe(filled("h"))), F.count_if((n < 2) & F.col("h.ielts").isNotNull()), F.count("s.ielts"), F.count("h.ielts"), F.count("s.domestic_fee")).first()
    assert got[0] == 0 and got[1] > 20 and 20 < got[2] < got[3] and got[4] > 20
