"""Queries of the numbered operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import oracle, oracle_ranked
from pagemill.llm.chat import op6_chat_format
from pagemill.llm.decontaminate import op2_decontamination
from pagemill.llm.gif import op5_gif
from pagemill.llm.jaccard import op8_jaccard_join
from pagemill.llm.langid import op4_langid
from pagemill.llm.lm import op9_lm_score
from pagemill.llm.packing import op7_packing
from pagemill.llm.quality import op11_quality_rules
from pagemill.llm.ranking import op12_ranked_search
from pagemill.llm.resampling import op13_resampling
from pagemill.llm.sharding import op10_sharding
from pagemill.llm.substring import op3_substring_dedup
from pagemill.llm.warc import op1_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_decontamination": op2_decontamination,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_langid": op4_langid,
    "op5_gif": op5_gif,
    "op6_chat_format": op6_chat_format,
    "op7_packing": op7_packing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_lm_score": op9_lm_score,
    "op10_sharding": op10_sharding,
    "op11_quality_rules": op11_quality_rules,
    "op12_ranked_search": op12_ranked_search,
    "op13_resampling": op13_resampling,
}

ORACLE_SQL = oracle.ORACLE_SQL | oracle_ranked.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
