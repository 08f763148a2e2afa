"""The queries of the llm operators: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import common
from millrace.llm.ann import op4_learned_partitions
from millrace.llm.lang_id import op6_language_id
from millrace.llm.line_dedup import OP3_SQL, op3_line_dedup
from millrace.llm.lm_score import op7_lm_score
from millrace.llm.media import op9_media_columns
from millrace.llm.mixing import OP5_SQL, op5_mixing
from millrace.llm.pieces import op1_sentencepiece
from millrace.llm.secret_scan import OP2_SQL, op2_secret_scan
from millrace.llm.simhash import op10_simhash
from millrace.llm.token_planes import op8_token_planes


def _shipped(query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: _shipped(f) for f in (op1_sentencepiece, op2_secret_scan, op3_line_dedup, op4_learned_partitions, op5_mixing, op6_language_id, op7_lm_score, op8_token_planes, op9_media_columns, op10_simhash)}
ORACLE_SQL: dict[str, str] = {"op2_secret_scan": OP2_SQL, "op3_line_dedup": OP3_SQL, "op5_mixing": OP5_SQL}
