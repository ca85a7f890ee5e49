"""The queries of the text operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pointlake.llm.bpe import op1_byte_bpe
from pointlake.llm.dartminhash import op10_dart_minhash
from pointlake.llm.langid import op6_nearest_centroid
from pointlake.llm.mixing import op4_entropy_balance
from pointlake.llm.mpeg import op8_mpeg_audio
from pointlake.llm.qda import op9_quadratic_discriminant
from pointlake.llm.rules import op3_decision_list
from pointlake.llm.secrets import op2_grammar_inference
from pointlake.llm.sharding import op5_label_propagation
from pointlake.llm.warc import SQL_OP7, op7_warc_writer


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_grammar_inference": op2_grammar_inference,
    "op3_decision_list": op3_decision_list,
    "op4_entropy_balance": op4_entropy_balance,
    "op5_label_propagation": op5_label_propagation,
    "op6_nearest_centroid": op6_nearest_centroid,
    "op7_warc_writer": op7_warc_writer,
    "op8_mpeg_audio": op8_mpeg_audio,
    "op9_quadratic_discriminant": op9_quadratic_discriminant,
    "pipeline": pipeline,
    "op10_dart_minhash": op10_dart_minhash,
}

ORACLE_SQL: dict[str, str] = {"op7_warc_writer": SQL_OP7}
