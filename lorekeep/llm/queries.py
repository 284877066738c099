"""The queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import ann, bpe, language, lines, neardup, packing, pii, quality, rules, urls


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_bpe": bpe.op2_bpe,
    "op3_pii": pii.op3_pii,
    "op4_quality_rules": rules.op4_quality_rules,
    "op5_nearest": ann.op5_nearest,
    "op6_language": language.op6_language,
    "op7_near_dup": neardup.op7_near_dup,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_url_filter": urls.op9_url_filter,
    "op10_packing": packing.op10_packing,
    "pipeline": pipeline,
}

ORACLE: dict[str, str] = {
    "op8_line_dedup": lines.SQL,
    "op9_url_filter": urls.SQL,
}
