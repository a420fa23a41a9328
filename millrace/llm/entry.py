"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from millrace.llm import bpe, embed, html, langid, lm, mixing, quality, sharding, simhash, substrings


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (
        simhash.op1_simhash,
        embed.op2_embedding_dedup,
        substrings.op3_suffix_array_dedup,
        sharding.op4_sharding,
        lm.op5_lm_scoring,
        html.op6_html_extraction,
        quality.op7_quality_rules,
        mixing.op8_mixing,
        bpe.op9_bpe,
        langid.op10_language_id,
    )
    return {f.__name__: f for f in fs} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the same; the other operators are tested against brute force or held-out rows."""
    return {
        "op2_embedding_dedup": embed.ORACLE_SQL,
        "op4_sharding": sharding.ORACLE_SQL,
        "op5_lm_scoring": lm.ORACLE_SQL,
        "op7_quality_rules": quality.ORACLE_SQL,
        "op8_mixing": mixing.ORACLE_SQL,
    }
