"""Operators of a training-data pipeline.  Nothing outside this subpackage imports it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from .chat import op4_chat
    from .huffman import op5_huffman
    from .line_dedup import op1_line_dedup
    from .packing import op2_packing
    from .pii import op10_pii
    from .positional_index import op8_decontamination
    from .quality_rules import op7_quality_rules
    from .secrets import op9_secrets
    from .simhash import op3_simhash
    from .toxicity import op6_toxicity

    return {f.__name__: f for f in (op1_line_dedup, op2_packing, op3_simhash, op4_chat, op5_huffman, op6_toxicity, op7_quality_rules, op8_decontamination, op9_secrets, op10_pii)}


def oracle_sql() -> dict[str, str]:
    from .chat import ORACLE_SQL

    return {"op4_chat": ORACLE_SQL}
